"""Queries of feeds, payloads, extraction, the archive, user state and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as t
from tidewire.operators import archive, extract, weather
from tidewire.plans.wire import NOW_MS, STORIES_SQL, stories
from tidewire.queries import query, sqltext as q
from tidewire.session import spread, table
from tidewire.sources import feeds as feed_source, providers


def item_documents(spark, d):
    """Every feed item as an RSS document of its own: feed_id (the item's id), xml."""
    i = spread(table(spark, d, "rss_items").select("item_id", "title", "link", "guid", "pub_date", "description", "content_encoded", "creator", "categories", "media_contents"))
    data = lambda tag, c: F.concat(F.lit(f"<{tag}><![CDATA["), t.blank(F.col(c)), F.lit(f"]]></{tag}>"))
    cats = F.array_join(F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.concat(F.lit("<category>"), F.regexp_replace(c, "&", "&amp;"), F.lit("</category>"))), "")
    media = F.array_join(F.transform(F.filter(F.coalesce("media_contents", F.expr("cast(array() as array<struct<url:string,medium:string,mime_type:string,width:string,height:string>>)")), lambda m: m["url"].isNotNull()), lambda m: F.concat(F.lit('<media:content url="'), m["url"], F.lit('" medium="image"/>'))), "")
    xml = F.concat(F.lit("<rss><channel><item>"), data("title", "title"), F.lit("<link>"), t.blank(F.col("link")), F.lit("</link><guid>"), t.blank(F.col("guid")), F.lit("</guid>"), data("pubDate", "pub_date"), data("description", "description"), data("content:encoded", "content_encoded"), data("dc:creator", "creator"), cats, media, F.lit("</item></channel></rss>"))
    return i.select(F.col("item_id").cast("string").alias("feed_id"), xml.alias("xml"))


@query(
    "feed_rows",
    f"""SELECT CAST(item_id AS VARCHAR) AS feed_id, {q.plain_text('title')} AS title, {q.plain_text('link')} AS link, {q.plain_text('guid')} AS guid, {q.plain_text('pub_date')} AS date_text,
 {q.plain_text('description')} AS descr, {q.plain_text('creator')} AS creator, array_to_string(coalesce(categories, [])[1:3], ';') AS cats
 FROM rss_items WHERE {q.plain_text('title')} <> '' AND {q.plain_text('link')} <> ''""",
)
def feed_rows(spark, d):
    rows = feed_source.parse_feeds(item_documents(spark, d))
    return rows.select("feed_id", "title", "link", "guid", "date_text", "descr", "creator", F.array_join("categories", ";").alias("cats"))


@query("feed_images")
def feed_images(spark, d):
    rows = feed_source.parse_feeds(item_documents(spark, d))
    return rows.select("feed_id", F.posexplode("images").alias("place", "url"))


@query(
    "provider_newsapi",
    f"""WITH {STORIES_SQL} SELECT ord AS payload_id, trim({q.sub("CASE WHEN coalesce(source, '') <> '' AND ends_with(title, concat(' - ', source)) THEN left(title, length(title) - length(source) - 3) ELSE title END", r'\s+', ' ')}) AS title, link, trim({q.sub(q.blank('source'), r'\s+', ' ')}) AS source, trim({q.sub(q.blank('descr'), r'\s+', ' ')}) AS descr, coalesce(image_url, '') AS image_url
 FROM stories WHERE trim(coalesce(title, '')) <> '' AND regexp_matches(coalesce(link, ''), '(?i)^https?://')""",
)
def provider_newsapi(spark, d):
    one = F.struct("title", F.col("link").alias("url"), F.col("descr").alias("description"), F.col("image_url").alias("urlToImage"), F.struct(F.col("source").alias("name")).alias("source"))
    payloads = stories(spark, d).select(F.col("ord").alias("payload_id"), F.to_json(F.struct(F.array(one).alias("articles"))).alias("json"))
    return providers.normalise(payloads, "newsapi").select("payload_id", "title", "link", "source", "descr", "image_url")


@query("item_text", f"SELECT item_id, {q.plain_text('content_encoded')} AS txt, CAST(len(string_split(content_encoded, chr(10))) AS INTEGER) AS n_lines FROM rss_items WHERE content_encoded IS NOT NULL")
def item_text(spark, d):
    return table(spark, d, "rss_items").where("content_encoded IS NOT NULL").select("item_id", t.plain_text(F.col("content_encoded")).alias("txt"), F.size(F.split("content_encoded", "\n")).alias("n_lines"))


@query("item_markdown", f"SELECT item_id, md5({q.markdown('content_encoded')}) AS digest FROM rss_items WHERE content_encoded IS NOT NULL")
def item_markdown(spark, d):
    return table(spark, d, "rss_items").where("content_encoded IS NOT NULL").select("item_id", F.md5(t.markdown(F.col("content_encoded"))).alias("digest"))


@query(
    "link_density",
    f"""SELECT item_id, round(CASE WHEN length({q.plain_text('content_encoded')}) = 0 THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform(regexp_extract_all(content_encoded, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda a: length({q.plain_text('a')}))), 0) / length({q.plain_text('content_encoded')})) END, 6) AS density
 FROM rss_items WHERE content_encoded IS NOT NULL""",
)
def link_density(spark, d):
    return table(spark, d, "rss_items").where("content_encoded IS NOT NULL").select("item_id", F.round(extract.link_density(F.col("content_encoded")), 6).alias("density"))


_KEY_WORDS = f"list_filter(list_transform(regexp_extract_all(lower(coalesce({{x}}, '')), '([\\p{{{{L}}}}\\p{{{{N}}}}][\\p{{{{L}}}}\\p{{{{N}}}}''’-]*)', 1), lambda w: replace(w, '’', '''')), lambda w: length(w) > 2 AND w NOT IN {q.words_in(extract.KEY_STOP)} AND NOT regexp_matches(w, '^\\d+$'))".replace("{{", "{").replace("}}", "}")


@query(
    "keywords",
    f"""WITH b AS (SELECT row_id, {_KEY_WORDS.replace('{x}', 'content')} AS words, {_KEY_WORDS.replace('{x}', 'title')} AS head FROM news_articles),
x AS (SELECT row_id, len(words) AS total, head, unnest(words) AS word FROM b WHERE len(words) >= 20),
c AS (SELECT row_id, word, round(count(*) / any_value(total) * 1.5 * CASE WHEN any_value(list_contains(head, word)) THEN 2 ELSE 1 END + CASE WHEN count(*) > 1 THEN 0 ELSE -1 END, 9) AS value FROM x GROUP BY 1, 2)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY value DESC, word) AS INTEGER) AS rank, word FROM c WHERE value > 0 QUALIFY rank <= 10""",
)
def keywords(spark, d):
    return extract.keywords(table(spark, d, "news_articles").select("row_id", "title", "content"), "row_id", "content", "title")


@query("summaries")
def summaries(spark, d):
    return extract.summary(table(spark, d, "news_articles").select("row_id", "title", "content"), "row_id", "content", "title")


@query("bylines")
def bylines(spark, d):
    return table(spark, d, "news_articles").select("row_id", F.array_join(extract.authors(F.split("creator", r"\s*;\s*") if dict(table(spark, d, "news_articles").dtypes)["creator"] == "string" else F.col("creator")), "|").alias("authors"))


@query(
    "article_upsert",
    """WITH cur AS (SELECT link, min(title) AS title FROM wire_stories WHERE link IS NOT NULL GROUP BY 1),
ch AS (SELECT link, title, row_id FROM news_articles WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY link ORDER BY row_id DESC) = 1)
SELECT link, title, CAST(-1 AS BIGINT) AS row_id FROM cur WHERE link NOT IN (SELECT link FROM ch) UNION ALL SELECT link, title, row_id FROM ch""",
)
def article_upsert(spark, d):
    current = table(spark, d, "wire_stories").where("link IS NOT NULL").groupBy("link").agg(F.min("title").alias("title"))
    return archive.upsert(current, table(spark, d, "news_articles").select("link", "title", "row_id"), "link", "row_id").select("link", "title", F.coalesce("row_id", F.lit(-1).cast("long")).alias("row_id"))


_BODY = f"left(trim({q.sub(q.blank('descr'), r'\s+', ' ')}), 6000)"


@query(
    "archive_records",
    f"""WITH {STORIES_SQL} SELECT trim(link) AS domain_key, trim(title) AS title, CASE WHEN {_BODY} <> '' THEN {_BODY} ELSE concat(CASE WHEN trim(coalesce(source, '')) <> '' THEN concat(trim(source), ': ') ELSE '' END, trim(title)) END AS content,
 array_to_string(list_filter(list_transform(list_concat([coalesce(source, ''), concat('feed:', CASE WHEN left(regexp_replace(coalesce(feed_id, 'wire'), '(?i)[^a-z0-9_-]', '', 'g'), 40) <> '' THEN left(regexp_replace(coalesce(feed_id, 'wire'), '(?i)[^a-z0-9_-]', '', 'g'), 40) ELSE 'wire' END), coalesce(badge, ''), coalesce(lang, '')], coalesce(categories, [])[1:3]), lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), '|') AS tags,
 CASE WHEN ts > 0 THEN ts ELSE 0 END AS event_time FROM stories WHERE regexp_matches(trim(coalesce(link, '')), '(?i)^https?://') AND trim(coalesce(title, '')) <> ''""",
)
def archive_records(spark, d):
    return archive.archive_records(stories(spark, d)).withColumn("tags", F.array_join("tags", "|")).withColumn("event_time", F.coalesce("event_time", F.lit(0).cast("long")))


@query(
    "archive_ingest",
    f"""WITH {STORIES_SQL}, rec AS (SELECT trim(link) AS k, trim(title) AS title, ts, left(trim({q.sub(q.blank('descr'), r'\s+', ' ')}), 6000) AS body, trim(coalesce(source, '')) AS source FROM stories WHERE regexp_matches(trim(coalesce(link, '')), '(?i)^https?://') AND trim(coalesce(title, '')) <> ''),
r AS (SELECT k, title, CASE WHEN body <> '' THEN body ELSE concat(CASE WHEN source <> '' THEN concat(source, ': ') ELSE '' END, title) END AS content, CASE WHEN ts > 0 THEN ts ELSE 0 END AS t FROM rec),
f AS (SELECT k, arg_max(title, (t, title, content)) AS title, arg_max(content, (t, title, content)) AS content FROM r GROUP BY 1),
o AS (SELECT trim(link) AS k, max((title, description)) AS v FROM (SELECT link, coalesce(title, '') AS title, coalesce(description, '') AS description FROM news_articles WHERE link IS NOT NULL) GROUP BY 1)
SELECT f.k AS domain_key, CASE WHEN v IS NULL THEN 'captured' WHEN v[1] <> f.title OR v[2] <> f.content THEN 'updated' ELSE 'unchanged' END AS status FROM f LEFT JOIN o ON f.k = o.k""",
)
def archive_ingest(spark, d):
    known = table(spark, d, "news_articles").where("link IS NOT NULL").select(F.trim("link").alias("domain_key"), t.blank(F.col("title")).alias("title"), t.blank(F.col("description")).alias("content"), F.lit(0).cast("long").alias("event_time"))
    return archive.ingest(known, archive.archive_records(stories(spark, d)))


@query("wire_snapshot", f"WITH {STORIES_SQL} SELECT ord, ts FROM stories WHERE {NOW_MS} - coalesce(ts, 0) <= {365 * 86_400_000} ORDER BY ts DESC, ord LIMIT 500")
def wire_snapshot(spark, d):
    return archive.snapshot(stories(spark, d), NOW_MS, days=365).select("ord", "ts")


@query(
    "read_marks",
    "WITH f AS (SELECT user_id, event_type AS item, min(ts) AS seen_at FROM events GROUP BY 1, 2) SELECT user_id, item, seen_at FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen_at DESC, item DESC) <= 3",
)
def read_marks(spark, d):
    return archive.read_marks(table(spark, d, "events").select("user_id", F.col("event_type").alias("item"), "ts"), 3)


@query(
    "vote_weights",
    "WITH s AS (SELECT user_id AS key, list(CASE WHEN value >= 50 THEN 1 ELSE -1 END ORDER BY ts, event_id) AS dirs FROM events GROUP BY 1), h AS (SELECT key, list_reduce(list_prepend(0, dirs), lambda a, x: greatest(-5, least(5, a + x))) AS weight FROM s) SELECT key, CAST(weight AS INTEGER) AS weight FROM h WHERE weight <> 0",
)
def vote_weights(spark, d):
    votes = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.unix_millis(F.col("ts").cast("timestamp")) * 1).alias("ts"), F.when(F.col("value") >= 50, 1).otherwise(-1).alias("dir"))
    return archive.vote_weights(votes)


@query("moon", f"WITH {STORIES_SQL}, m AS (SELECT ord, ((ts - 947182440000) / 86400000.0) AS x FROM stories WHERE ts > 0), y AS (SELECT ord, x - {weather.SYNODIC} * floor(x / {weather.SYNODIC}) AS a FROM m) SELECT ord, round(a, 4) AS age, round((1 - cos(2 * pi() * a / {weather.SYNODIC})) / 2, 4) AS lit FROM y")
def moon(spark, d):
    return stories(spark, d).where("ts > 0").select("ord", weather.moon_phase(F.col("ts")).alias("m")).select("ord", "m.age", "m.lit")


@query("body_carry_over", f"WITH {STORIES_SQL}, old AS (SELECT link, max(image_url) AS im FROM news_articles GROUP BY 1) SELECT ord, coalesce(nullif(image_url, ''), im) AS image_url FROM stories LEFT JOIN old USING (link)")
def body_carry_over(spark, d):
    return archive.carry_over(stories(spark, d).select("ord", "link", "image_url"), table(spark, d, "news_articles").select("link", "image_url"), "link", "image_url").select("ord", "image_url")


@query("feeds_replaced", f"WITH {STORIES_SQL}, fresh AS (SELECT ord, feed_id FROM stories WHERE breaking = 1) SELECT ord, feed_id FROM stories WHERE feed_id NOT IN (SELECT feed_id FROM fresh) UNION ALL SELECT ord, feed_id FROM fresh")
def feeds_replaced(spark, d):
    base = stories(spark, d).where("feed_id IS NOT NULL").select("ord", "feed_id", "breaking")
    return archive.replace_feeds(base.select("ord", "feed_id"), base.where("breaking = 1").select("ord", "feed_id"))
