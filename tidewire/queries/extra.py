"""Queries of labels, pictures, briefings and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import labels, media, text as t
from tidewire.functions.urls import TRACKING, page_key, site_host
from tidewire.operators import brief, search
from tidewire.plans.wire import NOW_MS, STORIES_SQL, stories
from tidewire.queries import query, sqltext as q
from tidewire.session import table

_T = f"(CASE WHEN coalesce(ts, 0) > {NOW_MS + 300_000} THEN {NOW_MS} ELSE coalesce(ts, 0) END)"
_S = f"CAST(greatest(0, floor(({NOW_MS} - {_T}) / 1000)) AS BIGINT)"


@query("age_labels", f"WITH {STORIES_SQL} SELECT ord, CASE WHEN {_T} = 0 THEN '' WHEN {_S} < 5 THEN 'just now' WHEN {_S} < 60 THEN concat({_S}, 's ago') WHEN {_S} < 3600 THEN concat({_S} // 60, 'm ago') WHEN {_S} < 86400 THEN concat({_S} // 3600, 'h ago') ELSE strftime(make_timestamp({_T} * 1000), '%b %-d') END AS age FROM stories")
def age_labels(spark, d):
    return stories(spark, d).select("ord", labels.age_label(F.col("ts"), NOW_MS).alias("age"))


def _language_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({x}, ''), '{m}') THEN '{n}'" for n, m in labels.LANGUAGE_MARKS) + " ELSE 'en' END"


@query("languages", f"SELECT lang, {_language_sql('text')} AS guessed, count(*) AS n FROM documents GROUP BY 1, 2")
def languages(spark, d):
    return table(spark, d, "documents").groupBy("lang", labels.language(F.col("text")).alias("guessed")).agg(F.count(F.lit(1)).alias("n"))


@query("image_keys", f"WITH {STORIES_SQL}, k AS (SELECT {q.sub(q.sub('lower(' + q.sub(q.blank('image_url'), '^[a-zA-Z]+://') + ')', '[?#].*$'), r'/(?:w|h|width|height)[_=-]?\d{2,4}/', '/')} AS image_key FROM stories WHERE image_url IS NOT NULL) SELECT image_key, count(*) AS n FROM k GROUP BY 1")
def image_keys(spark, d):
    return stories(spark, d).where("image_url IS NOT NULL").groupBy(media.image_key(F.col("image_url")).alias("image_key")).agg(F.count(F.lit(1)).alias("n"))


POOL = ["p0", "p1", "p2", "p3", "p4", "p5", "p6", "p7"]


@query(
    "fallback_images",
    f"""WITH {STORIES_SQL} SELECT ord, CASE WHEN regexp_matches(coalesce(image_url, ''), '(?i)^https?://') THEN image_url WHEN list_contains(coalesce(categories, []), 'Science') OR list_contains(coalesce(categories, []), 'Music') THEN
 CASE WHEN coalesce(list_position(categories, 'Science'), 0) > 0 AND (coalesce(list_position(categories, 'Music'), 0) = 0 OR list_position(categories, 'Science') < list_position(categories, 'Music')) THEN 's' ELSE 'm' END
 ELSE concat('p', list_sum(list_transform(string_split(id, ''), lambda c: ascii(c))) % 8) END AS image FROM stories""",
)
def fallback_images(spark, d):
    return stories(spark, d).select("ord", media.fallback_image(F.col("image_url"), F.col("categories"), {"Science": "s", "Music": "m"}, POOL, F.col("id")).alias("image"))


@query("rows_without_image", "SELECT row_id FROM news_articles WHERE (coalesce(image_url, '') = '' OR regexp_matches(image_url, '(?i)placeholder|unsplash\\.com|picsum')) AND coalesce(link, '') <> ''")
def rows_without_image(spark, d):
    return table(spark, d, "news_articles").where(media.needs_image(F.col("image_url"), F.col("link"))).select("row_id")


PAGE_REPEATS_SQL = rf"""
WITH a AS (SELECT source_id, trim(link, ' ' || chr(10) || chr(9)) AS link FROM rss_items),
b AS (SELECT source_id, regexp_replace(lower(regexp_extract(link, '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^((www\d?|m|mobile|amp)\.)+([^.]+\.)', '\3') AS host,
  regexp_replace(regexp_extract(link, '^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(regexp_replace(link, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:{TRACKING})(=|$)'))) AS pars FROM a)
SELECT page, count(*) AS n, count(DISTINCT source_id) AS sources FROM (SELECT source_id, concat(host, path, '?', array_to_string(pars, '&')) AS page FROM b WHERE host <> '') x GROUP BY 1 HAVING count(*) > 1
"""


@query("page_repeats", PAGE_REPEATS_SQL)
def page_repeats(spark, d):
    """Pages that several items link to, and from how many sources."""
    items = table(spark, d, "rss_items").select("source_id", page_key(F.col("link")).alias("page")).where("page IS NOT NULL")
    return items.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources")).where("n > 1")


@query("hosts", "SELECT DISTINCT regexp_replace(regexp_replace(lower(regexp_extract(trim(u), '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^((www\\d?|m|mobile|amp)\\.)+([^.]+\\.)', '\\3'), '^$', '') AS host FROM (SELECT link AS u FROM news_articles UNION ALL SELECT feed_url FROM feeds) x WHERE regexp_extract(trim(u), '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1) <> ''")
def hosts(spark, d):
    urls = table(spark, d, "news_articles").select(F.col("link").alias("u")).union(table(spark, d, "feeds").select("feed_url"))
    return urls.select(site_host(F.col("u")).alias("host")).where("host IS NOT NULL").distinct()


ALLOWED = ["Science", "Music", "Sport", "World"]


@query(
    "category_merge",
    "WITH a AS (SELECT row_id, list_filter(coalesce(category, []), lambda c: c IN ('Science', 'Music', 'Sport', 'World')) AS k FROM news_articles) SELECT row_id, CASE WHEN len(k) > 0 THEN k[1] ELSE 'Other' END AS first FROM a",
)
def category_merge(spark, d):
    merged = labels.merged_categories(F.col("category"), F.array().cast("array<string>"), ALLOWED)
    return table(spark, d, "news_articles").select("row_id", merged[0].alias("first"))


@query(
    "topic_map",
    f"""WITH {STORIES_SQL}, x AS (SELECT ord AS k, lower(coalesce(source, '')) AS o, 'name' AS kind, unnest(regexp_extract_all(coalesce(descr, ''), '{brief.NAME.replace(chr(39), chr(39) * 2)}', 1)) AS item FROM stories
 UNION ALL SELECT ord, lower(coalesce(source, '')), 'figure', unnest(regexp_extract_all(coalesce(descr, ''), '{brief.FIGURE}', 1)) FROM stories),
y AS (SELECT DISTINCT k, o, kind, regexp_replace(item, '\\s+', ' ', 'g') AS item FROM x)
SELECT kind, item, count(DISTINCT k) AS n_sources, count(DISTINCT o) AS n_outlets, count(DISTINCT o) >= 2 AS confirmed FROM y GROUP BY 1, 2""",
)
def topic_map(spark, d):
    return brief.topic_map(stories(spark, d), "ord", "descr", "source")


@query(
    "wire_ranking",
    f"""WITH {STORIES_SQL}, r AS (SELECT ord, ts, CASE WHEN contains(lower(coalesce(title, '')), 'museum') THEN 2 WHEN contains(lower(concat_ws(' ', title, descr)), 'museum') THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(title, '')), 'battery') THEN 2 WHEN contains(lower(concat_ws(' ', title, descr)), 'battery') THEN 1 ELSE 0 END AS score, report_count FROM stories)
SELECT ord, score FROM r WHERE score > 0 ORDER BY score DESC, report_count DESC, ts DESC, ord LIMIT 8""",
)
def wire_ranking(spark, d):
    """The eight most relevant stories for a question (a top-k report)."""
    score, _ = search.relevance(["museum", "battery"], F.col("title"), F.concat_ws(" ", "title", "descr"))
    scored = stories(spark, d).select("ord", "ts", "report_count", score.alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("report_count"), F.desc("ts"), "ord").limit(8).select("ord", "score")


@query("library_titles")
def library_titles(spark, d):
    """Distinct terms that story titles would give a library."""
    named = stories(spark, d).select("ord", labels.library_title(F.col("title")).alias("term")).where(labels.is_library_term(F.col("term")))
    return named.groupBy(F.lower("term").alias("key")).agg(F.min_by("term", "ord").alias("term"))


@query(
    "capped_outlets",
    f"""WITH {STORIES_SQL}, c AS (SELECT ord, coalesce(ts, 0) AS position, CASE WHEN contains(lower(coalesce(source, '')), 'gazette') THEN 0 WHEN contains(lower(coalesce(source, '')), 'signal') THEN 1 END AS cap FROM stories),
k AS (SELECT ord, cap, row_number() OVER (PARTITION BY cap ORDER BY position, ord) AS k, (SELECT count(*) FROM c) AS n FROM c)
SELECT ord, cap IS NOT NULL AND k > greatest(1, floor(CASE cap WHEN 0 THEN 0.02 ELSE 0.05 END * n)) AS capped FROM k""",
)
def capped_outlets(spark, d):
    ranked = stories(spark, d).select("ord", "source", F.coalesce("ts", F.lit(0)).alias("position"))
    return brief.cap_outlets(ranked, [("gazette", 0.02), ("signal", 0.05)])


@query("content_thinness")
def content_thinness(spark, d):
    return table(spark, d, "rss_items").select("item_id", t.thinness(F.col("content_encoded"), F.col("description")).alias("thinness"))


@query("page_facts")
def page_facts(spark, d):
    from tidewire.operators import pages

    facts = pages.page_facts(table(spark, d, "rss_items").select("item_id", "content_encoded"), "item_id", "content_encoded")
    return facts.select("item_id", F.length("article").alias("article_chars"), "headline", "image")
