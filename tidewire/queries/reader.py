"""Queries of the reader's operators: patterns, ids, addresses, cleaning, speech, alerts in force, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import media
from tidewire.operators import rank, reader
from tidewire.plans.wire import NOW_MS, STORIES_SQL, stories
from tidewire.queries import ORACLE, query, sqltext as q
from tidewire.queries.wire import RULES
from tidewire.session import table

PATTERN_SQL = f"CASE WHEN coalesce(len(media_contents), 0) = 0 AND {q.word_count(q.plain_text('content_encoded'))} > 200 THEN 'B' ELSE 'A' END"
SEARCH = "https://search.example/?q="
PAGES = {"s01": "https://s01.example/author/{}/", "s02": "https://s02.example/by/{}"}


def encoded_sql(x: str) -> str:
    out = f"url_encode(coalesce({x}, ''))"
    for code, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


@query("feed_patterns", f"SELECT item_id, {PATTERN_SQL} AS feed_pattern FROM rss_items")
def feed_patterns(spark, d):
    return table(spark, d, "rss_items").select("item_id", reader.feed_pattern(F.col("media_contents"), F.col("content_encoded")).alias("feed_pattern"))


@query(
    "generated_ids",
    """SELECT item_id, CASE WHEN coalesce(post_id, '') <> '' THEN concat(source_id, '-post-', post_id) WHEN coalesce(guid, '') <> '' THEN source_id || '-guid-' || right(regexp_replace(guid, '(?i)[^a-z0-9]', '-', 'g'), 40)
 WHEN coalesce(link, '') <> '' THEN source_id || '-url-' || right(regexp_replace(link, '(?i)[^a-z0-9]', '-', 'g'), 40) END AS id FROM rss_items""",
)
def generated_ids(spark, d):
    return table(spark, d, "rss_items").select("item_id", reader.generated_id(F.col("source_id"), F.col("post_id"), F.col("guid"), F.col("link")).alias("id"))


@query(
    "author_urls",
    f"""SELECT item_id, CASE WHEN source_id = 's01' THEN concat('https://s01.example/author/', slug, '/') WHEN source_id = 's02' THEN concat('https://s02.example/by/', slug) ELSE concat('{SEARCH}', {encoded_sql("concat(coalesce(creator, ''), ' ', coalesce(source_id, ''))")}) END AS author_url
 FROM (SELECT *, regexp_replace(regexp_replace(lower(coalesce(creator, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM rss_items) x""",
)
def author_urls(spark, d):
    return table(spark, d, "rss_items").select("item_id", reader.author_url(F.col("creator"), F.col("source_id"), PAGES, SEARCH).alias("author_url"))


@query(
    "place_feeds",
    f"""SELECT source_id, query, concat('https://news.example/geo/', {encoded_sql('query')}) AS url FROM (SELECT source_id, CASE WHEN trim(coalesce(source_name, '')) = '' THEN '' WHEN trim(coalesce(section_name, '')) <> '' AND NOT contains(lower(trim(source_name)), lower(trim(section_name)))
 THEN concat(trim(source_name), ', ', trim(section_name)) ELSE trim(source_name) END AS query FROM feeds) x""",
)
def place_feeds(spark, d):
    """The local feed of a place and region, with the names of feeds standing for places."""
    of = reader.place_query(F.col("source_name"), F.col("section_name"))
    return table(spark, d, "feeds").select("source_id", of.alias("query"), F.concat(F.lit("https://news.example/geo/"), reader.encoded(of)).alias("url"))


@query("link_checks", rf"SELECT row_id, regexp_matches(coalesce(link, ''), '(?i)^\s*https?://[^\s/?#]+') AS valid, CASE WHEN regexp_matches(coalesce(link, ''), '%[0-9A-Fa-f]{{2}}') THEN url_decode(link) ELSE coalesce(link, '') END AS url FROM news_articles")
def link_checks(spark, d):
    return table(spark, d, "news_articles").select("row_id", reader.is_web_url(F.col("link")).alias("valid"), reader.decoded_url(F.col("link")).alias("url"))


_BODY, _LEAD = q.plain_text("content_encoded"), q.plain_text("description")
THIN_SQL = f"""CASE WHEN regexp_matches(coalesce(content_encoded, ''), '(?i)<(?:p|div|article|section)\\b') AND n >= 200 THEN 'full_html' WHEN body = lead AND body <> '' THEN 'duplicates_description'
 WHEN lead <> '' AND length(lead) >= 80 AND starts_with(body, left(lead, 80)) AND n < 120 THEN 'starts_with_description' WHEN n < 80 THEN 'too_short' ELSE 'sufficient' END"""
_BODIES = f"b AS (SELECT *, {q.word_count('body')} AS n FROM (SELECT *, {_BODY} AS body, {_LEAD} AS lead FROM rss_items) x)"


@query(
    "enrichment_rows",
    f"""WITH {_BODIES}, e AS (SELECT item_id, link AS url, source_id AS feed_source, {PATTERN_SQL} AS feed_pattern, left(lead, 500) AS description, {THIN_SQL} AS thinness, CAST(coalesce(len(categories), 0) AS INTEGER) AS n_categories FROM b)
SELECT *, thinness NOT IN ('full_html', 'sufficient') AS is_thin, thinness NOT IN ('full_html', 'sufficient') AND feed_pattern = 'A' AS scrape_needed FROM e""",
)
def enrichment_rows(spark, d):
    return reader.for_enrichment(table(spark, d, "rss_items"), F.col("source_id"))


ORACLE["content_thinness"] = f"WITH {_BODIES} SELECT item_id, {THIN_SQL} AS thinness FROM b"

ALLOWED = ["World", "Culture", "Sport", "Business", "Science"]


@query(
    "enrichment_merged",
    f"""WITH m AS (SELECT i.item_id, i.title, a.summary, a.sentiment, list_filter(list_distinct_in_order, lambda c: c IN ({", ".join(f"'{x}'" for x in ALLOWED)})) AS kept FROM rss_items i
 LEFT JOIN (SELECT item_id, description AS summary, CASE WHEN item_id % 3 = 0 THEN 'positive' ELSE 'cheerful' END AS sentiment FROM rss_items WHERE item_id % 2 = 0) a USING (item_id),
 LATERAL (SELECT list_filter(cs, lambda c, k: list_position(cs, c) = k) AS list_distinct_in_order FROM (SELECT list_concat(CASE WHEN i.item_id % 2 = 0 THEN ['Science', 'Gossip'] ELSE [] END, coalesce(i.categories, [])) AS cs) y) z)
SELECT item_id, coalesce(title, '(untitled)') AS title, summary, array_to_string(CASE WHEN len(kept) > 0 THEN kept[:3] ELSE ['Other'] END, '|') AS category, CASE WHEN sentiment = 'positive' THEN 'positive' ELSE 'neutral' END AS sentiment FROM m""",
)
def enrichment_merged(spark, d):
    """Every second item with an answer that adds two categories, one of them not allowed, and a sentiment, known or not."""
    items = table(spark, d, "rss_items")
    answers = items.where("item_id % 2 = 0").select("item_id", F.col("description").alias("summary"), F.array(F.lit("Science"), F.lit("Gossip")).alias("categories"), F.when(F.col("item_id") % 3 == 0, "positive").otherwise("cheerful").alias("sentiment"))
    return reader.merged(items, answers, ALLOWED).withColumn("category", F.array_join("category", "|"))


_SHOWN = r"trim(regexp_replace(regexp_replace(l, '[\s\x{A0}]+', ' ', 'g'), '^#{1,6}\s+', ''))"
_KIND = f"CASE WHEN s = '' THEN '' WHEN length(s) < 60 AND regexp_matches(s, '{reader.TAIL_HEAD.replace(chr(39), chr(39) * 2)}') THEN 'tail' WHEN regexp_matches(s, '{reader.AD_LABELS}') THEN 'ad' WHEN length(s) < 80 AND regexp_matches(s, '{reader.PAGE_CHROME}') THEN 'chrome' ELSE 'text' END"


@query(
    "cleaned_articles",
    f"""WITH l AS (SELECT row_id, i, {_SHOWN} AS s, l FROM (SELECT row_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS l FROM (SELECT row_id, string_split(content, chr(10)) AS p FROM news_articles WHERE content IS NOT NULL) a) b),
k AS (SELECT row_id, i, l, {_KIND} AS kind FROM l), o AS (SELECT row_id, min(i) FILTER (kind <> '') AS opens, max(i) AS n FROM k GROUP BY 1),
c AS (SELECT o.row_id, o.n, min(k.i) FILTER (k.kind = 'tail' AND k.i > o.opens) AS cut FROM o JOIN k USING (row_id) GROUP BY 1, 2)
SELECT row_id, md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (kind IN ('', 'text', 'tail') AND (cut IS NULL OR i < cut)), '')) AS digest, CAST(count(*) FILTER (kind = 'ad' AND (cut IS NULL OR i < cut)) AS INTEGER) AS n_ads,
 CAST(count(*) FILTER (kind = 'chrome' AND (cut IS NULL OR i < cut)) AS INTEGER) AS n_chrome, CAST(coalesce(any_value(n) - any_value(cut) + 1, 0) AS INTEGER) AS n_tail FROM k JOIN c USING (row_id) GROUP BY 1""",
)
def cleaned_articles(spark, d):
    return reader.cleaned(table(spark, d, "news_articles"), "row_id", "content").select("row_id", F.md5("body").alias("digest"), "n_ads", "n_chrome", "n_tail")


@query("body_pictures")
def body_pictures(spark, d):
    """Pictures of item pages, without the first media picture and repeats."""
    items = table(spark, d, "rss_items").select("item_id", "content_encoded", F.get("media_contents", F.lit(0))["url"].alias("lead"))
    return reader.body_images(items, "item_id", "content_encoded", "lead", media.image_key)


def _speech_sql(x: str) -> str:
    s = q.sub(q.blank(x), r"(?is)<figure[^>]*>.*?</figure>|<figcaption[^>]*>.*?</figcaption>", " ")
    s = q.sub(q.sub(s, r"(?i)</(?:p|h[1-6]|li|blockquote|div)>", ". "), r"(?i)<br\s*/?>", ". ")
    return f"trim({q.sub(q.sub(q.plain_text(s), r'\s+([.,;:!?])', chr(92) + '1'), r'([.!?…])(?:\s*\.)+', chr(92) + '1')})"


@query("speech_texts", f"SELECT item_id, md5({_speech_sql('content_encoded')}) AS digest FROM rss_items")
def speech_texts(spark, d):
    return table(spark, d, "rss_items").select("item_id", F.md5(reader.speech_text(F.col("content_encoded"))).alias("digest"))


@query("quick_briefs")
def quick_briefs(spark, d):
    return table(spark, d, "rss_items").select("item_id", reader.quick_brief(F.col("title"), F.col("description")).alias("brief"))


@query("speech_pieces")
def speech_pieces(spark, d):
    """How many pieces of at most 650 characters a page is read in."""
    spoken = reader.speech_text(F.col("content_encoded"))
    return table(spark, d, "rss_items").select("item_id", F.size(reader.grouped_sentences(F.split(spoken, reader.SENTENCE_GAP))).alias("pieces"))


@query(
    "rule_stats",
    "WITH r AS (" + ORACLE["word_rules"] + ") SELECT count(*) FILTER (muted) AS muted, count(*) FILTER (NOT muted AND rule_score > 0) AS raised, count(*) FILTER (NOT muted AND rule_score < 0) AS lowered, count(*) FILTER (NOT muted AND flagged) AS flagged FROM r",
)
def rule_stats(spark, d):
    return reader.rule_stats(rank.word_rules(stories(spark, d), RULES, {"the quill wire": -4, "granite report": 1}, {"tribunal": 3, "museum": -2}))


@query(
    "vote_signals",
    f"""WITH {STORIES_SQL}, v AS (SELECT ord AS story_id, lower(coalesce(source, '')) AS outlet, CASE WHEN length(coalesce(title, '')) % 3 = 0 THEN -1 ELSE 1 END AS dir, coalesce(ts, 0) AS "at" FROM stories),
n AS (SELECT * FROM v ORDER BY "at" DESC, story_id LIMIT 500),
w AS (SELECT 'outlets' AS kind, outlet AS key, CAST(greatest(-5, least(5, sum(dir))) AS INTEGER) AS weight FROM n GROUP BY 2)
SELECT kind, key, weight, CAST(row_number() OVER (ORDER BY abs(weight) DESC, kind, key) AS INTEGER) AS rank FROM w WHERE abs(weight) >= 2""",
)
def vote_signals(spark, d):
    """One vote a story, against it where the title's length is a multiple of three."""
    votes = stories(spark, d).select(F.col("ord").alias("story_id"), F.lower(F.coalesce("source", F.lit(""))).alias("outlet"), F.array().cast("array<string>").alias("words"), F.when(F.length(F.coalesce("title", F.lit(""))) % 3 == 0, -1).otherwise(1).alias("dir"), F.coalesce("ts", F.lit(0)).alias("at"))
    return reader.vote_signals(votes)


WARNINGS = [(1, "home", "Flood Watch", "Moderate", "Inland County", None, None), (2, "home", "Wind Warning", "Severe", "Coastal Thammiburn; Velmoham", None, NOW_MS - 1), (3, "home", "Storm Warning", "Severe", "Yarrury County, XX", None, NOW_MS + 3_600_000), (4, "home", "Tornado Warning", "Severe", "Kelburn", "Take cover", None)]


@query("warning_in_force", "SELECT 'red' AS level, 'Tornado Warning' AS event, 'Kelburn' AS areas, 'Take cover' AS headline, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS ord")
def warning_in_force(spark, d):
    """Of four warnings (one too weak, one expired, one amber, one red) the red one, with the wire's local coverage."""
    given = spark.createDataFrame(WARNINGS, "pos int, place string, event string, severity string, areas string, headline string, expires_ms long")
    return reader.official_alert(given, stories(spark, d), NOW_MS, "Kelburn")


@query("translated_titles", f"WITH {STORIES_SQL} SELECT ord, CASE WHEN lang = 'de' THEN concat('DE: ', title) ELSE title END AS title FROM stories")
def translated_titles(spark, d):
    base = stories(spark, d)
    # a story's id may stand for several texts: translations are keyed by the text's own order
    return reader.translated(base.withColumn("id", F.col("ord")), base.where("lang = 'de'").select(F.col("ord").alias("id"), F.concat(F.lit("DE: "), "title").alias("title"), "descr")).select("ord", "title")
