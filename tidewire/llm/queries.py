"""Queries of the llm operators over the tables of the news wire."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.functions.urls import TRACKING
from tidewire.llm import boilerplate, history, leakage, neardup, pii, sitelines, tokenizer, truncation
from tidewire.queries import query
from tidewire.session import table


def descriptions(spark, d) -> DataFrame:
    items = table(spark, d, "rss_items").select(F.lit("rss_items").alias("rec_table"), F.col("item_id").alias("rec_id"), "source_id", F.lit("description").alias("column_name"), F.col("description").alias("text"))
    articles = table(spark, d, "news_articles").select(F.lit("news_articles").alias("rec_table"), F.col("row_id").alias("rec_id"), "source_id", F.lit("description").alias("column_name"), F.col("description").alias("text"))
    return items.unionByName(articles)


@query("p1_found")
def p1_found(spark, d):
    return truncation.find_truncated(descriptions(spark, d)).select("rec_table", "rec_id").distinct()


@query("p1_sources")
def p1_sources(spark, d):
    """Each source's share of cut texts, by table."""
    values = descriptions(spark, d)
    cut = truncation.find_truncated(values).groupBy("rec_table", "source_id").agg(F.count(F.lit(1)).alias("n_cut"), F.count_if(F.col("evidence") == "spike").alias("n_at_spike"), F.count_if(F.col("evidence") == "run_up").alias("n_in_run_up"))
    every = values.groupBy("rec_table", "source_id").agg(F.count("text").alias("n_texts"))
    c, e = cut.alias("c"), every.alias("e")
    joined = e.join(c, (F.col("e.rec_table") == F.col("c.rec_table")) & F.col("e.source_id").eqNullSafe(F.col("c.source_id")), "left")
    n = F.coalesce("c.n_cut", F.lit(0))
    return joined.select("e.rec_table", "e.source_id", "e.n_texts", n.alias("n_cut"), F.coalesce("c.n_at_spike", F.lit(0)).alias("n_at_spike"), F.coalesce("c.n_in_run_up", F.lit(0)).alias("n_in_run_up"), F.when(F.col("e.n_texts") > 0, F.round(n / F.col("e.n_texts"), 6)).alias("share"))


def bodies(spark, d) -> DataFrame:
    items = table(spark, d, "rss_items").select(F.lit("rss_items").alias("rec_table"), F.col("item_id").alias("rec_id"), "title", F.col("content_encoded").alias("body"), F.lit(True).alias("is_html"))
    articles = table(spark, d, "news_articles").select(F.lit("news_articles").alias("rec_table"), F.col("row_id").alias("rec_id"), "title", F.col("content").alias("body"), F.lit(False).alias("is_html"))
    return items.unionByName(articles)


def wording(spark, d) -> boilerplate.Wording:
    """The words of what stands around stories, from the trees of the item pages."""
    return boilerplate.learn_wording(bodies(spark, d).where("is_html"))


@query("p2_found")
def p2_found(spark, d):
    return boilerplate.furniture_lines(bodies(spark, d), wording(spark, d))


@query("p2_main_text")
def p2_main_text(spark, d):
    return boilerplate.main_text(bodies(spark, d), wording(spark, d))


@query("p3_found")
def p3_found(spark, d):
    return neardup.group_pairs(neardup.near_duplicate_groups(table(spark, d, "news_articles"), wording(spark, d)))


@query("p3_groups")
def p3_groups(spark, d):
    """One row per article with words: its group."""
    return neardup.near_duplicate_groups(table(spark, d, "news_articles"), wording(spark, d))


P5_SQL = rf"""
WITH a AS (
  SELECT -1 AS ord, n.source_id, guid, trim(link, ' ' || chr(10) || chr(9)) AS link, title, coalesce(n.source_name, f.source_name, '') AS outlet FROM news_articles n LEFT JOIN feeds f USING (source_id)
  UNION ALL SELECT item_id, i.source_id, guid, trim(link, ' ' || chr(10) || chr(9)), title, coalesce(f.source_name, '') FROM rss_items i LEFT JOIN feeds f USING (source_id)),
b AS (SELECT ord, source_id, nullif(regexp_replace(guid, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '') AS guid,
  regexp_replace(lower(regexp_extract(link, '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^((www\d?|m|mobile|amp)\.)+([^.]+\.)', '\3') AS host,
  regexp_replace(regexp_extract(link, '^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(regexp_replace(link, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:{TRACKING})(=|$)'))) AS pars,
  regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS w, regexp_extract_all(lower(outlet), '[\p{{L}}\p{{N}}]+') AS o FROM a),
c AS (SELECT ord, source_id, guid, CASE WHEN host <> '' THEN concat(host, path, '?', array_to_string(pars, '&')) END AS page,
  CASE WHEN len(o) > 0 AND len(w) > len(o) AND w[len(w) - len(o) + 1:] = o THEN w[:len(w) - len(o)] ELSE w END AS w FROM b),
s AS (SELECT list_sort(list_distinct(w)) AS w, min(ord) AS first, max(ord) AS last FROM c WHERE len(w) >= 5 GROUP BY 1),
sid AS (SELECT row_number() OVER () AS id, * FROM s), x AS (SELECT id, unnest(w) AS t FROM sid),
pr AS (SELECT p.id AS a, q.id AS b, count(*) AS n FROM x p JOIN x q ON p.t = q.t AND p.id <> q.id GROUP BY 1, 2),
near AS (SELECT a, min(q.first) AS e FROM pr JOIN sid p ON p.id = a JOIN sid q ON q.id = b WHERE n * 5 >= 4 * (len(p.w) + len(q.w) - n) GROUP BY 1),
tf AS (SELECT w, least(first, coalesce(e, first)) AS m FROM sid LEFT JOIN near ON a = id)
SELECT DISTINCT ord AS item_id FROM (
  SELECT c.ord FROM c JOIN (SELECT source_id, guid, min(ord) AS m FROM c WHERE guid IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2) g ON c.source_id = g.source_id AND c.guid = g.guid WHERE c.ord > m
  UNION ALL SELECT c.ord FROM c JOIN (SELECT page, min(ord) AS m FROM c WHERE page IS NOT NULL GROUP BY 1) g ON c.page = g.page WHERE c.ord > m
  UNION ALL SELECT c.ord FROM c JOIN tf ON list_sort(list_distinct(c.w)) = tf.w WHERE len(c.w) >= 5 AND c.ord > m) z
"""


@query("p5_found", P5_SQL)
def p5_found(spark, d):
    feeds = table(spark, d, "feeds")
    old = history.arrivals(table(spark, d, "news_articles"), feeds, "row_id", True)
    new = history.arrivals(table(spark, d, "rss_items"), feeds, "item_id", False)
    return history.repeats(old, new).select(F.col("id").alias("item_id"))


P6_SQL = r"""
WITH lines AS (
  SELECT row_id, source_name, CAST(i AS INTEGER) AS line_no,
         lower(trim(regexp_replace(parts[i], '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))) AS k
  FROM (SELECT row_id, source_name, string_split(content, chr(10)) AS parts FROM news_articles WHERE source_name IS NOT NULL AND content IS NOT NULL) a,
       unnest(generate_series(1, len(parts))) AS g(i)),
often AS (SELECT source_name, k FROM lines WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 6)
SELECT row_id, line_no FROM lines JOIN often USING (source_name, k)
"""


@query("p6_found", P6_SQL)
def p6_found(spark, d):
    return sitelines.frequent_lines(table(spark, d, "news_articles"))[1].select("row_id", "line_no")


@query("p6_sequences")
def p6_sequences(spark, d):
    """How many sequences of each length a source repeats."""
    found = sitelines.frequent_sequences(table(spark, d, "news_articles"))[0]
    return found.groupBy("source_name", "length").agg(F.count(F.lit(1)).alias("n_sequences"), F.max("n_docs").alias("most_docs"))


@query("p6_clean")
def p6_clean(spark, d):
    docs = table(spark, d, "news_articles")
    return sitelines.strip_lines(docs, sitelines.frequent_lines(docs)[1])


@query("p7_ids")
def p7_ids(spark, d):
    return tokenizer.encode_corpus(table(spark, d, "documents"))


@query("p7_round_trip", "SELECT doc_id, true AS same FROM documents")
def p7_round_trip(spark, d):
    """Whether decoding gives back each text (null counts as empty)."""
    docs = table(spark, d, "documents")
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


P8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(item_text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 14], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 14)) AS t(k)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 14], ' ') AS g FROM i, unnest(generate_series(1, len(w) - 14)) AS t(k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


@query("p8_found", P8_SQL)
def p8_found(spark, d):
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("exact_words >= 15").select("doc_id", "item_id").distinct()


@query("p8_tolerant")
def p8_tolerant(spark, d):
    """Passages with substituted words: their longest exact run and their length with one substitution in eight words."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("exact_words < 15")


P8_SHORT_SQL = r"""
WITH d AS (SELECT doc_id, concat(' ', array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' '), ' ') AS t FROM documents WHERE text <> ''),
i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(item_text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL)
SELECT doc_id, item_id FROM d JOIN i ON len(w) BETWEEN 1 AND 14 AND contains(t, concat(' ', array_to_string(w, ' '), ' '))
"""


@query("p8_short", P8_SHORT_SQL)
def p8_short(spark, d):
    """Items of fewer than 15 words that stand whole in a document."""
    return leakage.short_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_items")
def p8_items(spark, d):
    """Which test items leaked, into how many documents, exactly or with substituted words."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_if(F.col("exact_words") >= 15).alias("n_exact"), F.count(F.lit(1)).alias("n_docs"), F.max("tolerant_words").alias("longest"))


@query("p9_found")
def p9_found(spark, d):
    docs = table(spark, d, "documents")
    return pii.find(docs, pii.fit(docs, table(spark, d, "given_names")))


@query("p9_redacted")
def p9_redacted(spark, d):
    docs = table(spark, d, "documents")
    return pii.redact(docs, pii.fit(docs, table(spark, d, "given_names")))
