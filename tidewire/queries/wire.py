"""Queries over the wire: identities, scores, editions, heat, clusters, alerts, counts and searches."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidewire.functions import text as t
from tidewire.operators import events, rank, search
from tidewire.plans.wire import NOW_MS, STORIES_SQL, feed_sections, stories, stories_in_place
from tidewire.queries import query, sqltext as q
from tidewire.session import BROADCAST_ROWS, cut_lineage, few, table

YEAR_HOURS = 24 * 365
SCORE_SQL = f"round(100 / (1 + {q.age('ts', NOW_MS)} / 6) + CASE WHEN coalesce(image_url, '') <> '' THEN 4 ELSE 0 END - CASE WHEN {q.opinion('title', 'link')} THEN 30 ELSE 0 END, 6)"


@query("title_keys", f"WITH {STORIES_SQL} SELECT ord, {q.title_key('title')} AS title_key, {q.strip_publisher('title')} AS headline, CAST({q.word_count('descr')} AS INTEGER) AS n_words FROM stories")
def title_keys(spark, d):
    return stories(spark, d).select("ord", t.title_key(F.col("title")).alias("title_key"), t.strip_publisher(F.col("title")).alias("headline"), t.word_count(F.col("descr")).alias("n_words"))


@query("story_urls", f"WITH {STORIES_SQL} SELECT ord, {q.story_url('link')} AS url_key, {q.normalised_url('link')} AS url, md5({q.normalised_url('link')}) AS article_id FROM stories")
def story_urls(spark, d):
    return stories(spark, d).select("ord", t.story_url(F.col("link")).alias("url_key"), t.normalised_url(F.col("link")).alias("url"), t.article_id(F.col("link")).alias("article_id"))


@query(
    "article_identity",
    f"SELECT row_id, md5({q.normalised_url('link')}) AS article_key, CAST({q.word_count('content')} AS INTEGER) AS n_words, CAST(greatest(1, floor({q.word_count('content')} / 200 + 0.5)) AS INTEGER) AS minutes FROM news_articles",
)
def article_identity(spark, d):
    return table(spark, d, "news_articles").select("row_id", t.article_id(F.col("link")).alias("article_key"), t.word_count(F.col("content")).alias("n_words"), t.reading_minutes(F.col("content")).alias("minutes"))


@query("opinions", f"WITH {STORIES_SQL} SELECT feed_id, count(*) AS n, CAST(sum(CASE WHEN {q.opinion('title', 'link')} THEN 1 ELSE 0 END) AS BIGINT) AS n_opinion FROM stories GROUP BY 1")
def opinions(spark, d):
    return stories(spark, d).groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(t.is_opinion(F.col("title"), F.col("link"))).alias("n_opinion"))


@query("story_scores", f"WITH {STORIES_SQL} SELECT ord, {SCORE_SQL} AS score FROM stories")
def story_scores(spark, d):
    return rank.score(stories(spark, d), NOW_MS).select("ord", "score")


EDITION_SQL = f"""
WITH {STORIES_SQL}, scored AS (SELECT *, {SCORE_SQL} AS score FROM stories),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS r FROM scored),
front AS (SELECT * FROM ranked WHERE r <= 5),
rest AS (SELECT s.*, coalesce(f.section_name, 'Front page') AS section FROM scored s LEFT JOIN feeds f ON s.feed_id = f.source_id WHERE s.id NOT IN (SELECT id FROM front)),
placed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, ord) AS k FROM rest)
SELECT CASE WHEN r = 1 THEN 'lead' ELSE 'secondary' END AS slot, '' AS section, CAST(CASE WHEN r = 1 THEN 1 ELSE r - 1 END AS INTEGER) AS rank, ord, id, score FROM front
UNION ALL SELECT 'section', section, CAST(k AS INTEGER), ord, id, score FROM placed WHERE k <= 6"""


@query("front_page", EDITION_SQL)
def front_page(spark, d):
    return rank.edition(rank.score(stories(spark, d), NOW_MS), feed_sections(spark, d))


@query(
    "source_cap",
    f"WITH {STORIES_SQL} SELECT ord, row_number() OVER (PARTITION BY {q.outlet('source', 'id')} ORDER BY ord) > 3 AS over FROM stories",
)
def source_cap(spark, d):
    return rank.cap_sources(stories(spark, d)).select("ord", "over")


HEAT_SQL = f"""
WITH {STORIES_SQL},
recent AS (SELECT ord, id, {q.outlet('source', 'id')} AS who, {q.heat_words('title')} AS words FROM stories WHERE {NOW_MS} - coalesce(ts, 0) <= {YEAR_HOURS * 3_600_000}),
x AS (SELECT ord, who, unnest(words) AS w FROM recent),
telling AS (SELECT w FROM x GROUP BY w HAVING count(*) <= greatest(12.0, (SELECT count(*) FROM recent) * 0.25)),
k AS (SELECT x.* FROM x JOIN telling USING (w)),
pairs AS (SELECT a.ord, b.ord AS other, b.who FROM k a JOIN k b ON a.w = b.w AND a.ord <> b.ord GROUP BY 1, 2, 3 HAVING count(*) >= 2),
voices AS (SELECT ord, count(DISTINCT who) AS heat FROM (SELECT ord, who FROM recent UNION ALL SELECT ord, who FROM pairs) GROUP BY 1)
SELECT id, ord, heat FROM recent JOIN voices USING (ord)"""


@query("topic_heat", HEAT_SQL)
def topic_heat(spark, d):
    return rank.topic_heat(stories(spark, d), NOW_MS, window_hours=YEAR_HOURS)


@query(
    "hero_list",
    HEAT_SQL.replace("SELECT id, ord, heat FROM recent JOIN voices USING (ord)", "")
    + f""", hero AS (SELECT s.ord, round(60 / (1 + {q.age('s.ts', NOW_MS)} / 6) + 18 * least(greatest(coalesce(v.heat, 1), greatest(s.report_count, 1)) - 1, 10) - CASE WHEN {q.opinion('s.title', 's.link')} THEN 30 ELSE 0 END, 6) AS hero
 FROM stories s LEFT JOIN voices v USING (ord) WHERE coalesce(s.image_url, '') <> '')
SELECT ord, hero, CAST(row_number() OVER (ORDER BY hero DESC, ord) AS INTEGER) AS position FROM hero QUALIFY position <= 18""",
)
def hero_list(spark, d):
    base = stories(spark, d)
    heat = rank.topic_heat(base, NOW_MS, window_hours=YEAR_HOURS).select("ord", "heat")
    best = rank.hero_score(base.where(F.coalesce("image_url", F.lit("")) != "").join(heat, "ord", "left"), NOW_MS).orderBy(F.desc("hero"), "ord").limit(18).select("ord", "hero")
    return best.withColumn("position", F.row_number().over(W.orderBy(F.desc("hero"), "ord")))


@query("hero_topics")
def hero_topics(spark, d):
    """The topics of the hero list, at most six stories each before the rest."""
    base = stories(spark, d)
    return rank.cap_topics(hero_list(spark, d).join(base.select("ord", "title"), "ord"))


DEDUPE_SQL = f"""
WITH RECURSIVE {STORIES_SQL},
k0 AS (SELECT ord, {q.story_url('link')} AS u, {q.title_key('title')} AS t, coalesce(image_url, '') <> '' AS pictured, length(coalesce(descr, '')) AS size, coalesce(ts, 0) AS ts FROM stories),
k AS (SELECT ord, nullif(u, '') AS u, CASE WHEN length(t) > 12 THEN t END AS t, pictured, size, ts FROM k0),
fu AS (SELECT u, min(ord) AS f FROM k WHERE u IS NOT NULL GROUP BY 1), tb AS (SELECT ord, lag(ord) OVER (PARTITION BY t ORDER BY ord) AS b FROM k WHERE t IS NOT NULL),
p AS (SELECT k.ord, CASE WHEN f < k.ord THEN f ELSE coalesce(b, k.ord) END AS up FROM k LEFT JOIN fu USING (u) LEFT JOIN tb ON tb.ord = k.ord),
r AS (SELECT ord, up FROM p UNION SELECT r.ord, p.up FROM r JOIN p ON r.up = p.ord),
s AS (SELECT ord, min(up) AS slot FROM r GROUP BY 1)
SELECT s.ord, slot, row_number() OVER (PARTITION BY slot ORDER BY pictured DESC, size DESC, ts DESC, s.ord) = 1 AS kept FROM s JOIN k ON k.ord = s.ord"""


@query("dedupe", DEDUPE_SQL)
def dedupe(spark, d):
    return events.dedupe_stories(stories(spark, d))


PAIRS_CTES = f"""
{STORIES_SQL},
base AS (SELECT ord, coalesce(ts, 0) AS ts, {q.cluster_words('title')} AS words, {q.entities('title')} AS names FROM stories),
x AS (SELECT ord, unnest(words) AS w FROM base),
telling AS (SELECT w FROM x GROUP BY w HAVING count(*) <= greatest(30, floor((SELECT count(*) FROM base) * 0.08))),
met AS (SELECT DISTINCT a.ord AS ord_a, b.ord AS ord_b FROM x a JOIN x b ON a.w = b.w AND a.ord < b.ord JOIN telling t ON a.w = t.w),
pairs AS (SELECT ord_a, ord_b FROM met JOIN base a ON a.ord = ord_a JOIN base b ON b.ord = ord_b
  WHERE (a.ts = 0 OR b.ts = 0 OR abs(a.ts - b.ts) <= 129600000) AND len(list_intersect(a.words, b.words)) >= 3 AND {q.jaccard('a.words', 'b.words')} >= 0.5
    AND (len(a.names) < 2 OR len(b.names) < 2 OR {q.jaccard('a.names', 'b.names')} >= 0.5))"""


@query("event_pairs", f"WITH {PAIRS_CTES} SELECT ord_a, ord_b FROM pairs")
def event_pairs(spark, d):
    return events.same_event_pairs(stories(spark, d))


@query(
    "event_clusters",
    f"""WITH RECURSIVE {PAIRS_CTES}, edges AS (SELECT ord_a AS a, ord_b AS b FROM pairs UNION SELECT ord_b, ord_a FROM pairs),
reach AS (SELECT ord AS o, ord AS r FROM stories UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.o),
g AS (SELECT o AS ord, min(r) AS cluster FROM reach GROUP BY 1),
m AS (SELECT s.*, cluster, row_number() OVER (PARTITION BY cluster ORDER BY CAST(NOT {q.opinion('title', 'link')} AS INTEGER) DESC, CAST(coalesce(image_url, '') <> '' AS INTEGER) DESC, length(coalesce(descr, '')) DESC, coalesce(ts, 0) DESC, s.ord) AS k FROM stories s JOIN g USING (ord)),
f AS (SELECT cluster, count(*) AS cluster_size, count(DISTINCT {q.outlet('source', 'id')}) AS outlets FROM m GROUP BY 1)
SELECT ord, cluster, k = 1 AS is_lead, cluster_size, CAST(CASE WHEN cluster_size = 1 THEN report_count ELSE greatest(report_count, outlets) END AS BIGINT) AS report_count FROM m JOIN f USING (cluster)""",
)
def event_clusters(spark, d):
    return events.cluster_stories(stories(spark, d))


@query("alerts")
def alerts(spark, d):
    """Corroborated alerts over a year of the wire."""
    return events.find_alerts(stories(spark, d), NOW_MS, window_ms=YEAR_HOURS * 3_600_000)


@query("alert_kinds", f"WITH {STORIES_SQL} SELECT ord, CASE WHEN regexp_matches(coalesce(title, ''), '{events.DEATH.replace('(?<![A-Za-z0-9_])', chr(92) + 'b').replace('(?![A-Za-z0-9_])', chr(92) + 'b')}') THEN 'death' WHEN regexp_matches(coalesce(title, ''), '{events.EVENT.replace('(?<![A-Za-z0-9_])', chr(92) + 'b').replace('(?![A-Za-z0-9_])', chr(92) + 'b')}') THEN 'event' END AS kind FROM stories")
def alert_kinds(spark, d):
    return stories(spark, d).select("ord", events.kind_of(F.col("title")).alias("kind"))


@query("feed_counts", f"WITH {STORIES_SQL} SELECT coalesce(section_name, 'Front page') AS section, feed_id, count(*) AS n, count(DISTINCT {q.outlet('source', 'id')}) AS outlets, max(ts) AS latest FROM stories LEFT JOIN feeds ON feed_id = source_id GROUP BY 1, 2")
def feed_counts(spark, d):
    joined = stories(spark, d).join(feed_sections(spark, d), "feed_id", "left")
    return joined.groupBy(F.coalesce("section_name", F.lit("Front page")).alias("section"), "feed_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(rank.outlet(F.col("source"), F.col("id"))).alias("outlets"), F.max("ts").alias("latest"))


@query("off_wire", f"WITH {STORIES_SQL} SELECT ord FROM stories WHERE feed_id NOT IN (SELECT source_id FROM feeds WHERE NOT is_wire)")
def off_wire(spark, d):
    """Stories on the wire: those of feeds kept off it are dropped."""
    return stories(spark, d).where("feed_id IS NOT NULL").join(feed_sections(spark, d).where("NOT is_wire"), "feed_id", "left_anti").select("ord")


@query("word_frequency", f"WITH {STORIES_SQL}, x AS (SELECT unnest({q.cluster_words('title')}) AS w FROM stories) SELECT w, count(*) AS df FROM x GROUP BY 1 HAVING count(*) > 1")
def word_frequency(spark, d):
    return stories(spark, d).select(F.explode(t.cluster_words(F.col("title"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1")


TERMS = ["battery", "Transit", "streaming-deal", "recall", "Wharf"]
HAY = "concat_ws(' ', coalesce(title, ''), coalesce(descr, ''), coalesce(array_to_string(categories, ' '), ''))"


@query(
    "term_hits",
    f"WITH {STORIES_SQL}, n AS (SELECT greatest(4, floor(count(*) * 0.04)) AS most FROM stories), h AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS term, count(*) AS hits FROM stories WHERE regexp_matches({HAY}, '(?i)(^|[^\\p{{L}}\\p{{N}}]){x}($|[^\\p{{L}}\\p{{N}}])')" for x in TERMS)
    + ") SELECT term, hits, hits <= most AS kept FROM h, n",
)
def term_hits(spark, d):
    """How many stories each term of the reader's library hits, and whether it stays (at most 4 %, or 4)."""
    base = stories(spark, d)
    hay = F.concat_ws(" ", t.blank(F.col("title")), t.blank(F.col("descr")), F.coalesce(F.array_join("categories", " "), F.lit("")))
    counts = [F.count_if(hay.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}])\Q{x}\E($|[^\p{{L}}\p{{N}}])")).alias(f"t{i}") for i, x in enumerate(TERMS)]
    row = base.select("title", "descr", "categories").agg(F.count(F.lit(1)).alias("n"), *counts)
    each = row.select("n", F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.col(f"t{i}").alias("hits")) for i, x in enumerate(TERMS)])).alias("x"))
    return each.select("x.term", "x.hits", (F.col("x.hits") <= F.greatest(F.lit(4), F.floor(F.col("n") * 0.04))).alias("kept"))


RULES = [{"kind": "boost", "terms": ["battery"]}, {"kind": "trust", "outlet": "Gazette"}, {"kind": "demote", "outlet": "signal"}, {"kind": "mute", "terms": ["podcast"]}, {"kind": "flag", "terms": ["recall"]}]


def _names(term: str) -> str:
    return f"regexp_matches({HAY}, '(?i)(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')"


@query(
    "word_rules",
    f"""WITH {STORIES_SQL} SELECT ord, CAST(CASE WHEN {_names('battery')} THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(source, '')), 'gazette') THEN 2 ELSE 0 END - CASE WHEN contains(lower(coalesce(source, '')), 'signal') THEN 3 ELSE 0 END
 - CASE WHEN lower(coalesce(source, '')) = 'the quill wire' THEN 4 ELSE 0 END + CASE WHEN list_contains(list_slice(f, 1, 6), 'tribunal') THEN 3 ELSE 0 END - CASE WHEN list_contains(list_slice(f, 1, 6), 'museum') THEN 2 ELSE 0 END AS INTEGER) AS rule_score,
 {_names('podcast')} AS muted, {_names('recall')} AS flagged FROM (SELECT *, list_filter(regexp_extract_all(lower(coalesce(title, '')), '\\p{{L}}{{4,}}'), lambda x, i: list_position(regexp_extract_all(lower(coalesce(title, '')), '\\p{{L}}{{4,}}'), x) = i) AS f FROM stories) s""",
)
def word_rules(spark, d):
    return rank.word_rules(stories(spark, d), RULES, {"the quill wire": -4, "granite report": 1}, {"tribunal": 3, "museum": -2})


@query(
    "wire_search",
    f"WITH {STORIES_SQL} SELECT ord FROM stories WHERE contains(lower(coalesce(title, '')), 'battery') OR contains(lower(coalesce(descr, '')), 'battery') OR len(list_filter(coalesce(categories, []), lambda c: contains(lower(c), 'battery'))) > 0",
)
def wire_search(spark, d):
    return search.contains_text(stories(spark, d), "Battery").select("ord")


@query("source_search", "SELECT row_id FROM news_articles WHERE contains(lower(coalesce(source_name, '')), 'gazette') OR contains(lower(coalesce(source_id, '')), 'gazette')")
def source_search(spark, d):
    return search.from_source(table(spark, d, "news_articles"), "Gazette").select("row_id")


BM25_SQL = r"""
WITH docs AS (SELECT row_id, regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(content, ''))), '([\p{L}\p{N}]+)', 1) AS words FROM news_articles),
len AS (SELECT row_id, len(words) AS length FROM docs), x AS (SELECT row_id, unnest(words) AS term FROM docs),
hits AS (SELECT row_id, q, count(*) AS tf FROM x JOIN (VALUES ('vineyard'), ('transit')) v(q) ON starts_with(term, q) GROUP BY 1, 2),
df AS (SELECT q, count(*) AS df FROM hits GROUP BY 1), st AS (SELECT count(*) AS n, avg(length) AS mean FROM len)
SELECT row_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25 FROM hits JOIN df USING (q) JOIN len USING (row_id), st GROUP BY 1 HAVING count(*) = 2"""


@query("keyword_search", BM25_SQL)
def keyword_search(spark, d):
    index, lengths = search.postings(table(spark, d, "news_articles").select("row_id", "title", "description", "content"), "row_id", "title", "description", "content")
    return search.bm25(index, lengths, "row_id", "vineyard* transit")


@query("semantic_search")
def semantic_search(spark, d):
    vectors = table(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    return search.nearest(vectors, list(first[0]) if first else [], 10)


@query(
    "nearest_vectors",
    """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""",
)
def nearest_vectors(spark, d):
    """The five nearest of every vector whose id is divisible by 20, against all vectors."""
    vectors = table(spark, d, "embeddings")
    return search.nearest_all(vectors, vectors.where("vec_id % 20 = 0"), 5)


@query("briefing")
def briefing(spark, d):
    return search.curate(stories(spark, d), "the museum and the battery recall")


@query("new_stories", f"WITH {STORIES_SQL} SELECT ord, CASE WHEN coalesce(ts, 0) > {NOW_MS + 300000} THEN {NOW_MS} ELSE coalesce(ts, 0) END AS t FROM stories WHERE (CASE WHEN coalesce(ts, 0) > {NOW_MS + 300000} THEN {NOW_MS} ELSE coalesce(ts, 0) END) > {NOW_MS - 90 * 86_400_000}")
def new_stories(spark, d):
    return rank.new_since(stories(spark, d), NOW_MS - 90 * 86_400_000, NOW_MS).select("ord", "t")


@query("wire_merge")
def wire_merge(spark, d):
    """Duplicates dropped, events folded into their leads, newest first by place."""
    base = stories_in_place(spark, d)
    dropped = few(cut_lineage(events.dedupe_stories(base).where("NOT kept").select("ord")), BROADCAST_ROWS // 4)
    once = base.join(dropped, "ord", "left_anti").withColumn("t", rank.clamp_ts(F.col("ts"), NOW_MS))
    return events.cluster_stories(once, "id", "t").where("is_lead").select("ord", "id", "t", "cluster_size", F.col("report_count").alias("reports"))
