"""The wire: stories with an explicit order, and the front page composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.session import BROADCAST_ROWS, cut_lineage, table

#: The clock of the queries: 2026-10-31T00:00Z, in epoch milliseconds.
NOW_MS = 1_793_404_800_000

#: Columns of which a story has the least value of its deliveries.
FIRSTS = ("feed_id", "title", "link", "source", "badge", "lang", "categories", "descr", "ts", "image_url")

#: `stories` for DuckDB, the same rows as `stories()`.
STORIES_SQL = """stories AS (
  SELECT concat(story_id, '#', md5(concat_ws('|', coalesce(title, ''), coalesce(link, ''), coalesce(descr, ''), CAST(ts AS VARCHAR)))) AS ord,
         min(story_id) AS id, min(feed_id) AS feed_id, min(title) AS title, min(link) AS link, min(source) AS source, min(badge) AS badge, min(lang) AS lang,
         min(categories) AS categories, min(descr) AS descr, min(ts) AS ts, min(image_url) AS image_url, coalesce(max(CAST(breaking AS INTEGER)), 0) AS breaking, coalesce(max(report_count), 0) AS report_count
  FROM wire_stories WHERE story_id IS NOT NULL GROUP BY 1)"""


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered story: repeated deliveries of the same text and time are one row.

    ``ord`` (unique) stands for the order of the wire in every operator.
    """
    return _folded(_delivered(spark, sf_dir))


def stories_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``stories()``, of which only those delivered more than once are shuffled, if these are few."""
    rows = _delivered(spark, sf_dir)
    counts = rows.groupBy(F.xxhash64("ord").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    again = cut_lineage(counts.where("n > 1").select("h"))
    if again.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _folded(rows)
    known, same = F.broadcast(again), F.xxhash64("ord") == F.col("h")
    once = rows.join(known, same, "left_anti").select("ord", F.col("story_id").alias("id"), *FIRSTS, F.coalesce(F.col("breaking").cast("int"), F.lit(0)).alias("breaking"), F.coalesce("report_count", F.lit(0)).cast("long").alias("report_count"))
    return once.unionByName(_folded(rows.join(known, same, "left_semi")))


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "wire_stories").where("story_id IS NOT NULL")
    parts = F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("link", F.lit("")), F.coalesce("descr", F.lit("")), F.col("ts").cast("string"))
    return rows.withColumn("ord", F.concat("story_id", F.lit("#"), F.md5(parts)))


def _folded(rows: DataFrame) -> DataFrame:
    firsts = [F.min(c).alias(c) for c in FIRSTS]
    return rows.groupBy("ord").agg(F.min("story_id").alias("id"), *firsts, F.coalesce(F.max(F.col("breaking").cast("int")), F.lit(0)).alias("breaking"), F.coalesce(F.max("report_count"), F.lit(0)).cast("long").alias("report_count"))


def feed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed_id, section_name, is_wire of every feed (a small dimension)."""
    return table(spark, sf_dir, "feeds").select(F.col("source_id").alias("feed_id"), "section_name", "is_wire")
