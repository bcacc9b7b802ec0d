"""Upserts, archive ingestion with outcomes, snapshots, and read and vote state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.functions.text import blank


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` with each changed key replaced by its last change (by ``order``), new keys added.

    Columns that only one side has become null on the other (additive schema change).
    """
    last = changes.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return current.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def archive_records(stories: DataFrame, text_limit: int = 6000) -> DataFrame:
    """domain_key, title, content, tags, event_time of stories with a web link and a title."""
    link, title = F.trim(blank(F.col("link"))), F.trim(blank(F.col("title")))
    body = F.left(F.trim(F.regexp_replace(blank(F.col("descr")), r"\s+", " ")), F.lit(text_limit))
    source = F.trim(blank(F.col("source")))
    feed = F.left(F.regexp_replace(F.coalesce("feed_id", F.lit("wire")), r"(?i)[^a-z0-9_-]", ""), F.lit(40))
    tags = F.concat(F.array(source, F.concat(F.lit("feed:"), F.when(feed != "", feed).otherwise("wire")), F.trim(blank(F.col("badge"))), F.trim(blank(F.col("lang")))), F.slice(F.coalesce("categories", F.array().cast("array<string>")), 1, 3))
    content = F.when(body != "", body).otherwise(F.concat(F.when(source != "", F.concat(source, F.lit(": "))).otherwise(""), title))
    return stories.where(link.rlike("(?i)^https?://") & (title != "")).select(link.alias("domain_key"), title.alias("title"), content.alias("content"), F.filter(F.transform(tags, lambda t: F.trim(blank(t))), lambda t: t != "").alias("tags"), F.when(F.col("ts") > 0, F.col("ts")).alias("event_time"))


def ingest(archive: DataFrame, records: DataFrame) -> DataFrame:
    """domain_key, status ('captured', 'updated', 'unchanged') of every record key against the archive.

    Of several records of one key the one with the latest time (then the greatest content) counts.
    """
    best = F.max(F.struct(F.coalesce("event_time", F.lit(0).cast("long")).alias("t"), "title", "content"))
    fresh = records.groupBy("domain_key").agg(best.alias("r")).select("domain_key", F.xxhash64("r.title", "r.content").alias("new"))
    known = archive.groupBy("domain_key").agg(best.alias("r")).select("domain_key", F.xxhash64("r.title", "r.content").alias("old"))
    return fresh.join(known, "domain_key", "left").select("domain_key", F.when(F.col("old").isNull(), "captured").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged").alias("status"))


def snapshot(stories: DataFrame, now_ms: int, days: int = 3, most: int = 500) -> DataFrame:
    """The newest ``most`` stories of the last ``days`` days (a top-k; the limit is the feature)."""
    return stories.where((F.lit(now_ms) - F.coalesce("ts", F.lit(0))) <= days * 86_400_000).orderBy(F.desc("ts"), "ord").limit(most)


def carry_over(fresh: DataFrame, before: DataFrame, key: str, *columns: str) -> DataFrame:
    """``fresh`` with null or empty ``columns`` filled from the previous version under the same key."""
    old = before.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    joined = fresh.join(old, key, "left")
    filled: dict[str, Column] = {c: F.coalesce(F.nullif(c, F.lit("")), f"_{c}") for c in columns}
    return joined.withColumns(filled).drop(*[f"_{c}" for c in columns])


def replace_feeds(wire: DataFrame, fresh: DataFrame) -> DataFrame:
    """The wire with all rows of the fresh feeds replaced by the fresh rows."""
    return wire.join(fresh.select("feed_id").distinct(), "feed_id", "left_anti").unionByName(fresh)


def read_marks(events: DataFrame, most: int = 3000) -> DataFrame:
    """user_id, item, seen_at: each user's last ``most`` first-seen items (older ones leave)."""
    firsts = events.groupBy("user_id", "item").agg(F.min("ts").alias("seen_at"))
    return firsts.withColumn("_n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("seen_at"), F.desc("item")))).where(F.col("_n") <= most).drop("_n")


def vote_weights(votes: DataFrame, limit: int = 5) -> DataFrame:
    """key, weight of votes (key, ts, dir) in order: a vote adds its direction, held within ±``limit`` at every step.

    A step clamps x + d; any run of steps is a map x -> min(max(x + a, lo), hi), and such maps compose.  Each day of
    a key is composed by itself, so no key's votes gather in one place; then the few maps per key are applied.
    """
    clamp = lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    day = votes.groupBy("key", F.floor(F.col("ts") / 86_400_000).alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", F.col("dir").cast("int").alias("dir")))), lambda s: s["dir"]).alias("dirs"))
    start = F.struct(F.lit(0).alias("a"), F.lit(-limit).alias("lo"), F.lit(limit).alias("hi"))
    composed = day.select("key", "day", F.aggregate("dirs", start, lambda f, d: F.struct((f["a"] + d).alias("a"), clamp(f["lo"] + d).alias("lo"), clamp(f["hi"] + d).alias("hi"))).alias("f"))
    maps = composed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "f"))).alias("maps"))
    held = F.aggregate("maps", F.lit(0), lambda x, m: F.least(F.greatest(x + m["f"]["a"], m["f"]["lo"]), m["f"]["hi"]))
    return maps.select("key", held.alias("weight")).where("weight <> 0")
