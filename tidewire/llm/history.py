"""Checking new items against everything accepted before: guid, page and title, the title by pivot distances.

Titles are sets of words under the metric d(x, y) = number of words in one set only; with sizes a <= b,
a Jaccard similarity of at least t means d <= (1 - t) / (1 + t) * (a + b).  The stored table (`append_batch`) keeps
for each distinct title its distances to fixed pivots, in the form they are compared in:

* the empty title: its distance is the size, which bounds the range of sizes that can match;
* 64 word classes: a title's distances to them modulo 2, packed in one long; by the triangle inequality titles
  differ by at least as many words as bits;
* every single word as a pivot, in D + 2 groups by a hash of the word, where D bounds the distance for the size:
  at least two groups of a matching pair have equal distances to every pivot of the group.  The distances of
  two groups are the join key.  (Ranges of the distances to a few pivots were not used for the join: they differ
  by one or two between any two titles of a length, and so prune next to nothing.)

The key rows of a batch are written in ranges of the key, sorted.  `judge` joins the new batch's keys to the stored
ones, reading only the ranges and files that the batch's keys can stand in; titles are fetched for what the
pivots leave, and the true distance decides.  Neither texts nor keys of the history are computed again.

Repeated titles are one row with their first arrival, so a title repeated in a third of all rows is one row; guids
and pages are aggregated likewise.  Batches are written under their id and count once their mark is written, so a
batch that failed half way, or is delivered again, replaces itself.

Defined results: null and blank guids, links without host and titles of fewer than ``min_words`` words prove
nothing; guids count within one source only; a row equal to a later one is not a repeat, the later one is;
empty tables give empty results; very long titles are compared whole.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.functions.urls import page_key
from tidewire.session import cut_lineage, ensure_checkpoint_dir


def title_words(title: Column, outlet: Column) -> Column:
    """The words of a title (runs of letters and digits, lower case) without the outlet's name at its end."""
    words, name = (F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)) for x in (title, outlet))
    ends = (F.size(name) > 0) & (F.size(words) > F.size(name)) & (F.slice(words, F.greatest(F.size(words) - F.size(name) + 1, F.lit(1)), F.size(name)) == name)
    return F.when(ends, F.slice(words, 1, F.greatest(F.size(words) - F.size(name), F.lit(0)))).otherwise(words)


def arrivals(items: DataFrame, feeds: DataFrame, id_column: str, is_history: bool, min_words: int = 5) -> DataFrame:
    """ord (-1 for history, else the item's id), source_id, guid, page, words (sorted, distinct; null if too few)."""
    names = feeds.select("source_id", F.col("source_name").alias("feed_name")).dropDuplicates(["source_id"])
    rows = items.select(F.col(id_column).cast("long").alias("id"), "source_id", "title", "link", "guid", *(["source_name"] if "source_name" in items.columns else []))
    if "source_name" not in rows.columns:
        rows = rows.withColumn("source_name", F.lit(None).cast("string"))
    rows = rows.join(names, "source_id", "left").withColumn("w", title_words(F.col("title"), F.coalesce("source_name", "feed_name", F.lit(""))))
    guid = F.regexp_replace("guid", r"(?U)^[\s﻿]+|[\s﻿]+$", "")
    return rows.select(
        "id",
        (F.lit(-1).cast("long") if is_history else F.col("id")).alias("ord"),
        "source_id",
        F.when(guid != "", guid).alias("guid"),
        page_key(F.col("link")).alias("page"),
        F.when(F.size("w") >= min_words, F.array_sort(F.array_distinct("w"))).alias("words"),
    )


def pivot_table(rows: DataFrame) -> DataFrame:
    """set_id, check, words, size, parity, first_ord, last_ord of each distinct title: its distances to the fixed pivots.

    ``set_id`` and ``check`` are two hashes of the words (96 bits): the first joins, both identify.
    """
    sets = rows.where(F.col("words").isNotNull()).groupBy("words").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    bit = lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))
    return sets.select(*_identity(), "words", F.size("words").alias("size"), F.aggregate("words", F.lit(0).cast("long"), bit).alias("parity"), "first_ord", "last_ord")


def _identity() -> list[Column]:
    return [F.xxhash64("words").alias("set_id"), F.hash("words").alias("check")]


def _keys(table: DataFrame, percent: int) -> DataFrame:
    """The table's rows under the distances of every two groups of pivots, for each bound that a partner as large or larger may have."""
    bound = lambda size: F.floor(size * (2 * (100 - percent)) / (100 + percent)).cast("int")
    most = bound(F.floor(F.col("size") * 100 / percent))
    hashed = table.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.explode(F.sequence(bound(F.col("size")), F.greatest(most, bound(F.col("size"))))).alias("bound"))
    grouped = hashed.withColumn("g", F.expr("transform(sequence(0, bound + 1), g -> xxhash64(filter(h, x -> pmod(shiftright(x, 7), bound + 2) = g)))"))
    return grouped.select("set_id", "size", "parity", "first_ord", F.explode(F.expr("flatten(transform(sequence(0, bound), i -> transform(sequence(i + 1, bound + 1), j -> xxhash64(bound, i, j, g[i], g[j]))))")).alias("key"))


def _verified(pairs: DataFrame, new: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """set_id, check, earliest: the first arrival among the truly close y of each x of the pairs (x, y)."""
    known_words = known.select(F.col("set_id").alias("y"), F.col("words").alias("wy"), "first_ord")
    full = pairs.join(new.select(F.col("set_id").alias("x"), "check", F.col("words").alias("wx")), "x").join(known_words, "y")
    common = F.size(F.array_intersect("wx", "wy"))
    return full.where(common * 100 >= percent * (F.size("wx") + F.size("wy") - common)).groupBy(F.col("x").alias("set_id"), "check").agg(F.min("first_ord").alias("earliest"))


def close_titles(new: DataFrame, known: DataFrame, known_keys: DataFrame, percent: int = 80) -> DataFrame:
    """set_id, check (of ``new``), earliest: an earlier arrival among the titles of ``known`` that are close to it.

    ``new`` and ``known`` are pivot tables, ``known_keys`` the keys of the latter; equal titles are not compared here,
    and later arrivals do not matter.  Each title meets the earliest title of each of its keys first; only titles
    that this shows no repeat meet the rest of their keys, so a group of many copies of an early title costs one
    comparison a copy and key.
    """
    reach = (F.col("n.size") + F.col("k.size")) * (100 - percent) / (100 + percent)
    near = (
        (F.col("k.set_id") != F.col("n.set_id"))
        & (F.col("k.first_ord") < F.col("n.first_ord"))
        & (F.abs(F.col("n.size") - F.col("k.size")) <= reach)
        & (F.bit_count(F.col("n.parity").bitwiseXOR(F.col("k.parity"))) <= reach)
    )
    pair = [F.col("n.set_id").alias("x"), F.col("k.set_id").alias("y")]
    heads = known_keys.groupBy("key").agg(F.min(F.struct("first_ord", "set_id", "size", "parity")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "h.*")
    stars = _keys(new, percent).alias("n").join(heads.alias("k"), "key").where(near).select(*pair).distinct()
    first = cut_lineage(_verified(stars, new, known, percent))
    loose = new.join(first, ["set_id", "check"], "left_anti")
    rest = _keys(loose, percent).alias("n").join(known_keys.alias("k"), "key").where(near).select(*pair).distinct()
    return first.unionByName(_verified(rest, loose, known, percent))


#: Ranges of the key space that the stored keys are partitioned by.
RANGES = 16


def _part(key: str) -> Column:
    """The range of a key: its highest bits."""
    return (F.shiftrightunsigned(key, 60)).cast("int").alias("part")


def _proofs(rows: DataFrame) -> DataFrame:
    """proof (a guid within its source, or a page), its first and last arrival."""
    guid = F.when(F.col("source_id").isNotNull() & F.col("guid").isNotNull(), F.concat_ws("\u0001", F.lit("g"), "source_id", "guid"))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("p\u0001"), F.col("page")))
    each = rows.select("ord", F.explode(F.array(guid, page)).alias("proof")).where("proof IS NOT NULL")
    return each.groupBy("proof").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))


def _stored(spark: SparkSession, path: str, part: str, schema: str, without: str | None, ranges: list[int] | None = None) -> DataFrame:
    """The rows of a part of the store, of the batches whose mark is written, but for one."""
    marks = f"{path}/marks"
    empty = spark.createDataFrame([], schema)
    try:
        done = [r[0] for r in spark.read.schema("batch string").parquet(marks).select("batch").distinct().collect() if r[0] != without]
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return empty
    if not done:
        return empty
    rows = spark.read.schema(schema + ", batch string" + (", part int" if part == "keys" else "")).parquet(f"{path}/{part}").where(F.col("batch").isin(done))
    if ranges is not None:
        rows = rows.where(F.col("part").isin(ranges))
    return rows.drop("batch", "part")


_TITLES = "set_id long, check int, words array<string>, size int, parity long, first_ord long"
_KEYS = "set_id long, size int, parity long, first_ord long, key long"
_PROOFS = "proof string, first long"


def append_batch(path: str, batch: DataFrame, batch_id: str, percent: int = 80) -> None:
    """Append the rows of a batch (`arrivals`) to the store at ``path``: titles, their keys, guids and pages."""
    table = cut_lineage(pivot_table(batch))
    table.drop("last_ord").write.mode("overwrite").parquet(f"{path}/titles/batch={batch_id}")
    keys = _keys(table, percent).withColumn("part", _part("key"))
    keys.repartitionByRange("part", "key").sortWithinPartitions("part", "key").write.mode("overwrite").partitionBy("part").parquet(f"{path}/keys/batch={batch_id}")
    _proofs(batch).drop("last").write.mode("overwrite").parquet(f"{path}/proofs/batch={batch_id}")
    batch.sparkSession.createDataFrame([(batch_id,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/of={batch_id}")


def judge(spark: SparkSession, path: str, batch: DataFrame, batch_id: str | None = None, percent: int = 80) -> DataFrame:
    """id of every row of the batch (`arrivals`) that repeats a row of the store at ``path`` or an earlier one of the batch.

    Rows of the store count as earlier than all of the batch; what is stored under the batch's own id does not count.
    """
    rows = cut_lineage(batch)
    mine = cut_lineage(pivot_table(rows))
    my_keys = cut_lineage(_keys(mine, percent))
    ranges = [r[0] for r in my_keys.select(_part("key")).distinct().collect()]  # at most RANGES
    before = F.lit(-1).cast("long").alias("first_ord")
    old = _stored(spark, path, "titles", _TITLES, batch_id).select("set_id", "check", "words", "size", "parity", before)
    old_keys = _stored(spark, path, "keys", _KEYS, batch_id, ranges).select("set_id", "size", "parity", before, "key")
    earliest = close_titles(mine, old.unionByName(mine.drop("last_ord")), old_keys.unionByName(my_keys), percent)
    equal = old.select("set_id", "check").distinct().withColumn("old", F.lit(True))
    firsts = mine.select("set_id", "check", "first_ord").join(earliest, ["set_id", "check"], "left").join(equal, ["set_id", "check"], "left")
    firsts = firsts.select("set_id", "check", F.when(F.col("old"), -1).otherwise(F.least("first_ord", F.coalesce("earliest", "first_ord"))).alias("first"))
    titled = rows.where(F.col("words").isNotNull()).select("id", "ord", *_identity())
    by_title = titled.join(firsts, ["set_id", "check"]).where(F.col("ord") > F.col("first")).select("id")
    # guids and pages: those that stand in the store or more than once in the batch
    own = _proofs(rows)
    stored = _stored(spark, path, "proofs", _PROOFS, batch_id).select("proof", F.lit(True).alias("old")).distinct()
    shared = own.join(stored, "proof", "left").where(F.col("old") | (F.col("first") < F.col("last"))).select("proof", F.when(F.col("old"), -1).otherwise(F.col("first")).alias("first"))
    guid = F.when(F.col("source_id").isNotNull() & F.col("guid").isNotNull(), F.concat_ws("\u0001", F.lit("g"), "source_id", "guid"))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("p\u0001"), F.col("page")))
    proved = rows.select("id", "ord", F.explode(F.array(guid, page)).alias("proof")).where("proof IS NOT NULL")
    by_proof = proved.join(shared, "proof").where(F.col("ord") > F.col("first")).select("id")
    return by_title.union(by_proof).distinct()


def check_batch(spark: SparkSession, path: str, batch: DataFrame, batch_id: str) -> DataFrame:
    """Judge a batch against the store at ``path``, then append it; the result is written first, so it may be read later."""
    found = cut_lineage(judge(spark, path, batch, batch_id))
    append_batch(path, batch, batch_id)
    return found


def repeats(history: DataFrame, items: DataFrame, path: str | None = None) -> DataFrame:
    """id of every item that repeats a row of the history or an earlier item, both `arrivals`.

    The history is stored at ``path`` (a fresh folder beside the checkpoints by default) as one batch, and the items
    are judged against the store.
    """
    spark = history.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/history-{uuid4().hex}"
    append_batch(path, history, "history")
    return judge(spark, path, items)
