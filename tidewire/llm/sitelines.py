"""Lines that one site repeats across its documents: distributed PrefixSpan over line sequences.

Each document is the sequence of its normalised lines.  Level 1 counts, per source, the documents that hold
a line (lines are made distinct within a document before the shuffle, so one map-side combined count is
enough); infrequent lines leave the sequences.  Each further level extends the frequent sequences of the
level before by every line of the projected suffixes (what follows the first place of the sequence in each
document, other frequent lines between or not) and keeps what enough distinct documents share, until no
sequence is frequent.  Every occurrence of a frequent sequence, single lines included, is deleted.

Defined results: null and blank contents have no lines; blank lines and rows without a source do not
count; a line that stands several times in one document counts once but is reported at each place;
repeated rows are documents of their own; very long lines count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.session import cut_lineage


def line_key(line: Column) -> Column:
    """The line trimmed, white space (also no-break) collapsed, case ignored."""
    return F.lower(F.trim(F.regexp_replace(line, r"(?U)[\s﻿]+", " ")))


def _lines(docs: DataFrame) -> DataFrame:
    split = docs.where(F.col("source_name").isNotNull() & F.col("content").isNotNull()).select("row_id", "source_name", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    keyed = split.select("row_id", "source_name", (F.col("at") + 1).cast("int").alias("line_no"), line_key(F.col("line")).alias("key")).where("key <> ''")
    # two independent hashes stand for the line: 96 bits within one source
    return keyed.select("row_id", "source_name", "line_no", F.struct(F.xxhash64("key").alias("a"), F.hash("key").alias("b")).alias("line_id"))


def frequent_lines(docs: DataFrame, min_docs: int = 6) -> tuple[DataFrame, DataFrame]:
    """(level one of the sequences, its lines: row_id, source_name, line_no, line_id)."""
    lines = _lines(docs)
    level = lines.select("row_id", "source_name", "line_id").distinct().groupBy("source_name", "line_id").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    level = cut_lineage(level)
    return level, lines.join(level.select("source_name", "line_id"), ["source_name", "line_id"])


def frequent_sequences(docs: DataFrame, min_docs: int = 6, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sequences, occurrences).

    ``docs``: row_id, source_name, content.  sequences: source_name, length, line_ids, n_docs; of every length
    unless ``max_length`` is given.  occurrences: row_id, source_name, line_no of every line of a frequent sequence.
    """
    level, marked = frequent_lines(docs, min_docs)
    found = level.select("source_name", F.lit(1).alias("length"), F.array("line_id").alias("line_ids"), "n_docs")
    if max_length == 1:
        return found, marked.select("row_id", "source_name", "line_no")
    marked = cut_lineage(marked)
    # the projected database: a document's frequent lines in order (bounded by the lines of one document)
    ordered = marked.groupBy("source_name", "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id"))), lambda x: x["line_id"]).alias("suffix"))
    # documents of one suffix are one row with their number, at every level
    projected = ordered.groupBy("source_name", "suffix").agg(F.count(F.lit(1)).alias("n"))
    length = 1
    after = lambda x: F.slice("suffix", F.array_position("suffix", x).cast("int") + 1, F.size("suffix"))
    while max_length is None or length <= max_length:
        steps = F.explode(F.transform(F.array_distinct("suffix"), lambda x: F.struct(x.alias("line_id"), after(x).alias("suffix"))))
        grown = projected.select("source_name", "n", *([] if length == 1 else ["line_ids"]), steps.alias("step"))
        ids = F.array("step.line_id") if length == 1 else F.concat("line_ids", F.array("step.line_id"))
        grown = grown.select("source_name", ids.alias("line_ids"), F.col("step.suffix").alias("suffix"), "n")
        grown = cut_lineage(grown.groupBy("source_name", "line_ids", "suffix").agg(F.sum("n").alias("n")))
        level = cut_lineage(grown.groupBy("source_name", "line_ids").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs))
        if not level.limit(1).count():
            break
        if length > 1:
            found = found.unionByName(level.select("source_name", F.lit(length).alias("length"), "line_ids", "n_docs"))
        projected = grown.where(F.size("suffix") > 0).join(level.select("source_name", "line_ids"), ["source_name", "line_ids"], "left_semi")
        length += 1
    # a sequence is frequent only if each of its lines is, so the places of the frequent lines are all places
    return found, marked.select("row_id", "source_name", "line_no")


def strip_lines(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """row_id and ``content`` without the lines at ``occurrences`` (row_id, line_no)."""
    drop = occurrences.groupBy("row_id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.expr("array_join(filter(split(content, '\\n'), (x, i) -> not array_contains(coalesce(drop, array()), i + 1)), '\\n')")
    return docs.select("row_id", "content").join(drop, "row_id", "left").select("row_id", F.when(F.col("content").isNotNull(), kept).alias("content"))
