"""Finding texts cut off by field limits, and how often each source cuts.

Per table, source and column the lengths (characters and bytes) are counted; a length that occurs far more often
than its neighbours and near the maximum is a spike, the trace of a limit (`length_spikes`).  Texts whose
length stands exactly at a spike and that end without sentence end are cut.  A source that cuts at the last whole
word before its limit leaves no spike but a run-up: its unfinished texts crowd in the few lengths below the limit
and none is longer (`length_run_ups`).  A check of the ending follows for texts away from both: an opened tag or
entity, a mark of omission after an unfinished sentence, a sentence that simply stops, or three words and more
without any sentence end.

Only counts per (table, source, column, length) are gathered, aggregated map-side: their number per source is
bounded by the longest field, not by the rows.

Defined results: null, empty and blank texts are never cut; labels, links and texts of one or two
words without full stop are complete unless they stand exactly at a spike; very long texts are judged by their whole
length and last characters; repeated rows are each reported.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewire.session import cut_lineage, ship

#: What readers are told to click after a cut.
MORE = r"(?:read more|read the full story|read on|continue reading|more|full story|weiterlesen|mehr lesen|mehr|lire la suite|lire plus|la suite|suite|leer más|seguir leyendo|sigue leyendo|más)"
#: Openings and endings of complete texts that have no sentence end.
LABELS = r"^(?:(?:live|watch|podcast|pictured|video|gallery|photo|photos|audio|listen|quiz|opinion|analysis|exclusive|breaking|update|updated|corrections?|foto|fotos|vidéo|vídeo|en images|en imágenes|bildergalerie|interview)\b\s*[:|–—-]|in pictures\b|q&a\b|pictured:)"
ENDINGS = r"(?:\|\s*\d+\s*min(?:\.|utes?|uten|utos)?(?:\s+\w+){0,2}|\((?:[^()]*:[^()]*|\d+\s*min[^()]*)\)|https?://[^\s<>]*[\w/])$"


_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>", re.S)
_BLANK_END = re.compile(r"[\s\u200b\ufeff]+$")
_MARK = re.compile(rf"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\))\s*(?:[\[(]?{MORE}[\])]?)?\s*[»›>→]*$", re.I)
_CLICK = re.compile(r"(?<=[^\s.!?])\s+[\[(]?(?:read more|read the full story|continue reading|full story|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo)[\])]?\s*[»›>→]*$", re.I)
_FINISHED = re.compile(r"[.!?…][\"”“»’'\)\]]*$")
_INITIAL = re.compile(r"(?:(?:^|[\s.\-])(?:[^\W\d_a-zà-ÿ]|Mr|Mrs|Ms|Dr|Prof|St|Str|No|Nr|Jr|Sr|vs|bzw|ca|Mme|Sra?|Dra?)|\d)\.$")
_QUOTED_OMISSION = re.compile(r"(?:\.\.\.|…)[”»“\"]$")
_BROKEN = re.compile(r"<[^<>]{0,300}$|(?:^|[^A-ZÀ-Þ])&(?:#\w{0,6}|[a-z]{0,7})$|&#\w{0,6}$")
_ORNAMENT = re.compile(r"(?<=[.!?…\"”»])\s*[^\w\s.,;:!?\"'“”„«»‘’()\[\]{}<>&/\\|–—-]+$")
_SENTENCE = re.compile(r"[^\W\d_]{2}[.!?][\"”“»’'\)]*\s+[\"“„«¿¡–—]?\s?\w")
_QUOTE = re.compile(r"^[“«„\"].*[^,;:\s][”»“\"]$", re.S)
_LABEL = re.compile(LABELS, re.I)
_ENDING = re.compile(ENDINGS, re.I)


def ending(text: str | None) -> str:
    """How a text ends: 'blank', 'complete', 'label', 'broken_markup', 'marked', 'stops' or 'fragment'.

    'stops' ends without sentence end after at least one sentence, 'fragment' before any sentence end.
    """
    if not text:
        return "blank"
    shown = _TAG.sub("", text) if "<" in text else text
    shown = _BLANK_END.sub("", shown)
    if not shown:
        return "blank"
    if _BROKEN.search(shown):
        return "broken_markup"
    if "&" in shown:
        shown = _BLANK_END.sub("", html.unescape(shown))
    if _QUOTED_OMISSION.search(shown):
        return "complete"
    m = _MARK.search(shown)
    if m:
        core = _BLANK_END.sub("", shown[: m.start()])
        return "complete" if _FINISHED.search(core) and not _INITIAL.search(core) else "marked"
    if _CLICK.search(shown):
        return "marked"
    bare = _ORNAMENT.sub("", shown)
    if _FINISHED.search(bare) and not _INITIAL.search(bare) and not (bare.endswith(")") and not _FINISHED.search(bare[:-1])):
        return "complete"
    if _LABEL.search(shown) or _ENDING.search(shown) or _QUOTE.search(shown):
        return "label"
    return "stops" if _SENTENCE.search(shown) else "fragment"


def length_spikes(values: DataFrame, least_rows: int = 8, factor: float = 6.0, neighbours: int = 6) -> DataFrame:
    """rec_table, source_id, column_name, unit ('chars' or 'bytes'), length, n of the length spikes.

    A spike holds at least ``least_rows`` rows, ``factor`` times the mean of the lengths around it and, within
    its own table and source, no more rows above it than in it (field limits stand at the maximum).
    """
    counts = (
        values.where(F.col("text").isNotNull())
        .select("rec_table", "source_id", "column_name", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length")))).alias("x"))
        .groupBy("rec_table", "source_id", "column_name", "x.unit", "x.length")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    each = W.partitionBy("rec_table", "source_id", "column_name", "unit").orderBy("length")
    around = each.rangeBetween(-neighbours, neighbours)
    above = each.rangeBetween(1, W.unboundedFollowing)
    near = (F.sum("n").over(around) - F.col("n")) / (2.0 * neighbours)
    return (
        counts.withColumn("near", near)
        .withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .where((F.col("n") >= least_rows) & (F.col("n") >= factor * F.greatest("near", F.lit(0.5))) & (F.col("above") <= 2 * F.col("n")))
        .select("rec_table", "source_id", "column_name", "unit", "length", "n")
    )


def length_run_ups(unfinished: DataFrame, width: int = 16, least_rows: int = 8, factor: float = 3.0, beyond: float = 0.02) -> DataFrame:
    """rec_table, source_id, column_name, low, high: the lengths below a limit that is cut to at word ends.

    ``unfinished``: rec_table, source_id, column_name, chars of the texts without sentence end.  The ``width`` lengths
    up to ``high`` hold at least ``least_rows`` of them, ``factor`` times as many as the ``width`` lengths below, and
    at most the share ``beyond`` of them is longer.
    """
    counts = unfinished.groupBy("rec_table", "source_id", "column_name", "chars").agg(F.count(F.lit(1)).alias("n"))
    each = W.partitionBy("rec_table", "source_id", "column_name").orderBy("chars")
    total = lambda lo, hi: F.coalesce(F.sum("n").over(each.rangeBetween(lo, hi)), F.lit(0))
    held, below, above = total(1 - width, 0), total(1 - 2 * width, -width), total(1, W.unboundedFollowing)
    at = counts.select("*", held.alias("held"), below.alias("below"), above.alias("above"))
    limits = at.where((F.col("held") >= least_rows) & (F.col("held") >= factor * F.greatest("below", F.lit(1))) & (F.col("above") <= beyond * F.col("held")))
    return limits.groupBy("rec_table", "source_id", "column_name").agg(F.max_by("chars", F.struct("held", "chars")).alias("high")).withColumn("low", F.col("high") - width + 1)


def find_truncated(values: DataFrame, **spike_options) -> DataFrame:
    """rec_table, rec_id, source_id, column_name, evidence of each cut text.

    ``values``: rec_table, rec_id, source_id, column_name, text.  evidence: 'spike' (at a limit, without sentence end),
    'run_up' (unfinished, at the last whole word before a limit), 'marked', 'broken_markup', 'stops' or 'fragment'.
    """
    ship(values.sparkSession)
    keys = ["rec_table", "source_id", "column_name"]
    limits = (
        length_spikes(values, **spike_options)
        .groupBy(*keys)
        .agg(
            F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("at_chars"),
            F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("at_bytes"),
        )
    )

    @F.pandas_udf("string")
    def ending_of(texts: pd.Series) -> pd.Series:
        from tidewire.llm.truncation import ending as of

        return pd.Series([of(x) for x in texts], dtype=object)

    sized = values.select("rec_table", "rec_id", "source_id", "column_name", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.size(F.split(F.trim("text"), r"\s+")).alias("words"), ending_of("text").alias("ending"))
    judged = cut_lineage(sized.where("ending NOT IN ('blank', 'complete')"))
    runs = length_run_ups(judged.where("ending IN ('stops', 'fragment', 'marked')"))
    v, s, r = judged.alias("v"), limits.alias("s"), runs.alias("r")
    same = lambda x: (F.col("v.rec_table") == F.col(f"{x}.rec_table")) & F.col("v.source_id").eqNullSafe(F.col(f"{x}.source_id")) & (F.col("v.column_name") == F.col(f"{x}.column_name"))
    at_spike = F.coalesce(F.array_contains("s.at_chars", F.col("v.chars")), F.lit(False)) | F.coalesce(F.array_contains("s.at_bytes", F.col("v.bytes")), F.lit(False))
    in_run = F.coalesce(F.col("v.chars").between(F.col("r.low"), F.col("r.high")), F.lit(False))
    joined = v.join(s, same("s"), "left").join(r, same("r"), "left").select("v.*", at_spike.alias("at_spike"), in_run.alias("in_run"))
    evidence = (
        F.when(F.col("at_spike"), "spike")
        .when(F.col("ending") == "label", F.lit(None))
        .when((F.col("ending") == "fragment") & (F.col("words") < 3), F.lit(None))
        .when(F.col("in_run"), "run_up")
        .otherwise(F.col("ending"))
    )
    return joined.withColumn("evidence", evidence).where(F.col("evidence").isNotNull()).select("rec_table", "rec_id", "source_id", "column_name", "evidence")
