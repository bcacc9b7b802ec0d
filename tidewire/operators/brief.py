"""Briefings: the map of names and figures over sources, checks of drafted sentences, and rule texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.functions.text import blank

NAME = r"(\p{Lu}[\p{L}’'-]+(?:\s+\p{Lu}[\p{L}’'-]+)+)"
FIGURE = r"(\d[\d,.]*\d|\d)"


def topic_map(docs: DataFrame, key: str, text: str, outlet: str) -> DataFrame:
    """kind ('name' or 'figure'), item, n_sources, n_outlets, confirmed (two outlets) of what the texts state.

    Names are runs of two or more capitalised words.
    """
    found = lambda kind, pattern: F.transform(F.array_distinct(F.regexp_extract_all(blank(F.col(text)), F.lit(pattern), F.lit(1))), lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(x, r"\s+", " ").alias("item")))
    each = docs.select(F.col(key).alias("k"), F.lower(blank(F.col(outlet))).alias("o"), F.explode(F.concat(found("name", NAME), found("figure", FIGURE))).alias("x"))
    counts = each.select("k", "o", "x.kind", "x.item").distinct().groupBy("kind", "item").agg(F.count_distinct("k").alias("n_sources"), F.count_distinct("o").alias("n_outlets"))
    return counts.withColumn("confirmed", F.col("n_outlets") >= 2)


def unsupported(sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """place, problem of each drafted sentence that its sources do not carry.

    ``sentences``: place, sentence with citations such as [2]; ``sources``: n, text.  Problems: 'no citation',
    'unknown source', 'figure' or 'name' that no cited text holds.
    """
    s = sentences.select("place", "sentence", F.transform(F.regexp_extract_all("sentence", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int")).alias("cited"))
    none = s.where(F.size("cited") == 0).select("place", F.lit("no citation").alias("problem"))
    refs = s.select("place", "sentence", F.explode("cited").alias("n")).join(sources, "n", "left")
    unknown = refs.where(F.col("text").isNull()).select("place", F.lit("unknown source").alias("problem")).distinct()
    told = refs.where(F.col("text").isNotNull()).groupBy("place", "sentence").agg(F.lower(F.concat_ws(" ", F.collect_list("text"))).alias("told"))
    bare = F.regexp_replace("sentence", r"\[\d+\]", "")
    missing = lambda pattern: F.size(F.filter(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)), lambda x: ~F.contains("told", F.lower(x)))) > 0
    figures = told.where(missing(FIGURE)).select("place", F.lit("figure").alias("problem"))
    names = told.where(missing(NAME)).select("place", F.lit("name").alias("problem"))
    return none.unionByName(unknown).unionByName(figures).unionByName(names)


def parse_rules(texts: DataFrame) -> DataFrame:
    """owner, line, kind, terms, outlet, share, error of each rule line of (owner, rules text); comments and blanks are skipped."""
    lines = texts.select("owner", F.posexplode(F.split(blank(F.col("rules")), r"\r?\n")).alias("at", "raw")).select("owner", (F.col("at") + 1).alias("line"), F.trim("raw").alias("t")).where("t <> '' AND NOT startswith(t, '#')")
    kind, rest = F.lower(F.regexp_extract("t", r"^(\S+)", 1)), F.trim(F.regexp_extract("t", r"^\S+\s*(.*)$", 1))
    terms = F.filter(F.transform(F.split(rest, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    cap_outlet, cap_share = F.lower(F.regexp_extract(rest, r"^(.+?)\s+\d{1,3}\s*%$", 1)), F.regexp_extract(rest, r"\s(\d{1,3})\s*%$", 1).try_cast("int")
    error: Column = (
        F.when(kind.isin("boost", "mute", "flag"), F.when(F.size(terms) == 0, "needs at least one word or phrase"))
        .when(kind.isin("trust", "demote"), F.when(rest == "", "needs an outlet name"))
        .when(kind == "cap", F.when((cap_outlet == "") | cap_share.isNull() | (cap_share > 100), "needs an outlet and a share"))
        .otherwise("unknown rule")
    )
    return lines.select(
        "owner", "line", kind.alias("kind"), F.when(kind.isin("boost", "mute", "flag") & error.isNull(), terms).alias("terms"),
        F.when(kind.isin("trust", "demote") & error.isNull(), F.lower(rest)).when((kind == "cap") & error.isNull(), cap_outlet).alias("outlet"), F.when((kind == "cap") & error.isNull(), cap_share / 100).alias("share"), error.alias("error"),
    )


def cap_outlets(ranked: DataFrame, caps: list[tuple[str, float]]) -> DataFrame:
    """ord, capped of a ranked list (ord, source, position): an outlet named by one cap keeps max(1, floor(share * n)) places.

    Each story counts for the first cap whose outlet its source holds.
    """
    which = F.lit(None).cast("int")
    for i, (name, _) in reversed(list(enumerate(caps))):
        which = F.when(F.contains(F.lower(blank(F.col("source"))), F.lit(name.lower())), i).otherwise(which)
    total = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.lit(1.0)
    for i, (_, s) in enumerate(caps):
        share = F.when(F.col("cap") == i, float(s)).otherwise(share)
    # only stories under a cap are ordered, within their cap
    held = ranked.withColumn("cap", which).where("cap IS NOT NULL").withColumn("k", F.row_number().over(W.partitionBy("cap").orderBy("position", "ord")))
    beyond = held.where(F.col("k") > F.greatest(F.lit(1), F.floor(share * total))).select("ord", F.lit(True).alias("capped"))
    return ranked.select("ord").join(beyond, "ord", "left").select("ord", F.coalesce("capped", F.lit(False)).alias("capped"))


def save_place(places: DataFrame, owner: str, city: str, region: str, most: int = 12) -> DataFrame:
    """(owner, place, city, region) with one place added at the end unless it is there (case ignored) or the list is full."""
    mine = places.where(F.col("owner") == owner)
    there = mine.where((F.lower("city") == city.lower()) & (F.lower(F.coalesce("region", F.lit(""))) == region.lower()))
    facts = mine.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("place"), F.lit(0)).alias("last")).where(F.col("n") < most)
    fresh = facts.select(F.lit(owner).alias("owner"), (F.col("last") + 1).cast("int").alias("place"), F.lit(city).alias("city"), F.lit(region).alias("region"))
    return places.unionByName(fresh.join(there.select("owner"), "owner", "left_anti"))
