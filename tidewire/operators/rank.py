"""Scores, editions and caps over stories with an explicit order (``ord``)."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.functions.text import blank, heat_words, is_opinion
from tidewire.session import ship


def age_hours(ts: Column, now_ms: int) -> Column:
    """Hours since ``ts``, 0 for the future; an unknown time counts as 1970."""
    return F.greatest(F.lit(0.0), (F.lit(now_ms) - F.coalesce(ts, F.lit(0))) / 3_600_000.0)


def clamp_ts(ts: Column, now_ms: int, skew_ms: int = 300_000) -> Column:
    """A time more than ``skew_ms`` ahead becomes now; null becomes 0."""
    t = F.coalesce(ts, F.lit(0).cast("long"))
    return F.when(t > now_ms + skew_ms, F.lit(now_ms).cast("long")).otherwise(t)


def outlet(source: Column, ident: Column) -> Column:
    """Lower-case source, else the story's own id."""
    return F.lower(F.when(blank(source) != "", source).otherwise(ident))


def score(stories: DataFrame, now_ms: int, hits: Column | None = None) -> DataFrame:
    """``stories`` with ``score``: freshness with a half-life of about six hours, image, library hits, opinion penalty."""
    n = hits if hits is not None else F.lit(0)
    value = 100 / (1 + age_hours(F.col("ts"), now_ms) / 6) + F.when(blank(F.col("image_url")) != "", 4).otherwise(0) + F.when(n > 0, 60 + 5 * F.least(n - 1, F.lit(3))).otherwise(0) - F.when(is_opinion(F.col("title"), F.col("link")), 30).otherwise(0)
    return stories.withColumn("score", F.round(value, 6))


def hero_score(stories: DataFrame, now_ms: int) -> DataFrame:
    """``stories`` (with ``heat``) with ``hero``: freshness, breadth of coverage, opinion penalty."""
    breadth = F.least(F.greatest(F.coalesce("heat", F.lit(1)), F.greatest("report_count", F.lit(1))) - 1, F.lit(10))
    return stories.withColumn("hero", F.round(60 / (1 + age_hours(F.col("ts"), now_ms) / 6) + 18 * breadth - F.when(is_opinion(F.col("title"), F.col("link")), 30).otherwise(0), 6))


def edition(scored: DataFrame, sections: DataFrame, secondary: int = 4, per_section: int = 6) -> DataFrame:
    """slot ('lead', 'secondary' or 'section'), section, rank, ord, id, score.

    The best stories open the page; the rest fill their feed's section, ``per_section`` each.  The opening
    needs only the first few rows of the order (a top-k, no global sort); sections rank within themselves.
    """
    front = scored.orderBy(F.desc("score"), "ord").limit(1 + secondary).select("ord", "id", "score")
    top = front.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ord")))
    opening = top.select(F.when(F.col("rank") == 1, "lead").otherwise("secondary").alias("slot"), F.lit("").alias("section"), F.when(F.col("rank") == 1, 1).otherwise(F.col("rank") - 1).alias("rank"), "ord", "id", "score")
    rest = scored.join(F.broadcast(front.select("id").distinct()), "id", "left_anti").join(sections.select("feed_id", "section_name"), "feed_id", "left")
    placed = rest.withColumn("section", F.coalesce("section_name", F.lit("Front page"))).withColumn("rank", F.row_number().over(W.partitionBy("section").orderBy(F.desc("score"), "ord")))
    return opening.unionByName(placed.where(F.col("rank") <= per_section).select(F.lit("section").alias("slot"), "section", "rank", "ord", "id", "score"))


def cap_sources(stories: DataFrame, most: int = 3, salts: int = 64) -> DataFrame:
    """``stories`` with ``over``: whether the story is beyond its outlet's first ``most`` in ``ord`` (those go last).

    The last place that counts is found in two steps, within ``salts`` shares of an outlet and then among the first
    of each, so an outlet with a third of all stories is not sorted in one task.
    """
    keyed = stories.withColumn("outlet_key", outlet(F.col("source"), F.col("id")))
    salted = keyed.select("outlet_key", "ord", F.pmod(F.xxhash64("ord"), F.lit(salts)).alias("salt"))
    few = salted.withColumn("r", F.row_number().over(W.partitionBy("outlet_key", "salt").orderBy("ord"))).where(F.col("r") <= most)
    last = few.withColumn("r", F.row_number().over(W.partitionBy("outlet_key").orderBy("ord"))).where(F.col("r") == most).select("outlet_key", F.col("ord").alias("last"))
    return keyed.join(last, "outlet_key", "left").withColumn("over", F.coalesce(F.col("ord") > F.col("last"), F.lit(False))).drop("outlet_key", "last")


def cap_topics(ranked: DataFrame, most: int = 6, min_shared: int = 2) -> DataFrame:
    """ord, topic, over of a ranked short list (columns ord, title, position).

    Each story joins the first topic that shares ``min_shared`` words with it and adds its words to it, so the
    order decides; the list is a page's worth of stories and is folded in one group.
    """
    ship(ranked.sparkSession)
    rows = ranked.select(F.lit(1).alias("one"), "ord", "position", heat_words(F.col("title")).alias("words"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        topics: list[list] = []
        out = []
        for row in pdf.sort_values("position").itertuples():
            words = set(row.words)
            at = next((i for i, t in enumerate(topics) if len(t[0] & words) >= min_shared), None)
            if at is None:
                topics.append([words, 1])
                at = len(topics) - 1
            else:
                topics[at][0] |= words
                topics[at][1] += 1
            out.append((row.ord, at, topics[at][1] > most))
        return pd.DataFrame(out, columns=["ord", "topic", "over"])

    return rows.groupBy("one").applyInPandas(fold, "ord string, topic int, over boolean")


def new_since(stories: DataFrame, since_ms: int, now_ms: int, gap_ms: int = 600_000) -> DataFrame:
    """Stories published after ``since_ms`` with their clamped time; none on a first run or after a short absence."""
    if not since_ms or now_ms - since_ms < gap_ms:
        return stories.withColumn("t", clamp_ts(F.col("ts"), now_ms)).limit(0)
    return stories.withColumn("t", clamp_ts(F.col("ts"), now_ms)).where(F.col("t") > since_ms)


def topic_heat(stories: DataFrame, now_ms: int, window_hours: float = 12, min_shared: int = 2, share: float = 0.25, floor: int = 12) -> DataFrame:
    """id, ord, heat: how many outlets write about the story's topic.

    Two recent stories are of one topic if they share ``min_shared`` (2) words that are not on too many stories
    (a word is dropped above max(``floor``, ``share`` of the stories)).  Stories never meet each other: each
    emits its pairs of words, the outlets of a pair are made distinct, and a story counts the outlets of all its
    pairs, so a topic that fills the wire costs its outlets, not its stories squared.
    """
    if min_shared != 2:
        raise ValueError("topics are compared on pairs of words")
    recent = stories.where(F.lit(now_ms) - F.coalesce("ts", F.lit(0)) <= int(window_hours * 3_600_000)).select("ord", "id", outlet(F.col("source"), F.col("id")).alias("who"), heat_words(F.col("title")).alias("words"))
    exploded = recent.select("ord", "who", F.explode("words").alias("w"))
    total = recent.agg(F.count(F.lit(1)).alias("n"))
    often = exploded.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    telling = often.where(F.col("df") <= F.greatest(F.lit(float(floor)), total.scalar() * share)).select("w")
    kept = exploded.join(telling, "w").groupBy("ord", "who").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    both = F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, F.greatest(F.size("ws") - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))
    paired = kept.select("ord", "who", F.explode(both).alias("pair"))
    heard = paired.select("pair", "who").distinct()
    voices = recent.select("ord", "who").unionByName(paired.select("ord", "pair").join(heard, "pair").select("ord", "who")).groupBy("ord").agg(F.count_distinct("who").alias("heat"))
    return recent.select("id", "ord").join(voices, "ord")


def word_rules(stories: DataFrame, rules: list[dict], outlets: dict[str, int] | None = None, words: dict[str, int] | None = None) -> DataFrame:
    """ord, rule_score, muted, flagged by user rules and learned weights.

    ``rules``: kind 'boost', 'mute', 'flag' with terms, or 'trust', 'demote' with outlet.  Learned weights of
    absolute value under 2 do not count.  Rules are the user's own short list.
    """
    hay = F.concat_ws(" ", blank(F.col("title")), blank(F.col("descr")), F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " "))
    who = F.lower(blank(F.col("source")))

    def named(terms: list[str]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | hay.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}])\Q{t}\E($|[^\p{{L}}\p{{N}}])")
        return out

    value, muted, flagged = F.lit(0), F.lit(False), F.lit(False)
    for r in rules:
        if r["kind"] == "boost":
            value = value + F.when(named(r["terms"]), 3).otherwise(0)
        elif r["kind"] == "mute":
            muted = muted | named(r["terms"])
        elif r["kind"] == "flag":
            flagged = flagged | named(r["terms"])
        elif r["kind"] in ("trust", "demote"):
            value = value + F.when(F.contains(who, F.lit(r["outlet"].lower())), 2 if r["kind"] == "trust" else -3).otherwise(0)
    strong = {k: v for k, v in (outlets or {}).items() if abs(v) >= 2}
    for k, v in strong.items():
        value = value + F.when(who == k, v).otherwise(0)
    found = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(blank(F.col("title"))), F.lit(r"(\p{L}{4,})"), F.lit(1))), 1, 6)
    for k, v in {k: v for k, v in (words or {}).items() if abs(v) >= 2}.items():
        value = value + F.when(F.array_contains(found, k), v).otherwise(0)
    return stories.select("ord", value.alias("rule_score"), muted.alias("muted"), flagged.alias("flagged"))


