"""Duplicate stories, stories of one event, and alerts over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.functions.text import blank, cluster_words, entities, is_opinion, jaccard, story_url, strip_publisher, title_key
from tidewire.operators.graph import connected_components
from tidewire.operators.rank import outlet
from tidewire.session import BROADCAST_ROWS, cut_lineage, few

#: What makes a headline news of a death or an event; the look-arounds are the ASCII word boundary, which \\b is not on the JVM.
DEATH = r"(?i)(?<![A-Za-z0-9_])(?:dies|died|has died|passes away|passed away|dead at|death of|found dead|dies at|killed in|slain)(?![A-Za-z0-9_])"
EVENT = r"(?i)(?<![A-Za-z0-9_])(?:earthquake|tsunami|hurricane|tornado|explosion|terror(?:ist)? attack|mass shooting|shooting|plane crash|crash kills|state of emergency|declares war|invasion|missile strike|assassinat\w+|evacuat\w+|nuclear)(?![A-Za-z0-9_])"
#: Words that name no event.
ALERT_STOP = "the and for with from that this after over into amid says said will have has was were been about his her their its new live update updates report reports breaking dies died death passes away aged age star actor actress legend veteran icon"


def _numbered(stories: DataFrame) -> DataFrame:
    """A numeric node id per story for graph work: a hash of the unique ``ord``."""
    return stories.withColumn("node", F.xxhash64("ord"))


def dedupe_stories(stories: DataFrame) -> DataFrame:
    """ord, slot, kept: which stories are one, and which row stands for them.

    Stories fold from left to right: a story joins the slot that its page was first put in, else the slot of the
    last story before it with its title (titles longer than 12 characters), else it opens one.  So every story
    points at one earlier story or at itself, and its slot is the end of that chain; chains are shortened by
    half each round.  Stories that share neither page nor title with another are not moved.  No group of copies is
    gathered: pages are aggregated, titles look one story back, and the row that stands for a slot (an image, then the longer description, then the later time, the earlier one on
    ties) is a maximum.
    """
    keyed = stories.select("ord", story_url(F.col("link")).alias("u"), title_key(F.col("title")).alias("t"), (blank(F.col("image_url")) != "").alias("pictured"), F.length(blank(F.col("descr"))).alias("size"), F.coalesce("ts", F.lit(0)).alias("ts"))
    keyed = cut_lineage(keyed.withColumn("u", F.when(F.col("u") != "", F.col("u"))).withColumn("t", F.when(F.length("t") > 12, F.col("t"))))
    paged = _recurring(keyed.select("ord", "u"), "u")
    pages = paged.groupBy("u").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = paged.join(pages, "u").where("first < ord").select("ord", "first")
    titled = _recurring(keyed.select("ord", "t"), "t")
    titles = titled.select("ord", F.lag("ord").over(W.partitionBy("t").orderBy("ord")).alias("before")).where("before IS NOT NULL")
    # only stories that point at an earlier one are moved
    links = cut_lineage(known.join(titles, "ord", "full_outer").select("ord", F.coalesce("first", "before").alias("at")))
    while True:
        further = links.select(F.col("ord").alias("at"), F.col("at").alias("next"))
        moved = cut_lineage(links.join(further, "at", "left").select("ord", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("ord", "at")
        if not moved.where("moved").limit(1).count():
            break
    linked = cut_lineage(links.unionByName(links.select(F.col("at").alias("ord"), "at").distinct()))
    linked = few(linked, BROADCAST_ROWS // 4)
    slots = keyed.join(linked, "ord").select("ord", F.col("at").alias("slot"), F.struct("pictured", "size", "ts").alias("rank"))
    best = slots.groupBy("slot").agg(F.max("rank").alias("top"))
    stands = slots.join(best, "slot").where(F.col("rank") == F.col("top")).groupBy("slot").agg(F.min("ord").alias("keeper"))
    together = slots.join(stands, "slot").select("ord", "slot", (F.col("ord") == F.col("keeper")).alias("kept"))
    return together.unionByName(keyed.join(linked, "ord", "left_anti").select("ord", F.col("ord").alias("slot"), F.lit(True).alias("kept")))


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key, without those whose key occurs once if the recurring ones are few (by a hash, so some of those may stay)."""
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(F.xxhash64(key).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    again = cut_lineage(counts.where("n > 1").select("h"))
    if again.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows
    return rows.join(F.broadcast(again), F.xxhash64(key) == F.col("h"), "left_semi")


def _keyed(stories: DataFrame, *carry: str) -> DataFrame:
    """What pairs and clusters of stories need of each: one pass over the stories, no text but the title's words."""
    lead = F.struct(
        (~is_opinion(F.col("title"), F.col("link"))).cast("int").alias("a"),
        (blank(F.col("image_url")) != "").cast("int").alias("b"),
        F.length(blank(F.col("descr"))).alias("c"),
        F.coalesce("ts", F.lit(0)).alias("d"),
    )
    return _numbered(stories).select("ord", "node", F.coalesce("ts", F.lit(0)).alias("ts"), cluster_words(F.col("title")).alias("words"), entities(F.col("title")).alias("names"), lead.alias("best"), outlet(F.col("source"), F.col("id")).alias("who"), "report_count", *carry)


def _prefixes(base: DataFrame, share: float, floor: int) -> DataFrame:
    """node, ts, mark, names, w: the words by which a story can meet its like, as hashes.

    Two sets of s and more words that share half of all and three at least share max(3, s/2) words, so the rarest
    word that they share is among the s - max(3, s/2) + 1 rarest words of each.  If they share a telling word, that
    rarest one is telling.  Any order of words that is the same for all stories serves; here it is by count for
    words on more than one story in 5,000 (a list of bounded size), before them the rest by hash.  ``mark`` has a
    bit in 55 for each word, and the number of words; ``names`` is that of the names.
    """
    often = base.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    total = base.count()
    counts = dict(often.where(F.col("df") > total / 5000).select(F.xxhash64("w"), "df").collect())
    most = max(floor, math.floor(total * share))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def marked(words: list[int]) -> int:
            mark = min(len(words), 127)
            for w in words:
                mark |= 1 << (w % 55 + 8)
            return mark

        for pdf in batches:
            nodes, times, marks, names, firsts = [], [], [], [], []
            for node, ts, words, called in zip(pdf["node"], pdf["ts"], pdf["words"], pdf["names"]):
                size = len(words)
                order = sorted((counts.get(w, 0), w) for w in words.tolist())[: size - max(3, (size + 1) // 2) + 1]
                nodes.append(node)
                times.append(ts)
                marks.append(marked(words.tolist()))
                names.append(marked(called.tolist()))
                firsts.append([w for df, w in order if df <= most])
            yield pd.DataFrame({"node": nodes, "ts": times, "mark": marks, "names": names, "firsts": firsts})

    hashed = (F.transform(words, lambda w: F.xxhash64(w)).alias(c) for c, words in (("words", F.col("words")), ("names", F.array_distinct("names"))))
    told = base.where(F.size("words") >= 3).select("node", "ts", *hashed)
    return told.mapInPandas(make, "node long, ts long, mark long, names long, firsts array<long>").select("node", "ts", "mark", "names", F.explode("firsts").alias("w"))


def _event_pairs(base: DataFrame, window_ms: int, share: float, floor: int) -> DataFrame:
    """a, b (nodes) of stories of one event, each pair once; ``base`` is written somewhere."""
    rows = _prefixes(base, share, floor)
    dated, undated = rows.where("ts <> 0"), rows.where("ts = 0").select("node", "mark", "names", "w")
    # a story stands in the slot of its time and in that of its time one window on: of two near stories the later
    # one's slot is one of the earlier one's
    slot = 10 * window_ms
    slots = F.array_distinct(F.array(F.floor(F.col("ts") / slot), F.floor((F.col("ts") + window_ms) / slot)))
    placed = dated.select("node", "ts", "mark", "names", "w", F.explode(slots).alias("slot")).select("node", "ts", "mark", "names", F.xxhash64("w", "slot").alias("key"))

    def may(x: str, y: str) -> Column:
        # words that only one has: at most a third of both together, and never fewer than bits that only one has;
        # the same of names, if both have two
        def alike(c: str) -> Column:
            one, two = F.col(f"{x}.{c}"), F.col(f"{y}.{c}")
            n, m = one.bitwiseAND(127), two.bitwiseAND(127)
            loose = (n == 127) | (m == 127) | (3 * F.bit_count(F.shiftright(one.bitwiseXOR(two), 8)) <= n + m)
            return loose | (n < 2) | (m < 2) if c == "names" else loose

        return alike("mark") & alike("names")

    x, y = placed.alias("x"), placed.alias("y")
    in_time = F.abs(F.col("x.ts") - F.col("y.ts")) <= window_ms
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & in_time & may("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    few = undated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    u, v = (F.broadcast(undated) if few else undated).alias("u"), rows.alias("v")
    loose = v.join(u, (F.col("u.w") == F.col("v.w")) & (F.col("u.node") != F.col("v.node")) & may("u", "v"))
    pairs = cut_lineage(met.unionByName(loose.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b"))).distinct())
    ids = cut_lineage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    asked = base.select("node", "ts", "words", "names").join(F.broadcast(ids) if small else ids, "node", "left_semi")
    one, two = asked.alias("one"), asked.alias("two")
    both = pairs.join(one, F.col("a") == F.col("one.node")).join(two, F.col("b") == F.col("two.node"))
    near = (F.col("one.ts") == 0) | (F.col("two.ts") == 0) | (F.abs(F.col("one.ts") - F.col("two.ts")) <= window_ms)
    alike = (F.size(F.array_intersect("one.words", "two.words")) >= 3) & (jaccard(F.col("one.words"), F.col("two.words")) >= 0.5)
    named = (F.size("one.names") < 2) | (F.size("two.names") < 2) | (jaccard(F.col("one.names"), F.col("two.names")) >= 0.5)
    return both.where(near & alike & named).select("a", "b")


def same_event_pairs(stories: DataFrame, window_ms: int = 129_600_000, share: float = 0.08, floor: int = 30) -> DataFrame:
    """ord_a < ord_b of stories of one event.

    They share at least three title words and half of all, half of their names if both have two, and lie within
    36 hours if both times are known; one of the words they share is not on too many stories
    (max(``floor``, ``share`` of all)).  Stories meet on the rarest of their words and in time (``_prefixes``).
    """
    base = cut_lineage(_keyed(stories).select("ord", "node", "ts", "words", "names"))
    found = cut_lineage(_event_pairs(base, window_ms, share, floor))
    ids = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    known = base.select("node", "ord").join(F.broadcast(ids) if found.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2 else ids, "node", "left_semi")
    one, two = (known.select(F.col("node").alias(x), F.col("ord").alias(f"ord_{x}")) for x in "ab")
    return found.join(one, "a").join(two, "b").select(F.least("ord_a", "ord_b").alias("ord_a"), F.greatest("ord_a", "ord_b").alias("ord_b"))


def cluster_stories(stories: DataFrame, *carry: str) -> DataFrame:
    """ord, cluster (its first story's ord), is_lead, cluster_size, report_count, ``carry`` (other columns) of every story.

    The lead is the best of a cluster: no opinion, an image, the longer description, the later time, the earlier
    place; it carries the number of outlets, or its own count if higher.  A story alone is its own lead and is
    not ordered or counted.
    """
    base = cut_lineage(_keyed(stories, *carry))
    groups = few(cut_lineage(connected_components(_event_pairs(base, 129_600_000, 0.08, 30))))
    rest = base.select("ord", "node", "best", "who", "report_count", *carry)
    members = rest.join(groups, "node")
    ranked = members.withColumn("rank", F.row_number().over(W.partitionBy("component").orderBy(F.col("best").desc(), "ord")))
    facts = members.groupBy("component").agg(F.min("ord").alias("cluster"), F.count(F.lit(1)).alias("cluster_size"), F.count_distinct("who").alias("outlets"))
    together = ranked.join(facts, "component").select("ord", "cluster", (F.col("rank") == 1).alias("is_lead"), "cluster_size", F.greatest("report_count", "outlets").alias("report_count"), *carry)
    alone = rest.join(groups, "node", "left_anti").select("ord", F.col("ord").alias("cluster"), F.lit(True).alias("is_lead"), F.lit(1).cast("long").alias("cluster_size"), F.col("report_count"), *carry)
    return together.unionByName(alone)


def kind_of(title: Column) -> Column:
    """'death' before 'event', else null."""
    return F.when(blank(title).rlike(DEATH), "death").when(blank(title).rlike(EVENT), "event")


def alert_words(title: Column) -> tuple[Column, Column]:
    """(all words, names among them) of a headline, in order of appearance."""
    stops = F.array(*[F.lit(w) for w in ALERT_STOP.split()])
    raw = F.filter(F.split(F.regexp_replace(strip_publisher(title), r"[^\p{L}\p{N}'\s.-]", " "), r"\s+"), lambda w: w != "")
    pairs = F.transform(raw, lambda w, i: F.struct(F.regexp_replace(F.lower(w), r"^[.'-]+|[.'-]+$", "").alias("w"), (w.rlike(r"^\p{Lu}") & ((i > 0) | ((F.length(w) > 1) & (F.size(raw) > 3)))).alias("p")))
    kept = F.filter(pairs, lambda x: (F.length(x["w"]) >= 4) & ~F.array_contains(stops, x["w"]) & ~x["w"].rlike(r"^\d+$"))
    return F.array_distinct(F.transform(kept, lambda x: x["w"])), F.array_distinct(F.transform(F.filter(kept, lambda x: x["p"]), lambda x: x["w"]))


def find_alerts(stories: DataFrame, now_ms: int, window_ms: int = 43_200_000) -> DataFrame:
    """key, level, kind, headline, source_count, ts, n_stories, lead_ord of each corroborated alert.

    Candidates are deaths and events within the window (at most an hour ahead); two are one alert if they share
    two words, one of them a name in both.  Red needs a story that is not local and three outlets for a death,
    four for an event (two if flagged as breaking); amber needs three.
    """
    words, names = alert_words(F.col("title"))
    ahead = F.lit(now_ms) - F.col("ts")
    cands = _numbered(stories).where((F.coalesce("ts", F.lit(0)) > 0) & (ahead <= window_ms) & (ahead >= -3_600_000)).withColumn("kind", kind_of(F.col("title"))).where("kind IS NOT NULL")
    cands = cut_lineage(cands.withColumn("words", words).withColumn("names", names))
    # stories with the same name and the same other word are all pairs of one alert: a star to the first is enough
    both = cands.select("node", "kind", F.explode("names").alias("name"), "words").select("node", "kind", "name", F.explode("words").alias("w")).where("w <> name")
    firsts = both.groupBy("kind", "name", "w").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = both.join(firsts, ["kind", "name", "w"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    groups = connected_components(pairs)
    members = cands.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node"))
    voice = F.regexp_replace(F.regexp_replace(F.lower(blank(F.col("source"))), r"^www\.", ""), r"[^a-z0-9.]", "")
    national = F.col("feed_id").isNull() | (F.col("feed_id") != "local")
    lead = F.struct(national.cast("int").alias("a"), (blank(F.col("image_url")) != "").cast("int").alias("b"), F.col("ts").alias("c"))
    ranked = members.withColumn("first", F.row_number().over(W.partitionBy("g").orderBy("ord"))).withColumn("best", F.row_number().over(W.partitionBy("g").orderBy(lead.desc(), "ord")))
    head = F.when(F.col("first") == 1, F.when(F.size("names") > 0, F.slice("names", 1, 3)).otherwise(F.slice("words", 1, 3)))
    grouped = ranked.groupBy("g", "kind").agg(
        F.count_distinct(F.when(voice != "", voice)).alias("voices"),
        F.max("report_count").alias("carried"),
        F.max(national.cast("int")).alias("national"),
        F.max("breaking").alias("flagged"),
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("n_stories"),
        F.max(F.when(F.col("best") == 1, F.col("ord"))).alias("lead_ord"),
        F.max(F.when(F.col("best") == 1, strip_publisher(F.col("title")))).alias("headline"),
        F.max(head).alias("head"),
    )
    n = F.greatest("voices", "carried")
    level = F.when((F.col("national") == 1) & ((n >= F.when(F.col("kind") == "death", 3).otherwise(4)) | ((F.col("flagged") == 1) & (n >= 2))), "red").when(n >= 3, "amber")
    return grouped.select(F.concat_ws(":", "kind", F.array_join(F.array_sort("head"), "-")).alias("key"), level.alias("level"), "kind", "headline", n.alias("source_count"), "ts", "n_stories", "lead_ord").where("level IS NOT NULL")
