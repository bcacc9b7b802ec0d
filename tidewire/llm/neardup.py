"""Near-duplicate groups by blocks over fingerprints.

The fingerprint of a text is a string of ``SYMBOLS`` minhash symbols over its distinct three-word sequences;
two texts share a symbol with the probability of their Jaccard similarity.  As many blocks of four symbols are
taken from it, so laid that two blocks have one symbol in common at most, and rows are joined on blocks.  A pair
shares no block (by simulation) once in 4,000 pairs at the threshold of 0.45 and once in 400,000 at 0.5.
(A pair at that threshold differs in more than half of its symbols, so no split of a fingerprint into blocks
has the pigeonhole guarantee.)  Unlike texts of one wire are at a similarity of about 0.006; with blocks of three
symbols there would be 170 times as many candidates among them, and these grow with the square of the rows.

Candidates are decided on the Hamming distance of their fingerprints (two bits a symbol) where that is six standard
deviations from what a pair at the threshold has (wrong once in 500 million), else on the sequences themselves;
groups close under chains.  Sequences are compared only for pairs that the decided ones leave in two groups.

No group is expanded into all pairs: exact copies are first reduced to one representative; within a block
every member is compared with the block's first member only, and just the members that this leaves outside its group
are compared with the rest of their block.  Links between members that hang together already cannot change
the groups, so none that matters is lost.

Defined results: texts without any word join no group; texts of one or two words count as one sequence;
nulls in title, description or content are empty; very long texts count whole; repeated rows are one group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.boilerplate import Wording
from tidewire.operators.graph import connected_components
from tidewire.session import BROADCAST_ROWS, cut_lineage, ship, spread

SYMBOLS = 256
#: Bits of a symbol in the comparison of two fingerprints.
PLANES = 2
#: A block is the symbols at these distances from its number, around the end; the distances' differences are distinct.
OFFSETS = (0, 17, 59, 131)
_WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_PLACE = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Signed 64-bit hashes of words, the first 300,000 of a process remembered."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word) - (1 << 63)
        if len(self) < 300_000:
            self[word] = h
        return h


_WORDS = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sequences(text: str, width: int = 3) -> np.ndarray:
    """Distinct 64-bit hashes of the sequences of ``width`` words; shorter texts count as one sequence."""
    found = _WORD.findall(text.lower().replace("_", " "))
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(_WORDS.__getitem__, found), np.int64, len(found)).view(np.uint64)
    n = max(1, len(words) - width + 1)
    total = words[:n] * _PLACE[0]
    for k in range(1, min(width, len(words))):
        total += words[k : k + n] * _PLACE[k % 16]
    return np.unique(_mix(total))


def fingerprint(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The symbols, of 16 bits each, and their ``PLANES`` lowest bits, a plane of all symbols after the other."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), 1024):
        least = np.minimum(least, (low[i : i + 1024, None] * _A + _B).min(axis=0))
    symbols = _mix(least.astype(np.uint64)).astype(np.uint16)
    return symbols.astype("<u2").tobytes(), np.packbits(symbols >> np.arange(PLANES, dtype=np.uint16)[:, None] & 1, axis=1).tobytes()


def block_keys(symbols: list[bytes]) -> np.ndarray:
    """The key of each block of each fingerprint, with the block's number above its 32 bits."""
    each = np.frombuffer(b"".join(symbols), "<u2").reshape(len(symbols), SYMBOLS).astype(np.uint64)
    keys = np.zeros_like(each)
    for k, at in enumerate(OFFSETS):
        keys += np.roll(each, -at, axis=1) * _PLACE[k]
    return ((_mix(keys) >> np.uint64(32)) | (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(32))).view(np.int64)


def _joined(pdf: pd.DataFrame, wording: Wording) -> Iterator[str]:
    from tidewire.llm.boilerplate import page_roles

    for title, description, content in zip(pdf["title"], pdf["description"], pdf["content"]):
        body = "\n".join(x for x, role in zip(content.split("\n"), page_roles(content, title, False, wording)) if role == "story") if content else ""
        yield "\n".join((title or "", description or "", body))


def fingerprints(articles: DataFrame, wording: Wording) -> DataFrame:
    """row_id, digest (of the set of sequences), symbols, bits, n (sequences); rows without words are left out."""
    ship(articles.sparkSession)
    weights, bias = wording.weights, wording.bias

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import neardup as own

        words = own.Wording(weights, bias)
        for pdf in batches:
            ids, digests, prints, sizes = [], [], [], []
            for row_id, text in zip(pdf["row_id"], own._joined(pdf, words)):
                hashes = own.sequences(text)
                if len(hashes):
                    ids.append(row_id)
                    digests.append(xxhash.xxh128_digest(hashes.tobytes()))
                    prints.append(own.fingerprint(hashes))
                    sizes.append(len(hashes))
            if ids:
                yield pd.DataFrame({"row_id": pd.Series(ids, dtype="int64"), "digest": digests, "symbols": [x for x, _ in prints], "bits": [b for _, b in prints], "n": pd.Series(sizes, dtype="int32")})

    return spread(articles.select("row_id", "title", "description", "content")).mapInPandas(make, "row_id long, digest binary, symbols binary, bits binary, n int")


def _blocks(firsts: DataFrame) -> DataFrame:
    """row_id and the key of each of its blocks."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import neardup as own

        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                yield pd.DataFrame({"row_id": part["row_id"], "blocks": list(own.block_keys(part["symbols"].tolist()))})

    return firsts.select("row_id", "symbols").mapInPandas(make, "row_id long, blocks array<long>").select("row_id", F.explode("blocks").alias("block"))


def _exact(pairs: DataFrame, articles: DataFrame, wording: Wording, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose sequences reach the threshold."""
    ids = cut_lineage(pairs.select(F.col("a").alias("row_id")).union(pairs.select("b")).distinct())
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    weights, bias = wording.weights, wording.bias
    asked = articles.select("row_id", "title", "description", "content").join(F.broadcast(ids) if small else ids, "row_id", "left_semi")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import neardup as own

        words = own.Wording(weights, bias)
        for pdf in batches:
            sets = [own.sequences(x).view(np.int64).tolist() for x in own._joined(pdf, words)]
            yield pd.DataFrame({"row_id": pdf["row_id"], "set": sets})

    sets = cut_lineage(asked.mapInPandas(make, "row_id long, set array<long>"))
    joined = pairs.join(sets.select(F.col("row_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("row_id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return joined.where(common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b")


def _near(pairs: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by the distance of their fingerprints, and whether they surely do."""
    lanes = SYMBOLS // 64
    words = [F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}") for i in range(PLANES * lanes)]
    side = firsts.select("row_id", "n", F.array(*words).alias("bits"))
    left, right = (side.select(F.col("row_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    # symbols are equal if they are in all planes
    other = [[F.col("bitsa")[p * lanes + i].bitwiseXOR(F.col("bitsb")[p * lanes + i]) for p in range(PLANES)] for i in range(lanes)]
    differ = sum(F.bit_count(reduce(Column.bitwiseOR, planes)) for planes in other)
    share = (1 - threshold) * (1 - 0.5**PLANES)
    unlike = SYMBOLS * share
    spread_of = 6 * (unlike * (1 - share)) ** 0.5
    able = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    return cut_lineage(pairs.join(left, "a").join(right, "b").where(able & (differ <= int(unlike + spread_of))).select("a", "b", (differ < unlike - spread_of).alias("sure")))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose rows do not hang together by ``groups`` (node, component), with the groups' names in_a and in_b."""
    x, y = (groups.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in "ab")
    joined = pairs.join(x, "a", "left").join(y, "b", "left").withColumn("in_a", F.coalesce("in_a", "a")).withColumn("in_b", F.coalesce("in_b", "b"))
    return joined.where("in_a <> in_b")


def near_duplicate_groups(articles: DataFrame, wording: Wording = Wording(), threshold: float = 0.45) -> DataFrame:
    """row_id, group_id (its smallest row_id) of every row with words; rows without partner are their own group.

    ``articles``: row_id (unique), title, description, content; ``wording`` tells which finished sentences of a
    content stand outside its story and are left out.
    """
    prints = cut_lineage(fingerprints(articles, wording))
    first_of = prints.groupBy("digest").agg(F.min("row_id").alias("first"))
    copies = cut_lineage(prints.select("row_id", "digest").join(first_of, "digest").where("row_id <> first").select("row_id", "first"))
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
        firsts = prints.drop("digest").join(copies, "row_id", "left_anti")
    else:
        # grouped anew at each use: only the columns used are shuffled, copies fold before the shuffle
        firsts = prints.groupBy("digest").agg(*(F.min_by(c, "row_id").alias(c) for c in ("symbols", "bits", "n")), F.min("row_id").alias("row_id"))
    keyed = _blocks(firsts)
    block = W.partitionBy("block")
    blocked = keyed.select("block", "row_id", F.min("row_id").over(block).alias("head"), F.count(F.lit(1)).over(block).alias("n"))
    members = cut_lineage(blocked.where("n > 1 AND row_id <> head"))
    stars = members.select(F.col("head").alias("a"), F.col("row_id").alias("b")).distinct()
    near = _near(stars, firsts, threshold)
    sure = connected_components(near.where("sure"))
    found = cut_lineage(_exact(cut_lineage(_apart(near.where("NOT sure"), sure).select("a", "b")), articles, wording, threshold))
    # members that do not hang together with their block's head meet those of the block outside their group
    loose = _apart(members.where("n > 2").select("block", F.col("head").alias("a"), F.col("row_id").alias("b")), sure).join(found, ["a", "b"], "left_anti")
    rest = loose.select("block", F.col("b").alias("x")).join(members.select("block", F.col("row_id").alias("y")), "block").where("x <> y")
    more = _apart(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), sure).select("a", "b")
    further = _near(more, firsts, threshold)
    found = found.unionByName(further.where("sure").select("a", "b")).unionByName(_exact(further.where("NOT sure").select("a", "b"), articles, wording, threshold))
    # the groups of the sure links are the nodes of the rest
    joint = connected_components(_apart(found, sure).select("in_a", "in_b"), "in_a", "in_b")
    alone = joint.join(sure.select("node"), "node", "left_anti").select("node", F.col("component").alias("whole"))
    groups = sure.join(joint.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(alone.select("node", F.col("whole").alias("component")))
    return (
        prints.select("row_id")
        .join(copies, "row_id", "left")
        .select("row_id", F.coalesce("first", "row_id").alias("first"))
        .join(groups, F.col("first") == F.col("node"), "left")
        .select("row_id", F.coalesce("component", "first").alias("group_id"))
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """row_id_a < row_id_b of every two rows of one group."""
    many = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    rows = groups.join(many, "group_id")
    a, b = rows.select("group_id", F.col("row_id").alias("row_id_a")), rows.select("group_id", F.col("row_id").alias("row_id_b"))
    return a.join(b, "group_id").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
