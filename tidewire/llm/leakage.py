"""Finding held-out evaluation passages inside a corpus by spaced-seed hashing.

Texts become words (case, accents, punctuation and spacing ignored).  A spaced seed looks at a window of
words through a fixed mask that ignores some positions, so a substituted word does not hide the window.
Items are hashed at every position, documents at every ``stride``-th one, where stride = min_words - span + 1:
any run of ``min_words`` common words then holds a whole document window.  Where a document's and an item's
hashes meet, the words around the hit are compared along the diagonal, exactly and with substitutions.

Items shorter than ``min_words`` words leak if they stand whole in a document: they are hashed by their first and
last words, and looked up at every position (`short_leaks`).

The items' hashes go to the executors only behind a check of the items' size (held-out sets are of fixed
size); larger sets are joined on the hashes (`leaks(..., broadcast_chars=0)` forces that way).  There a row is a
window: its seed, its place and the words around it, so neither side's texts are sent along with each hit.

Defined results: null, empty and blank texts hold no passage; items without words cannot leak; very long texts
are searched whole; repeated documents and items are each reported; a document that holds a passage twice
reports its longest run; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewire.session import BROADCAST_ROWS, cut_lineage, ship, spread

#: Positions of the window that each seed looks at ('1') or ignores ('0').
MASKS = ("11101011", "11010111")
_WORD = re.compile(r"[^\W_]+")
_ACCENT = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without case and accents."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(_ACCENT.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).casefold())))


def seeds(words: list[str], stride: int) -> Iterator[tuple[int, int]]:
    """(hash, position) of every seed at every ``stride``-th position."""
    for n, mask in enumerate(MASKS):
        at = [i for i, x in enumerate(mask) if x == "1"]
        for p in range(0, len(words) - len(mask) + 1, stride):
            yield xxhash.xxh64_intdigest(" ".join([words[p + i] for i in at]), n) - (1 << 63), p


def overlap(doc: list[str], item: list[str], p: int, q: int, miss_every: int = 8) -> tuple[int, int, int]:
    """(longest exact run, longest run with substitutions, end in doc) on the diagonal through doc[p], item[q].

    The second allows one substituted word in ``miss_every``.
    """
    first = p - min(p, q)
    shift = q - p
    last = min(len(doc), len(item) - shift)
    lo = p
    misses, ok = 0, lo
    while lo > first:
        lo -= 1
        if doc[lo] == item[lo + shift]:
            ok = lo
        else:
            misses += 1
            if misses * miss_every > (p - lo) + miss_every:
                break
    lo = ok
    hi = end = p
    misses = 0
    while hi < last:
        if doc[hi] == item[hi + shift]:
            end = hi + 1
        else:
            misses += 1
            if misses * miss_every > (hi - p) + miss_every:
                break
        hi += 1
    best = run = 0
    for k in range(lo, end):
        run = run + 1 if doc[k] == item[k + shift] else 0
        if run > best:
            best = run
    return best, end - lo, end


def _judge(doc: list[str], hits: Iterator[tuple[int, int, int]], items: dict[int, list[str]]) -> dict[int, tuple[int, int]]:
    done: dict[tuple[int, int], int] = {}
    found: dict[int, tuple[int, int]] = {}
    for p, item_id, q in hits:
        if done.get((item_id, q - p), -1) > p:
            continue
        exact, tolerant, end = overlap(doc, items[item_id], p, q)
        done[item_id, q - p] = end
        old = found.get(item_id, (0, 0))
        found[item_id] = (max(old[0], exact), max(old[1], tolerant))
    return found


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 15, broadcast_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, exact_words, tolerant_words of every document and item that share ``min_words`` words.

    ``docs``: doc_id, text.  ``items``: item_id, item_text.  exact_words: the longest run of equal words;
    tolerant_words: the longest run that allows one substitution in eight words (at least ``min_words``).
    """
    spark = docs.sparkSession
    ship(spark)
    stride = max(1, min_words - max(map(len, MASKS)) + 1)
    known = items.where(F.col("item_text").isNotNull()).select("item_id", "item_text")
    size = known.agg(F.sum(F.length("item_text"))).first()[0] or 0
    schema = "doc_id long, item_id long, exact_words int, tolerant_words int"
    if size <= broadcast_chars:
        index: dict[int, list[tuple[int, int]]] = {}
        texts: dict[int, list[str]] = {}
        for row in known.collect():
            words = texts[row.item_id] = words_of(row.item_text)
            if len(words) >= min_words:
                for h, q in seeds(words, 1):
                    index.setdefault(h, []).append((row.item_id, q))
        shared = spark.sparkContext.broadcast((index, texts))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from tidewire.llm import leakage as own

            at, of = shared.value
            for pdf in batches:
                rows = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    words = own.words_of(text)
                    hits = sorted({(p, i, q) for h, p in own.seeds(words, stride) if h in at for i, q in at[h]})
                    if hits:
                        rows += [(doc_id, i, e, t) for i, (e, t) in own._judge(words, hits, of).items() if t >= min_words]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "exact_words", "tolerant_words"])

        return spread(docs.where(F.length("text") > 0).select("doc_id", "text")).mapInPandas(search, schema)

    # both sides as windows: (seed, id, place), joined on the seed; hits of one diagonal are one candidate
    def hashed(step: int):
        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from tidewire.llm import leakage as own

            for pdf in batches:
                rows = [(i, p, h) for i, text in zip(pdf["id"], pdf["text"]) for h, p in own.seeds(own.words_of(text), step)]
                yield pd.DataFrame(rows, columns=["id", "at", "seed"])

        return make

    texts_of_docs = docs.where(F.length("text") > 0).select(F.col("doc_id").alias("id"), "text")
    texts_of_items = known.select(F.col("item_id").alias("id"), F.col("item_text").alias("text"))
    d = texts_of_docs.mapInPandas(hashed(stride), "id long, at int, seed long").select(F.col("id").alias("doc_id"), F.col("at").alias("p"), "seed")
    i = texts_of_items.mapInPandas(hashed(1), "id long, at int, seed long").select(F.col("id").alias("item_id"), F.col("at").alias("q"), "seed")
    # a document meets an item once: its hits in order, at most one a document window and item place
    hits = d.join(i, "seed").groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_set(F.struct("p", "q"))).alias("hits"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import leakage as own

        for pdf in batches:
            rows = []
            for doc_id, item_id, text, item_text, places in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item_text"], pdf["hits"]):
                words, item = own.words_of(text), own.words_of(item_text)
                rows += [(doc_id, item_id, e, t) for _, (e, t) in own._judge(words, [(x["p"], item_id, x["q"]) for x in places], {item_id: item}).items() if t >= min_words]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "exact_words", "tolerant_words"])

    full = hits.join(docs.select("doc_id", "text"), "doc_id").join(known, "item_id").select("doc_id", "item_id", "text", "item_text", "hits")
    return full.mapInPandas(verify, schema)


def short_leaks(docs: DataFrame, items: DataFrame, min_words: int = 15) -> DataFrame:
    """doc_id, item_id of every document that holds a whole item of fewer than ``min_words`` words.

    The items' texts, joined by single blanks, are compared as keys: a document offers its sequences of the lengths
    that occur among the items, which are fewer than ``min_words``.
    """
    ship(docs.sparkSession)

    def text_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import leakage as own

        for pdf in batches:
            rows = [(i, len(w), " ".join(w)) for i, w in zip(pdf["item_id"], map(own.words_of, pdf["item_text"])) if 0 < len(w) < min_words]
            yield pd.DataFrame(rows, columns=["item_id", "size", "passage"])

    short = cut_lineage(items.where(F.col("item_text").isNotNull()).select("item_id", "item_text").mapInPandas(text_key, "item_id long, size int, passage string"))
    sizes = sorted(r[0] for r in short.select("size").distinct().collect())

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import leakage as own

        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = own.words_of(text)
                rows += [(doc_id, x) for x in {" ".join(words[k : k + n]) for n in sizes for k in range(len(words) - n + 1)}]
            yield pd.DataFrame(rows, columns=["doc_id", "passage"])

    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    held = docs.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(runs, "doc_id long, passage string")
    small = short.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return held.join(F.broadcast(short) if small else short, "passage").select("doc_id", "item_id").distinct()
