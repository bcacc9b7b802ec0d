"""Encoding a corpus with a public byte-level BPE vocabulary, and decoding it again.

Texts longer than ``chunk_chars`` are split before single spaces that follow a letter or digit: the
pre-splitting pattern never joins such a space to what stands before it, so the pieces encode to the ids of
the whole text, and no worker holds the pieces of an unbounded text at once.  Decoding joins the raw bytes
of the ids before reading them as UTF-8, since one character may span several ids.

Defined results: the ids of null and empty texts are an empty list; strings of special tokens are ordinary
text; a text without safe boundary is encoded whole; repeated texts of a batch are encoded once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.session import ship, spread

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_LOADED: dict = {}


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def encoding(raw: bytes):
    """The tokenizer of a rank file's bytes, built once per process."""
    key = (len(raw), hash(raw))
    if key not in _LOADED:
        import tiktoken

        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=read_ranks(raw), special_tokens={})
    return _LOADED[key]


def pieces(text: str, chunk_chars: int) -> Iterator[str]:
    """Parts of ``text`` of about ``chunk_chars`` whose ids, joined, are the ids of ``text``."""
    start = 0
    while len(text) - start > chunk_chars:
        m = _SAFE.search(text, start + chunk_chars)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def encode_text(enc, text: str, chunk_chars: int = 1 << 16) -> list[int]:
    """The ids of one text."""
    if len(text) <= chunk_chars:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, chunk_chars) for i in enc.encode_ordinary(part)]


def _file_bytes(spark, rank_file: str) -> bytes:
    with open(rank_file, "rb") as f:
        return f.read()


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str = RANK_FILE, chunk_chars: int = 1 << 16) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row.  The rank file (of fixed size) goes to every executor."""
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(_file_bytes(spark, rank_file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewire.llm.tokenizer import encode_text as one, encoding as load

        enc = load(ranks.value)
        for batch in batches:
            flat, offsets, seen = [], [0], {}
            for value in batch.column(1).to_pylist():
                if value:
                    ids = seen.get(value)
                    if ids is None:
                        ids = one(enc, value, chunk_chars)
                        if len(value) < 20_000:
                            seen[value] = ids
                    flat.extend(ids)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(encode, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", rank_file: str = RANK_FILE) -> DataFrame:
    """``key`` and ``text`` of rows with ``ids``; null ids give null, bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(_file_bytes(spark, rank_file))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewire.llm.tokenizer import encoding as load

        enc = load(ranks.value)
        for batch in batches:
            texts = [None if ids is None else b"".join(enc.decode_tokens_bytes(ids)).decode("utf-8", errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col("ids")).mapInArrow(decode, f"k {kind}, text string").select(F.col("k").alias(key), "text")
