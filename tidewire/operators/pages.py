"""Page facts that need a parser: article bodies, linked data, entities.  Arrow batches, one page at a time."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.session import ship, spread

_DROP = {"script", "style", "noscript", "template", "nav", "aside", "footer", "header", "form", "svg", "iframe"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
_BLOCK = {"article", "main", "section", "div", "td", "body"}
_PARTS = {"p", "li", "blockquote", "h2", "h3", "h4", "pre"}
_LD = re.compile(r"<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", re.S | re.I)


class _Blocks(HTMLParser):
    """Text, linked text and paragraphs of every block element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = [{"tag": "root", "text": 0, "linked": 0, "parts": []}]
        self.blocks: list[dict] = []
        self.dropped = self.links = 0
        self.part: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        self.dropped += tag in _DROP
        self.links += tag == "a"
        if tag in _BLOCK:
            self.stack.append({"tag": tag, "text": 0, "linked": 0, "parts": []})
        if tag in _PARTS:
            self.part = []

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROP:
            self.dropped = max(0, self.dropped - 1)
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in _PARTS and self.part is not None:
            text = " ".join("".join(self.part).split())
            if text and not self.dropped:
                for b in self.stack:
                    b["parts"].append(text)
            self.part = None
        if tag in _BLOCK and any(b["tag"] == tag for b in self.stack[1:]):
            while len(self.stack) > 1:
                b = self.stack.pop()
                self.blocks.append(b)
                if b["tag"] == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        size = len(data.strip())
        for b in self.stack:
            b["text"] += size
            b["linked"] += size if self.links else 0
        if self.part is not None:
            self.part.append(data)


def article_text(page: str | None, least: int = 200) -> str:
    """The paragraphs of the article element if it holds 400 characters of them, else of the block with most unlinked text; '' below ``least``."""
    if not page:
        return ""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    blocks = parser.blocks + parser.stack
    size = lambda b: sum(map(len, b["parts"]))
    own = [b for b in blocks if b["tag"] == "article" and size(b) >= 400]
    best = max(own, key=size) if own else max(blocks, key=lambda b: (size(b) * (1 - min(0.9, b["linked"] / b["text"] if b["text"] else 0)), -len(b["parts"])))
    body = "\n\n".join(best["parts"])
    return body if len(body) >= least else ""


def linked_data(page: str | None, depth: int = 6) -> dict:
    """headline, published, author, image, body of a page's JSON-LD; the first found of each, '' if absent."""
    out = dict.fromkeys(("headline", "published", "author", "image", "body"), "")
    want = {"headline": "headline", "datePublished": "published", "author": "author", "image": "image", "articleBody": "body"}

    def flat(v: object) -> str:
        if isinstance(v, str):
            return v.strip()
        if isinstance(v, list):
            return next((x for x in map(flat, v) if x), "")
        if isinstance(v, dict):
            return flat(v.get("url") or v.get("name") or v.get("@id") or "")
        return ""

    def walk(node: object, left: int) -> None:
        if left < 0:
            return
        if isinstance(node, list):
            for x in node:
                walk(x, left - 1)
        elif isinstance(node, dict):
            for k, name in want.items():
                if not out[name] and k in node:
                    out[name] = flat(node[k])
            for x in node.values():
                if isinstance(x, (dict, list)):
                    walk(x, left - 1)

    for block in _LD.findall(page or ""):
        try:
            walk(json.loads(block.strip()), depth)
        except ValueError:
            continue
    return out


def page_facts(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, article, headline, published, author, image, body of each page; blanks for null and broken pages."""
    ship(pages.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.operators.pages import article_text as body_of, linked_data as data_of

        for pdf in batches:
            facts = pd.DataFrame([data_of(x) for x in pdf["t"]], columns=["headline", "published", "author", "image", "body"])
            facts.insert(0, "article", [body_of(x) for x in pdf["t"]])
            facts.insert(0, "k", list(pdf["k"]))
            yield facts

    kind = pages.schema[key].dataType.simpleString()
    rows = spread(pages.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInPandas(read, f"k {kind}, article string, headline string, published string, author string, image string, body string").withColumnRenamed("k", key)


def decode_entities(text: Column, passes: int = 2) -> Column:
    """Character references decoded, up to ``passes`` times; null stays null."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            for _ in range(passes):
                y = html.unescape(x) if x and "&" in x else x
                if y == x:
                    break
                x = y
            out.append(x)
        return pd.Series(out, dtype="object")

    return decode(text)
