"""Keeping only the main body of pages: tree scoring, and the wording of what the trees leave outside.

A page (one block per line) is read into a tree.  Every paragraph passes points for its length and commas,
discounted by its link density, to its parent and half of them to its grandparent; the best container and
the siblings that hold prose of their own are kept (`score_page`).  What stands outside them is furniture.

Furniture also stands between the paragraphs of the kept part, and in plain and markdown texts, which have no
tree.  There lines without sentence end that are neither headings nor the page's own headline (teasers, bylines,
menus) and lines that are mostly links are furniture; finished sentences and headings are judged by their words.
`learn_wording` counts, over a bounded sample of pages, in how many sentences inside and outside the kept
containers each word stands, and a line is furniture if its words are likelier outside.  No phrase is given
by hand: without the trees there is no wording, and prose counts as story.

Defined results for odd input: null and blank texts have no lines; lines that show no text (tags, script,
blank) are never reported; very long lines are judged whole; repeated rows are judged each by itself; without
any page to learn from, finished sentences outside trees are story.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewire.session import ship, spread

_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
_ANY_TAG = re.compile(r"<!--.*?-->|<[^<>]*>", re.S)
_SCRIPT = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a>", re.S | re.I)
_MD_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_END = re.compile(r"[.!?…][\"”“»’'\)\]*_]*(?:\s*[^\w\s.!?]+)?$")
_INNER_END = re.compile(r"[^\W\d_]{2}[.!?][\"”“»’'\)]* +[\"“„«¿¡]?[^\W\d_]")
_MARKS = re.compile(r"^(?:#{1,6}\s+|>\s*|[-*+•]\s+|\d+[.)]\s+)+")
_HEADING = re.compile(r"^#{1,6}\s+\S")
_WORD = re.compile(r"[^\W\d_]+|\d+|[©|:]")
#: A line whose only tag holds its whole text, or that has no tag but breaks at its end.
_SIMPLE = re.compile(r"^(?:<(p|li|blockquote|span|h[1-6])(?:\s[^<>]*)?>)?([^<]*)(?:</\1>)?(?:<br\s*/?>)*\s*$")
#: A sibling of the best container is story if its prose scores this share of the container's.
SIBLING_SHARE = 0.2
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = {"p", "div", "li", "td", "th", "blockquote", "span", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "dd", "dt", "a", "aside"}



class Wording:
    """What the words of a line say: log odds of standing outside the story, summed over its distinct words.

    >>> w = Wording({"cookies": 4.0, "harbour": -2.0}, -1.0)
    >>> w.is_furniture("We use cookies."), w.is_furniture("The harbour sells cookies and harbour cookies.")
    (True, True)
    """

    def __init__(self, weights: dict[str, float] | None = None, bias: float = 0.0):
        self.weights, self.bias = weights or {}, bias
        self._known: dict[str, bool] = {}

    def score(self, text: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(w, 0.0) for w in words_of(text))

    def is_furniture(self, text: str) -> bool:
        """Whether the line is likelier outside; short lines, which repeat, are remembered."""
        if not self.weights:
            return False
        if len(text) > 160:
            return self.score(text) > 0
        known = self._known.get(text)
        if known is None:
            known = self.score(text) > 0
            if len(self._known) < 50_000:
                self._known[text] = known
        return known


def words_of(text: str) -> set[str]:
    """The distinct words of a line, all figures as one, its first word also as such."""
    found = _WORD.findall(text.lower())
    words = {"0" if w[0].isdigit() else w for w in found}
    if found:
        words.add("^" + found[0])
    return words


def visible(line: str) -> str:
    """The text a reader sees of an HTML line, white space collapsed."""
    if "<" in line:
        line = _ANY_TAG.sub("", _SCRIPT.sub("", line) if "<s" in line.lower() else line)
    if "&" in line:
        line = html.unescape(line)
    return " ".join(line.split())


def _bare(text: str) -> tuple[str, str]:
    """A line with the texts of its links only, and that without its list, quote and heading marks."""
    linked = _MD_LINK.sub(r"\1", text) if "](" in text else text
    return linked, linked if linked[0].isalpha() else _MARKS.sub("", linked).strip()


def _is_prose(bare: str) -> bool:
    return bool(_END.search(bare, max(0, len(bare) - 40)) or (len(bare) > 100 and _INNER_END.search(bare)))


def line_role(text: str, heading: bool, own_title: str | None, wording: Wording) -> str:
    """'blank', 'story' or 'furniture' of one line's visible text."""
    if not text:
        return "blank"
    heading = heading or bool(_HEADING.match(text))
    linked, bare = _bare(text)
    if not bare:
        return "blank"
    if own_title and bare.lower() == own_title:
        return "story"
    if not heading and not _is_prose(bare):
        return "furniture"
    if wording.is_furniture(bare):
        return "furniture"
    if not heading and linked != text and _MARKS.sub("", _MD_LINK.sub("", text)).strip(" .|·–-") == "":
        return "furniture"
    return "story"


class _Node:
    __slots__ = ("tag", "parent", "score", "text", "linked")

    def __init__(self, tag: str, parent: "_Node | None"):
        self.tag, self.parent, self.score, self.text, self.linked = tag, parent, 0.0, 0, 0


def _points(text: str) -> float:
    """What a line of prose is worth before its links are discounted."""
    return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3) if len(text) >= 25 and _END.search(text) else 0.0


def _within(node: "_Node | None", kept: "set[_Node]") -> bool:
    while node is not None and node not in kept:
        node = node.parent
    return node is not None


def score_page(lines: list[str]) -> list[tuple[str, float, bool, str]]:
    """(visible text, link density, kept, innermost tag) of each line of a page."""
    root = node = _Node("root", None)
    seen: list[tuple[str, float, _Node, str]] = []
    containers = [root]
    script = False
    for line in lines:
        simple = None if script else _SIMPLE.match(line)
        if simple:
            text = " ".join((html.unescape(simple[2]) if "&" in line else simple[2]).split())
            length = len(text)
            if length >= 25 and _END.search(text, length - 20):
                points = 1 + text.count(",") + min(length / 100, 3)
                node.score += points
                if node.parent is not None:
                    node.parent.score += points / 2
            node.text += length
            seen.append((text, 0.0, node, simple[1] or ""))
            continue
        if script or "<script" in line or "<style" in line:
            closed = "</script" in line or "</style" in line
            opened = "<script" in line or "<style" in line
            script = (script or opened) and not closed
            if script or _ANY_TAG.sub("", _SCRIPT.sub("", line)).strip() == "" or not opened:
                seen.append(("", 0.0, node, ""))
                continue
        at, tag = node, ""
        for m in _TAG.finditer(line):
            closing, name = m.group(1), m.group(2).lower()
            if name in _VOID or m.group(3):
                continue
            if closing:
                up = node
                while up is not root and up.tag != name:
                    up = up.parent
                if up is not root:
                    node = up.parent
            else:
                node = _Node(name, node)
                if name not in _BLOCKS or name in ("div", "td", "aside"):
                    containers.append(node)
                if not tag or name != "a":
                    tag = name
                at = node
        text = visible(line)
        if not text:
            seen.append(("", 0.0, at, tag))
            continue
        linked = sum(len(visible(x)) for x in _LINK.findall(line)) if "<a" in line else 0
        if tag == "a" and not linked:
            linked = len(text)
        density = min(1.0, linked / len(text))
        holder = at.parent if at.tag in _BLOCKS and at.parent is not None else at
        if holder.tag == "a" and holder.parent is not None:
            holder = holder.parent
        if holder.tag in _BLOCKS and holder.tag not in ("div", "td", "aside") and holder.parent is not None:
            holder = holder.parent
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - density) if len(text) >= 25 and _END.search(text) else 0.0
        holder.score += points
        if holder.parent is not None:
            holder.parent.score += points / 2
        holder.text += len(text)
        holder.linked += linked
        seen.append((text, density, holder, tag))
    best = max(containers, key=lambda n: n.score * (1 - (n.linked / n.text if n.text else 0)))
    # siblings of the best container, as wholes: prose that stands up to that of the container, with few links
    kept = {best}
    if best.parent is not None:
        branches: dict[_Node, list[float]] = {}
        for text, density, holder, tag in seen:
            up = holder
            while up is not root and up.parent is not best.parent:
                up = up.parent
            if text and up is not root and up is not best:
                sums = branches.setdefault(up, [0.0, 0.0, 0.0])
                sums[0] += _points(text) * (1 - density)
                sums[1] += len(text)
                sums[2] += len(text) * density
        own = sum(_points(text) * (1 - density) for text, density, holder, tag in seen if _within(holder, kept))
        kept |= {n for n, (points, length, linked) in branches.items() if points >= SIBLING_SHARE * own and linked < 0.25 * length}
    return [(text, density, _within(holder, kept), tag) for text, density, holder, tag in seen]


def page_roles(text: str | None, title: str | None, is_html: bool, wording: Wording) -> list[str]:
    """The role of each line of a text: 'blank', 'story' or 'furniture'."""
    if not text:
        return []
    own = visible(title).lower() if title else None
    lines = text.split("\n")
    if not is_html:
        return [line_role(visible(x) if "&" in x or "<" in x else " ".join(x.split()), False, own, wording) for x in lines]
    roles = []
    for shown, density, inside, tag in score_page(lines):
        if not shown:
            roles.append("blank")
        elif own and shown.lower() == own and tag == "h1":
            roles.append("story")
        elif not inside or density > 0.5:
            roles.append("furniture")
        else:
            roles.append(line_role(shown, tag in _HEADINGS, own, wording))
    return roles


def training_lines(text: str, title: str | None) -> Iterator[tuple[bool, list[str]]]:
    """(kept by the tree, its words) of each finished sentence and heading of a page."""
    own = visible(title).lower() if title else None
    for shown, density, inside, tag in score_page(text.split("\n")):
        if shown and shown.lower() != own:
            bare = _bare(shown)[1]
            if bare and (tag in _HEADINGS or _is_prose(bare)):
                yield inside and density <= 0.5, sorted(words_of(bare))


def fit_wording(lines: Iterable[tuple[bool, list[str]]], least: int = 3, rounds: int = 4, sure: float = 4.0) -> Wording:
    """Naive Bayes over the words of lines (kept by the tree, words), each counted as often as it is given.

    What trees keep holds some furniture, and what they leave some story: each round, lines whose words are
    ``sure`` of the other side than the tree change sides before they are counted again.  Words that stand in
    fewer than ``least`` lines say nothing.
    """
    lines = list(lines)
    wording = Wording()
    for _ in range(rounds):
        counts: dict[str, list[int]] = {}
        totals = [0, 0]
        for kept, words in lines:
            score = wording.bias + sum(wording.weights.get(w, 0.0) for w in words)
            outside = not kept if abs(score) < sure else score > 0
            totals[outside] += 1
            for w in words:
                counts.setdefault(w, [0, 0])[outside] += 1
        if not totals[1] or not totals[0]:
            return Wording()
        weights = {
            w: log((outside + 0.5) / (totals[1] + 1)) - log((inside + 0.5) / (totals[0] + 1))
            for w, (inside, outside) in counts.items()
            if inside + outside >= least
        }
        wording = Wording(weights, log(totals[1] / totals[0]))
    return wording


def learn_wording(pages: DataFrame, n_pages: int = 3000) -> Wording:
    """The wording of what stands outside the stories of ``pages`` (rec_id, title, body in HTML).

    About ``n_pages`` pages, chosen by a hash of their ids and twice as many at most, bound what is gathered:
    the words of their lines, each line once a page.
    """
    ship(pages.sparkSession)
    some = pages.where(F.col("body").isNotNull() & F.col("body").contains("<"))
    every = max(1, some.count() // n_pages)
    picked = some.where(F.pmod(F.xxhash64("rec_id"), F.lit(every)) == 0).select("rec_id", "title", "body").orderBy(F.xxhash64("rec_id"), "rec_id").limit(2 * n_pages)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm.boilerplate import training_lines as lines_of

        for pdf in batches:
            found = [(kept, " ".join(words)) for body, title in zip(pdf["body"], pdf["title"]) for kept, words in lines_of(body, title)]
            yield pd.DataFrame({"kept": pd.Series([k for k, _ in found], dtype="bool"), "words": pd.Series([w for _, w in found], dtype="object")})

    return fit_wording((r.kept, r.words.split(" ")) for r in spread(picked).mapInPandas(label, "kept boolean, words string").collect())


def furniture_lines(records: DataFrame, wording: Wording) -> DataFrame:
    """rec_table, rec_id, line_no of each visible line outside the story.

    ``records``: rec_table, rec_id, title, body, is_html.
    """
    ship(records.sparkSession)
    weights, bias = wording.weights, wording.bias

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm.boilerplate import Wording as Words, page_roles as roles_of

        words = Words(weights, bias)
        for pdf in batches:
            tables, ids, numbers = [], [], []
            for t, i, title, body, is_html in zip(pdf["rec_table"], pdf["rec_id"], pdf["title"], pdf["body"], pdf["is_html"]):
                for n, role in enumerate(roles_of(body, title, is_html, words), 1):
                    if role == "furniture":
                        tables.append(t)
                        ids.append(i)
                        numbers.append(n)
            if ids:
                yield pd.DataFrame({"rec_table": tables, "rec_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(numbers, dtype="int32")})

    rows = records.where(F.col("body").isNotNull() & (F.length("body") > 0)).select("rec_table", "rec_id", "title", "body", "is_html")
    return spread(rows).mapInPandas(judge, "rec_table string, rec_id long, line_no int")


def main_text(records: DataFrame, wording: Wording) -> DataFrame:
    """rec_table, rec_id and ``main``: the visible story lines joined by line breaks ('' if none, null for null)."""
    ship(records.sparkSession)
    weights, bias = wording.weights, wording.bias

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm.boilerplate import Wording as Words, page_roles as roles_of, visible as shown

        words = Words(weights, bias)
        for pdf in batches:
            out = pdf[["rec_table", "rec_id"]].copy()
            out["main"] = [
                None if body is None else "\n".join(shown(x) if is_html else x for x, r in zip(body.split("\n"), roles_of(body, title, is_html, words)) if r == "story")
                for title, body, is_html in zip(pdf["title"], pdf["body"], pdf["is_html"])
            ]
            yield out

    return spread(records.select("rec_table", "rec_id", "title", "body", "is_html")).mapInPandas(strip, "rec_table string, rec_id long, main string")
