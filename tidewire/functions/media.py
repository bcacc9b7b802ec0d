"""Pictures and addresses: candidates, sizes, identities and fallbacks."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F

from tidewire.functions.text import blank


def best_of_srcset(srcset: Column) -> Column:
    """Struct(url, w) of the widest entry of a srcset; a density counts 1,000 a step; null if there is none."""
    parts = F.filter(F.split(F.trim(blank(srcset)), r",\s+(?=\S)"), lambda p: F.trim(p) != "")
    size = lambda d: F.when(d.rlike(r"(?i)^\d+w$"), F.regexp_extract(d, r"^(\d+)", 1).try_cast("int")).when(d.rlike(r"(?i)^[\d.]+x$"), F.floor(F.regexp_extract(d, r"^([\d.]+)", 1).try_cast("double") * 1000 + 0.5).cast("int")).otherwise(0)
    sized = F.transform(parts, lambda p, i: F.struct(size(F.coalesce(F.get(F.split(F.trim(p), r"\s+"), F.lit(1)), F.lit(""))).alias("w"), (-i).alias("i"), F.split(F.trim(p), r"\s+")[0].alias("url")))
    best = F.array_max(sized)
    return F.when(F.size(sized) > 0, F.struct(best["url"].alias("url"), best["w"].alias("w")))


def absolute_url(url: Column, base: Column) -> Column:
    """``url`` resolved against ``base``; null unless the result is a web address."""

    @F.pandas_udf("string")
    def join(u: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(u, b):
            try:
                z = urljoin(y or "", x.strip()) if x and x.strip() else None
            except ValueError:
                z = None
            out.append(z if z and z.lower().startswith(("http://", "https://")) else None)
        return pd.Series(out, dtype="object")

    return join(url, base)


def best_image(candidates: Column, trust: dict[str, int]) -> Column:
    """The url of the best of array<struct(url, w, h, via)>: of those at least 600 wide or 300,000 pixels the largest, else the most trusted, else the first.

    ``trust``: rank by ``via``, lower is better.
    """
    rank = F.lit(99)
    big = F.filter(candidates, lambda c: (c["w"] >= 600) | (c["w"] * c["h"] >= 300_000))

    def trusted(c: Column) -> Column:
        out = rank
        for via, n in trust.items():
            out = F.when(c["via"] == via, n).otherwise(out)
        return out

    by_size = F.array_max(F.transform(big, lambda c, i: F.struct((c["w"] * F.greatest(c["h"], F.lit(1))).alias("a"), (-trusted(c)).alias("t"), (-i).alias("i"), c["url"].alias("url"))))
    by_trust = F.array_min(F.transform(candidates, lambda c, i: F.struct(trusted(c).alias("t"), i.alias("i"), c["url"].alias("url"))))
    return F.when(F.size(big) > 0, by_size["url"]).when(F.size(candidates) > 0, by_trust["url"])


def image_key(url: Column) -> Column:
    """Identity of a picture whatever its size: host and path, without query, size suffix and size folder, lower case."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(blank(url), r"^[a-zA-Z]+://", "")), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"-\d{2,4}x\d{2,4}(?=\.[a-z]+$)", ""), r"/(?:w|h|width|height)[_=-]?\d{2,4}(?=/)", "")


def fallback_image(image: Column, categories: Column, by_category: dict[str, str], pool: list[str], ident: Column) -> Column:
    """A valid picture itself, else that of the first known category, else one of ``pool`` by the sum of the id's character codes."""
    known = F.create_map(*[F.lit(x) for kv in by_category.items() for x in kv])
    hit = F.get(F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull()), F.lit(0))
    codes = F.aggregate(F.filter(F.split(blank(ident), ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc + F.ascii(c))
    return F.when(blank(image).rlike("(?i)^https?://"), image).otherwise(F.coalesce(hit, F.element_at(F.array(*[F.lit(x) for x in pool]), (codes % len(pool) + 1).cast("int"))))


def needs_image(image: Column, link: Column) -> Column:
    """Whether a linked row has no picture of its own."""
    return (blank(image).isin("") | blank(image).rlike(r"(?i)placeholder|unsplash\.com|picsum")) & (blank(link) != "")
