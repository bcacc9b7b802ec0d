"""Links in descriptions and pages: cited sources, redirect pages, places."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewire.functions.text import blank, plain_text
from tidewire.operators.extract import meta, paragraphs

#: Lines that sell or recruit.
PROMOTION = r"(?i)sponsor|affiliate|discount|coupon|promo code|subscribe|newsletter|community|join (?:me|us|my)|follow me|patreon|merch|business inquir|checkout today"


def cited_links(description: Column) -> Column:
    """Links of a description's lines that do not promote, each once, without closing punctuation."""
    lines = F.filter(F.split(blank(description), r"\r?\n"), lambda x: ~x.rlike(PROMOTION))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def citable(page: Column) -> Column:
    """Struct(title, site, image, excerpt) of a page that is a story (says so, or has a picture and 600 characters of prose), else null."""
    title = F.coalesce(F.nullif(meta(page, "og:title"), F.lit("")), plain_text(F.regexp_extract(blank(page), r"(?is)<title[^>]*>(.*?)</title>", 1)))
    image = meta(page, "og:image")
    prose = F.array_join(F.filter(paragraphs(page), lambda p: F.length(p) > 80), " ")
    story = meta(page, "og:type").rlike("(?i)article|news") | ((image != "") & (F.length(prose) > 600))
    return F.when((title != "") & story, F.struct(F.left(title, F.lit(200)).alias("title"), meta(page, "og:site_name").alias("site"), F.when(image.rlike("(?i)^https://"), image).otherwise("").alias("image"), F.left(prose, F.lit(180)).alias("excerpt")))


def redirect_signature(page: Column) -> Column:
    """Struct(sg, ts) of a redirect page's signature, else null."""
    sg, ts = (F.regexp_extract(blank(page), rf'data-n-a-{k}="([^"]+)"', 1) for k in ("sg", "ts"))
    return F.when((sg != "") & (ts != ""), F.struct(sg.alias("sg"), ts.alias("ts")))


def position(text: Column) -> Column:
    """Struct(lat, lon) of 'lat, lon' text within the globe, else null."""
    lat, lon = (F.regexp_extract(blank(text), r"^\s*(-?\d{1,2}(?:\.\d+)?)\s*[,; ]\s*(-?\d{1,3}(?:\.\d+)?)\s*$", k).try_cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))
