"""Feed documents (RSS and Atom) as rows, by column expressions over (feed_id, xml)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.functions.text import blank, plain_text

#: Fixed value: the largest feed document that is read, in characters.
MOST_CHARS = 4 * 1024 * 1024
#: Pictures that are no pictures of a story.
JUNK_IMAGE = r"(?i)(?:^data:|\.svg|\.ico|pixel|beacon|spacer|gravatar|feedburner|doubleclick|/1x1|blank\.gif)"


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, char)
    return text


def inner(xml: Column, tag: str) -> Column:
    """The content of the first ``tag``: character data as it stands, '' if absent."""
    body = F.trim(F.regexp_extract(xml, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1))
    data = F.regexp_extract(body, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
    return F.when(body.rlike(r"(?s)^<!\[CDATA\[.*\]\]>$"), data).otherwise(body)


def text_construct(xml: Column, tag: str) -> Column:
    """An Atom text construct: character data raw, html unescaped once, xhtml without its outer div, text as is."""
    kind = F.lower(F.regexp_extract(xml, rf"(?is)<{tag}\b[^>]*\btype\s*=\s*[\"']([^\"']*)[\"']", 1))
    body = inner(xml, tag)
    raw = xml.rlike(rf"(?is)<{tag}(?:\s[^>]*)?>\s*<!\[CDATA\[")
    return F.when(raw, body).when(kind == "html", _unescape(body)).when(kind == "xhtml", F.regexp_replace(F.regexp_replace(body, r"(?i)^<div\b[^>]*>", ""), r"(?i)</div>\s*$", "")).otherwise(body)


def atom_link(entry: Column) -> Column:
    """The alternate link, else the first link without rel; '' if there is none."""
    links = F.regexp_extract_all(entry, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1))
    href = lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    rel = lambda x: F.lower(F.regexp_extract(x, r"(?i)\brel\s*=\s*[\"']([^\"']*)[\"']", 1))
    named = F.filter(links, lambda x: href(x) != "")
    first = F.coalesce(F.get(F.filter(named, lambda x: rel(x) == "alternate"), F.lit(0)), F.get(F.filter(named, lambda x: rel(x) == ""), F.lit(0)))
    return F.coalesce(href(first), F.lit(""))


def feed_items(feeds: DataFrame) -> DataFrame:
    """feed_id, place, is_atom, item of every item or, in a feed without items, every entry.

    Null, blank and overlong documents and documents that are no feed give no rows.
    """
    rss = F.regexp_extract_all("xml", F.lit(r"(?is)(<item\b[^>]*>.*?</item\s*>)"), F.lit(1))
    atom = F.regexp_extract_all("xml", F.lit(r"(?is)(<entry\b[^>]*>.*?</entry\s*>)"), F.lit(1))
    known = feeds.where(F.col("xml").isNotNull() & (F.length("xml") <= MOST_CHARS)).withColumn("rss", rss)
    return known.select("feed_id", (F.size("rss") == 0).alias("is_atom"), F.posexplode(F.when(F.size("rss") > 0, F.col("rss")).otherwise(atom)).alias("place", "item"))


def image_urls(item: Column) -> Column:
    """Picture addresses of an item: media tags, enclosures, image tags, each once, in that order."""
    url = lambda x, name: F.regexp_extract(x, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)
    media = F.filter(F.regexp_extract_all(item, F.lit(r"(?i)(<media:(?:content|thumbnail)\b[^>]*>)"), F.lit(1)), lambda x: ~x.rlike(r"(?i)(?:type|medium)\s*=\s*[\"'][^\"']*(?:video|audio)"))
    enclosed = F.filter(F.regexp_extract_all(item, F.lit(r"(?i)(<enclosure\b[^>]*>)"), F.lit(1)), lambda x: x.rlike(r"(?i)type\s*=\s*[\"']image"))
    tags = F.regexp_extract_all(_unescape(F.regexp_replace(item, r"<!\[CDATA\[|\]\]>", "")), F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    all_urls = F.concat(F.transform(media, lambda x: url(x, "url")), F.transform(enclosed, lambda x: url(x, "url")), F.transform(tags, lambda x: url(x, "src")))
    return F.array_distinct(F.filter(all_urls, lambda u: u.rlike(r"^https?://") & ~u.rlike(JUNK_IMAGE)))


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Story rows of feed documents: feed_id, place, id, title, link, guid, date_text, descr, content, creator, categories, images.

    An item needs a title and a link; at most three categories.
    """
    x = feed_items(feeds)
    i, a = F.col("item"), F.col("is_atom")
    title = plain_text(F.when(a, text_construct(i, "title")).otherwise(inner(i, "title")))
    link = F.when(a, atom_link(i)).otherwise(plain_text(inner(i, "link")))
    guid = F.when(a, F.trim(inner(i, "id"))).otherwise(plain_text(inner(i, "guid")))
    date = F.when(a, F.coalesce(F.nullif(F.trim(inner(i, "published")), F.lit("")), F.trim(inner(i, "updated")))).otherwise(plain_text(inner(i, "pubDate")))
    content = F.when(a, text_construct(i, "content")).otherwise(inner(i, "content:encoded"))
    descr = F.when(a, F.coalesce(F.nullif(text_construct(i, "summary"), F.lit("")), text_construct(i, "content"))).otherwise(inner(i, "description"))
    creator = F.when(a, F.trim(inner(inner(i, "author"), "name"))).otherwise(plain_text(inner(i, "dc:creator")))
    terms = F.transform(F.regexp_extract_all(i, F.lit(r"(?i)(<category\b[^>]*>)"), F.lit(1)), lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)\blabel\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")), F.regexp_extract(c, r"(?i)\bterm\s*=\s*[\"']([^\"']*)[\"']", 1)))
    named = F.transform(F.regexp_extract_all(i, F.lit(r"(?is)<category(?:\s[^>]*)?>(.*?)</category\s*>"), F.lit(1)), lambda c: plain_text(F.regexp_replace(c, r"^\s*<!\[CDATA\[|\]\]>\s*$", "")))
    rows = x.select(
        "feed_id", "place", title.alias("title"), link.alias("link"), guid.alias("guid"), date.alias("date_text"), descr.alias("descr_html"), content.alias("content"), creator.alias("creator"),
        F.slice(F.filter(F.when(a, terms).otherwise(named), lambda c: c != ""), 1, 3).alias("categories"), image_urls(i).alias("images"),
    ).where((F.col("title") != "") & (F.col("link") != ""))
    return rows.select("feed_id", "place", F.concat("feed_id", F.lit("::"), F.coalesce(F.nullif("guid", F.lit("")), "link")).alias("id"), "title", "link", "guid", "date_text", plain_text(F.col("descr_html")).alias("descr"), "content", "creator", "categories", "images")


def newest_per_channel(rows: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows per ``key`` (a per-channel limit is the feature)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def channel_ref(ref: Column) -> Column:
    """'id:UC…' or 'handle:…' of a video channel reference, else null."""
    ident = F.regexp_extract(blank(F.trim(ref)), r"(?:^|/channel/)(UC[A-Za-z0-9_-]{22})(?:$|[/?#])", 1)
    handle = F.regexp_extract(blank(F.trim(ref)), r"(?i)(?:^|youtube\.com/)@([A-Za-z0-9._-]{3,60})", 1)
    return F.when(ident != "", F.concat(F.lit("id:"), ident)).when(handle != "", F.concat(F.lit("handle:"), handle))


def video_refs(html: Column) -> Column:
    """Video ids, then video files, of a text, each once."""
    ids = F.regexp_extract_all(blank(html), F.lit(r"(?:youtube(?:-nocookie)?\.com/(?:embed/|watch\?v=|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})"), F.lit(1))
    files = F.regexp_extract_all(blank(html), F.lit(r"(https?://[^\s\"'<>]+\.(?:mp4|webm|m3u8)(?:\?[^\s\"'<>]*)?)"), F.lit(1))
    return F.concat(F.transform(F.array_distinct(ids), lambda x: F.concat(F.lit("youtube:"), x)), F.transform(F.array_distinct(files), lambda x: F.concat(F.lit("file:"), x)))
