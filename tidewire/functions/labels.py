"""Short labels of stories: ages, languages, library titles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewire.functions.text import blank

#: Marks of release names, seasons and groups in library titles.
NOISE = r"(?i)\b(?:2160p|1080p|720p|480p|4k|uhd|hdr10?|dv|x26[45]|h\.?26[45]|hevc|avc|aac|ac3|dts|atmos|ddp?5?\.?1|web-?dl|web-?rip|blu-?ray|bd-?rip|dvd-?rip|remux|proper|repack|extended|unrated|multi|dual|subbed|dubbed|complete|batch)\b"
SEASON = r"(?i)\b(?:s\d{1,2}(?:e\d{1,3})?|season\s*\d+|e\d{2,3}|ep(?:isode)?\s*\d+)\b"
LIBRARY_STOP = "the,a,an,of,and,part,movie,movies,film,films,show,shows,series,anime,tv,tv shows,cartoons,cartoon,kids,documentary,documentaries,specials,special,collection,related,home,home movies,misc,other,new,unknown,season,seasons,super,stand up"
#: Words that tell a language, first match wins.
LANGUAGE_MARKS = (("ht", r"(?i)(?:^|\s)(?:ak|nan|pou|yo|sou)(?:\s|$)"), ("es", r"(?i)(?:^|\s)(?:el|los|las|del|por|una|para)(?:\s|$)"), ("fr", r"(?i)(?:^|\s)(?:le|les|des|du|une|pour|dans)(?:\s|$)"), ("de", r"(?i)(?:^|\s)(?:der|die|das|und|für|nach)(?:\s|$)"))


def age_label(ts: Column, now_ms: int) -> Column:
    """'just now', seconds, minutes or hours ago, else the date; '' for an unknown time."""
    t = F.when(F.coalesce(ts, F.lit(0)) > now_ms + 300_000, F.lit(now_ms)).otherwise(F.coalesce(ts, F.lit(0)))
    s = F.greatest(F.lit(0), F.floor((now_ms - t) / 1000)).cast("long")
    date = F.date_format(F.timestamp_millis(t), "MMM d")
    return (
        F.when(t == 0, "")
        .when(s < 5, "just now")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(date)
    )


def language(text: Column) -> Column:
    """The language whose marker words stand in the text, else 'en'."""
    out = F.lit("en")
    for name, mark in reversed(LANGUAGE_MARKS):
        out = F.when(blank(text).rlike(mark), name).otherwise(out)
    return out


def library_title(raw: Column) -> Column:
    """A title without release noise, season, year and group tags."""
    x = blank(raw)
    for pattern, to in ((r"[\[(][^\])]*[\])]", " "), (r"[._]+", " "), (NOISE, " "), (SEASON, " "), (r"\b(?:19|20)\d{2}\b", " "), (r"-\s*[A-Za-z0-9]+$", " "), (r"\s+", " ")):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def is_library_term(title: Column, least: int = 4) -> Column:
    """Whether a normalised title may serve as a term: long enough, no stop word, at most six words, no list of bests."""
    return (F.length(title) >= least) & ~F.lower(title).isin(*LIBRARY_STOP.split(",")) & (F.size(F.split(title, " ")) <= 6) & ~title.rlike(r"(?i)related \d|^the (?:best|greatest|top)\b")


def merged_categories(a: Column, b: Column, allowed: list[str], most: int = 3) -> Column:
    """The first ``most`` allowed categories of both lists, else ['Other']."""
    none = F.array().cast("array<string>")
    kept = F.slice(F.filter(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))), lambda c: c.isin(*allowed)), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("Other")))
