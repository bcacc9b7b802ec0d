"""Normalising textual timestamps by expectation-maximisation over format mixtures.

Every value is parsed under each notation that reads it without contradiction; ``03/04/2025 10:00`` has two
readings, a zone abbreviation with several meanings has one for each meaning that the feed's country leaves
open.  Per source, EM estimates a mixture from all its values: the weights of the notations, and how far its
instants lie from the time the row was seen (`DELAYS`, one distribution a field).  A value contributes the
product of both under each of its readings; the posteriors choose, and a value whose best posterior stays
under ``min_posterior`` comes out with ``resolved = false`` and its reading marked in ``ambiguity``.

What is stated about a source (day before month, or not) is a prior of a fixed number of pseudo-counts
(``habit``): enough to decide while there is no evidence, and overruled by values that read one way only.

``ambiguity``: 'none', 'order' (day and month), 'zone' (meaning of the abbreviation), 'no_zone' (no zone known) or
'repeated_hour' (the clock shows the time twice).  The wire's convention takes the first of two equal clock
times; ``repeated_hour='open'`` leaves such values unresolved instead.

The EM needs only the number of values per (source, field, set of readings with their delay class): that table
is aggregated map-side, its size per source is bounded by the number of such sets (not by the rows), so a hot
source is never gathered into one task.

Defined results for odd input: null, blank, relative words, dates without a time of day and impossible
values have no interpretation and yield no row; a value without zone whose source (hence zone) is
unknown is unresolved; values padded with any amount of white space are read whole; repeated rows yield the
same result each; empty tables yield empty results; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewire.session import cut_lineage, ship

#: Month names and abbreviations in the four languages of the wire.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fév fevrier fevr febrero",
    3: "march mar märz mrz maerz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}

#: Minutes east of Greenwich of zone abbreviations that mean one thing everywhere.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180,
    "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "nst": -210, "ndt": -150, "nt": -210,
    "ast": -240, "adt": -180, "brt": -180, "brst": -120, "jst": 540, "kst": 540, "npt": 345, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "msk": 180,
}
#: Abbreviations whose meaning depends on the country, by the zone or area of the feed; '' is the usual one.
REGIONAL = {
    "ist": {"Asia/Kolkata": 330, "Asia/Calcutta": 330, "Europe/": 60, "Asia/Jerusalem": 120, "": 330},
    "bst": {"Asia/Dhaka": 360, "Asia/Thimphu": 360, "Europe/": 60, "": 60},
    "est": {"Australia/": 600, "America/": -300, "": -300},
    "cst": {"Asia/Shanghai": 480, "Asia/Taipei": 480, "America/Havana": -300, "America/": -360, "": -360},
}
#: Zones of clock times that follow a city's rules.
CLOCKS = {"et": "America/New_York", "pt": "America/Los_Angeles", "ct": "America/Chicago", "mt": "America/Denver"}

_SPACE = re.compile(r"[\s  -   　​﻿]+")
_WEEKDAY = re.compile(r"^[^\W\d_]{2,12}\.?,? (?=[^\W_])")
_CLOCK = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?: ?(?P<ap>[ap])\.?m\.?)?"
_ZONE = r"(?: ?(?P<z>[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5}(?:[+-]\d{1,2}:?\d{2})?)(?: utc)?(?: ?\([^)]*\))?)?(?:\[(?P<region>[a-z_]+(?:/[a-z_+-]+\d*)*)\])?"
_ISO = re.compile(r"^(?P<y>\d{4})-(?P<mo>\d{1,2})-(?P<d>\d{1,2})(?:t| |, )" + _CLOCK + _ZONE + "$")
_COMPACT = re.compile(r"^(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})t(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?P<f>)(?P<ap>)" + _ZONE + "$")
_FIGURES = re.compile(r"^(?P<a>\d{1,2})[/.-](?P<b>\d{1,2})[/.-](?P<y>\d{4}|\d{2}),? " + _CLOCK + r",?" + _ZONE + "$")
_DAY_MONTH = re.compile(r"^(?P<d>\d{1,2})(?:st|nd|rd|th|er)?\.?(?: de)? (?P<mon>[^\W\d_]{3,10})\.?(?: de)?,? (?P<y>\d{4}|\d{2}),?(?: (?:à|a|at|um|a las))? " + _CLOCK + r"(?: ?(?:uhr|h))?" + _ZONE + "$")
_MONTH_DAY = re.compile(r"^(?P<mon>[^\W\d_]{3,10})\.? (?P<d>\d{1,2})(?:st|nd|rd|th)?,? (?P<y>\d{4}|\d{2}),?(?: at)? " + _CLOCK + _ZONE + "$")
_DIGITS = re.compile(r"^\d{9,17}$")
_OFFSET = re.compile(r"^(?:gmt|utc)?([+-])(\d{1,2}):?(\d{2})?$")
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - unknown and malformed keys alike
        return None


@lru_cache(maxsize=65536)
def _offset_minutes(word: str) -> int | str | None:
    """Minutes of a stated zone, the name of a city's zone, or None if the word is no zone of one meaning."""
    m = _OFFSET.match(word)
    if m:
        hours, minutes = int(m[2]), int(m[3] or 0)
        return None if hours > 14 or minutes > 59 else (hours * 60 + minutes) * (-1 if m[1] == "-" else 1)
    if word in CLOCKS:
        return CLOCKS[word]
    return ZONE_MINUTES.get(word)


def _meanings(word: str, tz: str | None) -> list[tuple[str, int]]:
    """(tag, minutes) of each meaning of a regional abbreviation; only the feed's own where its country has one.

    The tag of the usual meaning is ''.
    """
    of = REGIONAL[word]
    for place in (tz, f"{tz.split('/')[0]}/") if tz else ():
        if place in of:
            return [("", of[place])]
    return [("", of[""])] + [(f"~{word}{m:+d}", m) for m in sorted(set(of.values()) - {of[""]})]


def _clock_ms(local: datetime, tz: str) -> tuple[int, bool] | None:
    """The first of two equal clock times, a skipped one with the offset before the change; whether it stands twice."""
    zone = _zone(tz)
    if zone is None:
        return None
    first, second = (zone.utcoffset(local.replace(fold=f)) for f in (0, 1))
    return (local - _EPOCH - first) // timedelta(milliseconds=1), second < first


def _instants(g: dict, year: int, month: int, day: int, tz: str | None) -> list[tuple[str, int, bool]]:
    """(tag of the zone's meaning, epoch ms, whether the clock shows the time twice) of each reading of the parts."""
    hour, minute, second = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + (12 if g["ap"] == "p" else 0)
    if second == 60:
        return []
    try:
        local = datetime(year, month, day, hour, minute, second, int((g.get("f") or "0").ljust(6, "0")[:6]))
    except ValueError:
        return []
    word = g.get("z")
    if word and word not in REGIONAL:
        offset = _offset_minutes(word)
        if offset is None:
            return []
        clock = _clock_ms(local, offset) if isinstance(offset, str) else ((local - _EPOCH - timedelta(minutes=offset)) // timedelta(milliseconds=1), False)
    elif word:
        return [(tag, (local - _EPOCH - timedelta(minutes=m)) // timedelta(milliseconds=1), False) for tag, m in _meanings(word, tz)]
    elif g.get("region"):
        clock = _clock_ms(local, "/".join(p[:1].upper() + p[1:] for p in g["region"].split("/")))
    else:
        clock = _clock_ms(local, tz) if tz else None
    return [("", *clock)] if clock else []


def _year(text: str) -> int:
    return int(text) if len(text) == 4 else 2000 + int(text) if int(text) < 70 else 1900 + int(text)


class Reading(NamedTuple):
    """One way to read a value: its notation (with the zone's meaning), its instant, and whether the clock shows it twice."""

    notation: str
    utc_ms: int | None
    twice: bool = False


def interpretations(value: str | None, tz: str | None) -> list[Reading]:
    """All readings of ``value``; the instant is None where the zone is unknown.

    >>> [tuple(r) for r in interpretations("03/04/2025 10:00", "UTC")]
    [('figures_dmy', 1743674400000, False), ('figures_mdy', 1741082400000, False)]
    """
    if not value:
        return []
    text = _SPACE.sub(" ", value).strip().lower()
    if not text:
        return []
    if _DIGITS.match(text):
        n = int(text)
        if len(text) <= 11:
            return [Reading("epoch_s", n * 1000)]
        return [Reading("epoch_ms", n) if len(text) <= 14 else Reading("epoch_us", n // 1000)]
    out: list[Reading] = []

    def add(notation: str, g: dict, year: int, month: int, day: int) -> None:
        found = _instants(g, year, month, day, tz)
        out.extend(Reading(notation + tag, ms, twice) for tag, ms, twice in found)
        if not found and not g.get("z") and not g.get("region") and not tz and _instants(g, year, month, day, "UTC"):
            out.append(Reading(notation, None))

    if text[0].isdigit():
        m = _ISO.match(text) or _COMPACT.match(text)
        if m:
            g = m.groupdict()
            add("iso", g, int(g["y"]), int(g["mo"]), int(g["d"]))
            return out
        m = _FIGURES.match(text)
        if m:
            g = m.groupdict()
            a, b, year = int(g["a"]), int(g["b"]), _year(g["y"])
            add("figures_dmy", g, year, b, a)
            add("figures_mdy", g, year, a, b)
            return out
    else:
        text = _WEEKDAY.sub("", text) if not _MONTH_DAY.match(text) else text
    m = _DAY_MONTH.match(text) or _MONTH_DAY.match(text)
    if not m:
        return out
    g = m.groupdict()
    month = MONTH_OF.get(g["mon"])
    if month:
        add("day_month" if m.re is _DAY_MONTH else "month_day", g, _year(g["y"]), month, int(g["d"]))
    return out


#: Upper ends, in hours after the instant, of the classes of the time a row was seen at.
DELAYS = (-72, -1, 0, 6, 24, 72, 240, 960, 8760)


def delay_class(ms: int | None, seen_ms: float | None) -> str:
    """The class of the time between an instant and the row being seen; '' where either is unknown."""
    if ms is None or seen_ms is None or seen_ms != seen_ms:
        return ""
    return str(bisect_left(DELAYS, (seen_ms - ms) / 3_600_000))


def em_posteriors(counts: list[tuple[str, str, float]], day_first: bool | None, habit: float, usual: float, floor: float, rounds: int) -> list[list[float]]:
    """Posteriors of the readings of each (field, readings, n) of one source.

    ``readings``: 'notation:delay class' joined by '|'.  ``habit`` pseudo-counts stand for the stated order of day
    and month, ``usual`` for the usual meaning of a zone abbreviation; a delay counts no less than ``floor``, so
    that it never outweighs clear evidence on the notation.
    """
    sets = [(field, [r.rsplit(":", 1) for r in readings.split("|")], n) for field, readings, n in counts]
    prior = {name: 1.0 for _, readings, _ in sets for name, _ in readings}
    for name in prior:
        if day_first is not None and name.split("~")[0] == ("figures_dmy" if day_first else "figures_mdy"):
            prior[name] += habit
        if "~" not in name and any(x.startswith(name + "~") for x in prior):
            prior[name] += usual
    total = sum(prior.values())
    weight = {x: w / total for x, w in prior.items()}
    classes = len(DELAYS) + 1
    delay = {field: [1.0 / classes] * classes for field, _, _ in sets}

    def posterior(field: str, readings: list[list[str]]) -> list[float]:
        likely = [weight[name] * (max(delay[field][int(at)], floor) if at else floor) for name, at in readings]
        z = sum(likely)
        return [x / z for x in likely]

    for _ in range(rounds):
        mass, seen = dict(prior), {field: [1.0] * classes for field in delay}
        for field, readings, n in sets:
            for (name, at), p in zip(readings, posterior(field, readings)):
                mass[name] += n * p
                if at:
                    seen[field][int(at)] += n * p
        z = sum(mass.values())
        after = {x: m / z for x, m in mass.items()}
        moved = max(abs(after[x] - weight[x]) for x in after)
        weight, delay = after, {field: [x / sum(xs) for x in xs] for field, xs in seen.items()}
        if moved < 1e-9:
            break
    return [posterior(field, readings) for field, readings, _ in sets]


def normalise_timestamps(
    values: DataFrame,
    feeds: DataFrame,
    habit: float = 12.0,
    usual: float = 8.0,
    floor: float = 0.05,
    min_posterior: float = 0.75,
    rounds: int = 50,
    repeated_hour: str = "first",
) -> DataFrame:
    """One row per value that has any interpretation.

    ``values``: rec_table, rec_id, field_name, source_id, value, seen_ms (when the row was seen, epoch ms, or null).
    ``feeds``: source_id, tz, day_first.
    Returns rec_table, rec_id, field_name, notation, utc_ms, posterior, ambiguity, resolved.
    """
    ship(values.sparkSession)
    keys = ["rec_table", "rec_id", "field_name"]
    dim = feeds.select("source_id", "tz", "day_first").dropDuplicates(["source_id"])
    joined = values.select(*keys, "source_id", "value", F.col("seen_ms").cast("double").alias("seen_ms")).where(F.col("value").isNotNull()).join(dim, "source_id", "left")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.operators.timestamps import delay_class as delay_of, interpretations as readings_of

        seen: dict = {}
        for pdf in batches:
            names, alternatives = [], []
            for value, tz, at in zip(pdf["value"], pdf["tz"], pdf["seen_ms"]):
                found = seen.get((value, tz))
                if found is None:
                    found = readings_of(value, tz)
                    if len(seen) < 50_000:
                        seen[value, tz] = found
                names.append("|".join(f"{r.notation}:{delay_of(r.utc_ms, at)}" for r in found))
                alternatives.append([{"notation": r.notation, "utc_ms": r.utc_ms, "twice": r.twice} for r in found])
            out = pdf[[*keys, "source_id", "day_first"]].copy()
            out["readings"] = names
            out["alternatives"] = alternatives
            yield out[out["readings"] != ""]

    schema = "rec_table string, rec_id long, field_name string, source_id string, day_first boolean, readings string, alternatives array<struct<notation string, utc_ms long, twice boolean>>"
    parsed = cut_lineage(joined.mapInPandas(parse, schema))
    counts = parsed.groupBy("source_id", "field_name", "readings").agg(F.count(F.lit(1)).alias("n"), F.max("day_first").alias("day_first"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidewire.operators.timestamps import em_posteriors as posteriors_of

        stated = next((bool(x) for x in pdf["day_first"] if x is not None and x == x), None)
        pdf = pdf.sort_values(["field_name", "readings"])
        found = posteriors_of([(f, r, float(n)) for f, r, n in zip(pdf["field_name"], pdf["readings"], pdf["n"])], stated, habit, usual, floor, rounds)
        best = [max(range(len(p)), key=lambda i: (p[i], -i)) for p in found]
        return pd.DataFrame({"source_id": pdf["source_id"], "field_name": pdf["field_name"], "readings": pdf["readings"], "best": best, "posterior": [p[i] for p, i in zip(found, best)]})

    chosen = counts.groupBy("source_id").applyInPandas(choose, "source_id string, field_name string, readings string, best int, posterior double")
    p, c = parsed.alias("p"), chosen.alias("c")
    picked = p.join(c, F.col("p.source_id").eqNullSafe(F.col("c.source_id")) & (F.col("p.field_name") == F.col("c.field_name")) & (F.col("p.readings") == F.col("c.readings")))
    reading = F.col("p.alternatives")[F.col("c.best")]
    instant = reading["utc_ms"]
    same = F.size(F.array_distinct(F.transform("p.alternatives", lambda a: a["utc_ms"]))) == 1
    orders = F.size(F.array_distinct(F.transform("p.alternatives", lambda a: F.split_part(a["notation"], F.lit("~"), F.lit(1))))) > 1
    ambiguity = F.when(instant.isNull(), "no_zone").when(orders & ~same, "order").when(~same, "zone").when(reading["twice"], "repeated_hour").otherwise("none")
    clear = instant.isNotNull() & (same | (F.col("c.posterior") >= min_posterior))
    if repeated_hour == "open":
        clear &= ~reading["twice"]
    return picked.select(
        *[F.col(f"p.{k}") for k in keys],
        reading["notation"].alias("notation"),
        instant.alias("utc_ms"),
        F.col("c.posterior").alias("posterior"),
        ambiguity.alias("ambiguity"),
        clear.alias("resolved"),
    )


def _only(feeds: DataFrame, key: str, name: str) -> DataFrame:
    """The first source of each ``key``, where all sources of the key keep the same clock and order of figures."""
    same = (F.count_distinct("tz") <= 1) & (F.count_distinct("day_first") <= 1)
    return feeds.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.when(same, F.min("source_id")).alias(f"{name}_source"))


def wire_time_values(rss_items: DataFrame, news_articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """The textual times of both tables with the source each belongs to.

    An article without source_id takes the source whose name, else whose host, it carries.
    """
    from tidewire.functions.urls import site_host

    items = rss_items.select(
        F.lit("rss_items").alias("rec_table"),
        F.col("item_id").alias("rec_id"),
        "source_id",
        F.unix_millis(F.col("fetched_at").cast("timestamp")).alias("seen_ms"),
        F.explode(F.array(F.struct(F.lit("pub_date").alias("field_name"), F.col("pub_date").alias("value")), F.struct(F.lit("modified").alias("field_name"), F.col("modified").alias("value")))).alias("v"),
    ).select("rec_table", "rec_id", "source_id", "seen_ms", "v.field_name", "v.value")
    names, hosts = _only(feeds, "source_name", "by_name"), _only(feeds, "site_host", "by_host")
    articles = (
        news_articles.select("row_id", "source_id", "source_name", site_host(F.col("link")).alias("host"), "pub_date", F.unix_millis(F.col("processed_at").cast("timestamp")).alias("seen_ms"))
        .join(names, F.col("source_name") == F.col("by_name"), "left")
        .join(hosts, F.col("host") == F.col("by_host"), "left")
        .select(
            F.lit("news_articles").alias("rec_table"),
            F.col("row_id").alias("rec_id"),
            F.coalesce("source_id", "by_name_source", "by_host_source").alias("source_id"),
            "seen_ms",
            F.lit("pub_date").alias("field_name"),
            F.col("pub_date").alias("value"),
        )
    )
    return items.unionByName(articles)
