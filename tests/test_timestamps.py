import pandas as pd
import pytest
from helpers import rows

from tidewire.operators.timestamps import em_posteriors, interpretations, normalise_timestamps, wire_time_values

NY, SYD, BERLIN, NEPAL = "America/New_York", "Australia/Sydney", "Europe/Berlin", "Asia/Kathmandu"


def ms(text):
    return int(pd.Timestamp(text, tz="UTC").value // 1_000_000)


@pytest.mark.parametrize(
    ("value", "tz", "utc"),
    [
        ("Mon, 20 Jan 2025 07:26:46 +1100", SYD, "2025-01-19 20:26:46"),
        ("Sun, 21 Sep 2025 21:54:52 EST", NY, "2025-09-22 02:54:52"),  # taken literally, out of season
        ("Sun, 30 Mar 2025 22:58:20 MESZ", BERLIN, "2025-03-30 20:58:20"),
        ("Wed, 01 Jan 2025 09:21:14 IST", "Asia/Kolkata", "2025-01-01 03:51:14"),
        ("11. April 2025, 00:58 Uhr", BERLIN, "2025-04-10 22:58:00"),
        ("2 de octubre de 2025, 08:37 h", "Europe/Madrid", "2025-10-02 06:37:00"),
        ("5 oct. 2025 à 9h01", "Europe/Paris", "2025-10-05 07:01:00"),
        ("January 6, 2025 at 5:06 AM ET", None, "2025-01-06 10:06:00"),
        ("August 15, 2025 at 2:39 AM", NY, "2025-08-15 06:39:00"),
        ("2/16/25 10:39\xa0AM", "America/Los_Angeles", "2025-02-16 18:39:00"),
        ("21/01/2025, 11:24 AM, +0000 UTC", NEPAL, "2025-01-21 11:24:00"),
        ("2025-01-05T05:42:54+11:00[Australia/Sydney]", None, "2025-01-04 18:42:54"),
        ("20250117T082329Z", None, "2025-01-17 08:23:29"),
        ("Tue Feb 11 2025 19:25:22 GMT+0100", BERLIN, "2025-02-11 18:25:22"),
        ("2025-04-02T22:47:04+11", None, "2025-04-02 11:47:04"),
        ("2025-09-20T04:08:37.179999z", None, "2025-09-20 04:08:37.179"),
        ("\xa01755005146\t", None, "2025-08-12 13:25:46"),
        ("1776024111325", None, "2026-04-12 20:01:51.325"),
        ("1757821604328995", None, "2025-09-14 03:46:44.328"),
        ("2025-11-02 01:30:00", NY, "2025-11-02 05:30:00"),  # occurs twice: the first
        ("2025-03-09 02:30:00", NY, "2025-03-09 07:30:00"),  # skipped: the offset before the change
    ],
)
def test_one_instant(value, tz, utc):
    assert {r.utc_ms for r in interpretations(value, tz)} == {ms(utc)}


@pytest.mark.parametrize("value", [None, "", "  ", "soon", "yesterday", "3 hours ago", "2025-08-27", "2026-13-41T25:61:00Z", "0000-00-00 00:00:00", "null", "N/A", "30 Feb 2025 10:00 +0000", "x" * 100_000, "13:05 PM", "20250117"])
def test_no_instant(value):
    assert interpretations(value, "UTC") == []


def shares(counts, habit, rounds=50):
    return em_posteriors(counts, habit, 12.0, 8.0, 0.05, rounds)


def test_em_weighs_habit_against_evidence():
    both, dmy, mdy = "figures_dmy:|figures_mdy:", "figures_dmy:", "figures_mdy:"
    assert shares([("f", both, 5)], False)[0][1] > 0.9 and shares([("f", both, 5)], True)[0][0] > 0.9
    assert shares([("f", both, 5), ("f", dmy, 60)], None)[0][0] > 0.9
    # 600 values that can only be month-first overrule a stated habit; without rounds of EM they cannot
    against = [("f", both, 400), ("f", mdy, 600)]
    assert shares(against, True)[0][1] > 0.95
    assert shares(against, True, rounds=0)[0][0] > 0.9


def test_em_learns_the_delay_of_a_source():
    """No habit, no one-way value: the reading whose delay is usual in the source is chosen."""
    got = shares([("f", "figures_dmy:3|figures_mdy:8", 3), ("f", "iso:3", 500)], None)
    assert got[0][0] > 0.75
    assert max(shares([("f", "figures_dmy:|figures_mdy:", 3)], None)[0]) == 0.5


def test_ambiguity_is_marked(spark):
    values = spark.createDataFrame(
        [(1, "2025-10-26 02:30:00", "de"), (2, " " * 5000 + "2025-10-27 02:30:00", "de"), (3, "Mon, 27 Oct 2025 10:00 IST", "nowhere"), (4, "Mon, 27 Oct 2025 10:00 IST", "ie")], "rec_id long, value string, source_id string"
    ).selectExpr("'t' AS rec_table", "rec_id", "'f' AS field_name", "source_id", "value", "NULL AS seen_ms")
    feeds = spark.createDataFrame([("de", BERLIN, True), ("ie", "Europe/Dublin", True)], "source_id string, tz string, day_first boolean")
    got = {r.rec_id: r for r in normalise_timestamps(values, feeds).collect()}
    assert (got[1].ambiguity, got[1].resolved, got[1].utc_ms) == ("repeated_hour", True, ms("2025-10-26 00:30"))
    assert (got[2].ambiguity, got[2].resolved, got[2].utc_ms) == ("none", True, ms("2025-10-27 01:30"))
    assert (got[3].ambiguity, got[3].utc_ms) == ("zone", ms("2025-10-27 04:30")) and got[3].posterior < 1
    assert (got[4].ambiguity, got[4].utc_ms) == ("none", ms("2025-10-27 09:00"))
    assert {r.rec_id: r.resolved for r in normalise_timestamps(values, feeds, repeated_hour="open").collect()}[1] is False


def test_a_flipped_habit_changes_nothing_against_evidence(spark):
    values = spark.createDataFrame([(i, f"{i % 28 + 1:02d}/{i % 12 + 1:02d}/2025 10:00") for i in range(400)], "rec_id long, value string").selectExpr("'t' AS rec_table", "rec_id", "'f' AS field_name", "'s' AS source_id", "value", "NULL AS seen_ms")
    feeds = [spark.createDataFrame([("s", "UTC", habit)], "source_id string, tz string, day_first boolean") for habit in (True, False)]
    first, second = (rows(normalise_timestamps(values, f).select("rec_id", "utc_ms", "resolved")) for f in feeds)
    assert first == second and all(r[2] for r in first)


def test_unknown_habit_and_zone_stay_unresolved(spark):
    values = spark.createDataFrame(
        [("t", 1, "f", None, "03/04/2025 10:00"), ("t", 2, "f", None, "03/04/2025 10:00 +0000"), ("t", 3, "f", None, "04/04/2025 10:00 +0000"), ("t", 4, "f", "us", "03/04/2025 10:00"), ("t", 4, "f", "us", "03/04/2025 10:00"), ("t", 5, "f", "us", None)],
        "rec_table string, rec_id long, field_name string, source_id string, value string",
    ).selectExpr("*", "NULL AS seen_ms", "'clash' AS tz", "1 AS notation")
    feeds = spark.createDataFrame([("us", NY, False, "x")], "source_id string, tz string, day_first boolean, value string")
    got = {(r.rec_id, r.resolved, r.utc_ms) for r in normalise_timestamps(values, feeds).collect()}
    assert {(i, r) for i, r, _ in got} == {(1, False), (2, False), (3, True), (4, True)}
    assert {(3, True, ms("2025-04-04 10:00")), (4, True, ms("2025-03-04 15:00"))} <= got
    assert normalise_timestamps(values.limit(0), feeds).count() == 0
    assert normalise_timestamps(values, feeds.limit(0)).where("rec_id = 4 AND resolved").count() == 0


def test_article_source_from_name_or_link(spark):
    feeds = spark.createDataFrame([("a", "The A", "a.example", NY, False), ("b", "The B", "b.example", BERLIN, True)], "source_id string, source_name string, site_host string, tz string, day_first boolean")
    items = spark.createDataFrame([], "item_id long, source_id string, pub_date string, modified string, fetched_at timestamp")
    articles = spark.createDataFrame([(1, None, "The A", None, "x", None), (2, None, None, "https://www.B.example/z", "x", None), (3, None, None, None, "x", None)], "row_id long, source_id string, source_name string, link string, pub_date string, processed_at timestamp")
    assert rows(wire_time_values(items, articles, feeds).select("rec_id", "source_id")) == [(1, "a"), (2, "b"), (3, None)]
