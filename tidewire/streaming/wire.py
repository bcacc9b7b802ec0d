"""Structured Streaming forms: deliveries once, alert windows, votes, provider quotas."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators.events import kind_of


def once_per_story(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """Each id once within the watermark (``event_time`` timestamp, ``id``)."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])


def alert_counts(stream: DataFrame, window: str = "12 hours", slide: str = "1 hour", late: str = "12 hours") -> DataFrame:
    """start, kind, n, outlets of death and event headlines by sliding window; late rows beyond the watermark drop out."""
    told = stream.withWatermark("event_time", late).withColumn("kind", kind_of(F.col("title"))).where("kind IS NOT NULL")
    counts = told.groupBy(F.window("event_time", window, slide), "kind").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.lower("source")).alias("outlets"))
    return counts.select(F.col("window.start").alias("start"), "kind", "n", "outlets")


def votes(stream: DataFrame, limit: int = 5) -> DataFrame:
    """key, weight after each micro-batch of votes (key, ts, dir), held within ±``limit`` at every step."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight = state.get[0] if state.exists else 0
        for d in pd.concat(list(batches)).sort_values("ts")["dir"]:
            weight = max(-limit, min(limit, weight + int(d)))
        state.update((weight,))
        yield pd.DataFrame({"key": [key[0]], "weight": [weight]})

    return stream.groupBy("key").applyInPandasWithState(fold, "key string, weight int", "weight int", "update", GroupStateTimeout.NoTimeout)


def _period(at: int, per: str) -> int:
    """The number of the UTC day or month of a time in epoch ms."""
    if per == "day":
        return at // 86_400_000
    moment = datetime.fromtimestamp(at / 1000, timezone.utc)
    return moment.year * 12 + moment.month - 1


def quota(stream: DataFrame, ttl_ms: int, most: int, per: str = "day") -> DataFrame:
    """provider, at, outcome of each read request (provider, at epoch ms): 'cached', 'fetched' or 'capped'.

    A copy younger than ``ttl_ms`` is served; fetches count per UTC day or month (``per``), up to ``most``.
    """
    period = _period

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, day, used = state.get if state.exists else (-1, -1, 0)
        out = []
        for t in sorted(int(x) for b in batches for x in b["at"]):
            if period(t, per) != day:
                day, used = period(t, per), 0
            if at >= 0 and t - at < ttl_ms:
                outcome = "cached"
            elif used >= most:
                outcome = "capped"
            else:
                outcome, at, used = "fetched", t, used + 1
            out.append((key[0], t, outcome))
        state.update((at, day, used))
        yield pd.DataFrame(out, columns=["provider", "at", "outcome"])

    return stream.groupBy("provider").applyInPandasWithState(judge, "provider string, at long, outcome string", "at long, day long, used int", "append", GroupStateTimeout.NoTimeout)


def unseen(stream: DataFrame, most: int = 60) -> DataFrame:
    """owner, key, at of each alert (owner, key, at) that its owner has not seen among the last ``most`` ones."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "key"]).itertuples():
            if row.key not in seen:
                out.append((key[0], row.key, row.at))
            seen = [row.key, *(k for k in seen if k != row.key)][:most]
        state.update((seen,))
        if out:
            yield pd.DataFrame(out, columns=["owner", "key", "at"])

    return stream.groupBy("owner").applyInPandasWithState(judge, "owner string, key string, at long", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def backed_off(stream: DataFrame, wait_ms: int = 120_000) -> DataFrame:
    """host, at, status, outcome of each lookup (host, at, status it would answer): 'sent', 'refused' (status 429) or 'held'.

    After a 429 no lookup of the host is sent for ``wait_ms``; held ones keep their original link.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        out = []
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            outcome = "held" if row.at < until else "refused" if row.status == 429 else "sent"
            if outcome == "refused":
                until = row.at + wait_ms
            out.append((key[0], row.at, row.status, outcome))
        state.update((int(until),))
        yield pd.DataFrame(out, columns=["host", "at", "status", "outcome"])

    return stream.groupBy("host").applyInPandasWithState(judge, "host string, at long, status int, outcome string", "until long", "append", GroupStateTimeout.NoTimeout)


def served_copies(stream: DataFrame, ttl_ms: int) -> DataFrame:
    """key, at, value, stale of each read (key, at, value or null where the source failed).

    A copy younger than ``ttl_ms`` is served; else the read's own value; where the source failed the old copy is
    served and marked ``stale``, and without any copy the value is null.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept_at, kept = state.get if state.exists else (-1, None)
        out = []
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            fresh = kept_at >= 0 and row.at - kept_at < ttl_ms
            if not fresh and isinstance(row.value, str):
                kept_at, kept, fresh = int(row.at), row.value, True
            out.append((key[0], row.at, kept, kept is not None and not fresh))
        state.update((kept_at, kept))
        yield pd.DataFrame(out, columns=["key", "at", "value", "stale"])

    return stream.groupBy("key").applyInPandasWithState(judge, "key string, at long, value string, stale boolean", "at long, value string", "append", GroupStateTimeout.NoTimeout)
