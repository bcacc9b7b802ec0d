from pyspark.sql import functions as F

from tidewire.streaming import wire


def _run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_votes_and_quota_and_once(spark, tmp_path):
    for i, chunk in enumerate(([("x", 1, 1)] * 7 + [("y", 1, 1)], [("x", 10, -1), ("y", 11, -1)])):
        spark.createDataFrame(chunk, "key string, ts long, dir int").coalesce(1).write.mode("append").parquet(str(tmp_path / "votes"))
    stream = spark.readStream.schema("key string, ts long, dir int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "votes"))
    _run(wire.votes(stream), "votes_out", "update")
    assert {(r.key, r.weight) for r in spark.table("votes_out").collect()} in ({("x", 5), ("y", 1), ("x", 4), ("y", 0)}, {("x", -1), ("y", -1), ("x", 5), ("y", 0)})

    day = 86_400_000
    spark.createDataFrame([("p", t) for t in (0, 10, 1000, 2000, 3000, day)], "provider string, at long").write.parquet(str(tmp_path / "asks"))
    asks = spark.readStream.schema("provider string, at long").parquet(str(tmp_path / "asks"))
    _run(wire.quota(asks, ttl_ms=500, most=3), "quota_out", "append")
    assert [r.outcome for r in spark.table("quota_out").orderBy("at").collect()] == ["fetched", "cached", "fetched", "fetched", "capped", "fetched"]

    made = spark.createDataFrame([("a", "2026-01-01 00:00:00", "Star dies", "S"), ("a", "2026-01-01 01:00:00", "Star dies", "T"), ("b", "2026-01-01 02:00:00", "Quiet day", "S")], "id string, t string, title string, source string")
    made.select("id", F.to_timestamp("t").alias("event_time"), "title", "source").write.parquet(str(tmp_path / "wire"))
    raw = spark.readStream.schema("id string, event_time timestamp, title string, source string").parquet(str(tmp_path / "wire"))
    _run(wire.once_per_story(raw), "once_out", "append")
    assert sorted(r.id for r in spark.table("once_out").collect()) == ["a", "b"]
    _run(wire.alert_counts(raw, "1 hour", "1 hour"), "alert_out", "complete")
    assert sorted((r.kind, r.n) for r in spark.table("alert_out").collect()) == [("death", 1), ("death", 1)]


def test_seen_alerts_back_off_and_copies(spark, tmp_path):
    def stream(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    alerts = stream("alerts", [("me", "a", 1), ("me", "a", 2), ("me", "b", 3), ("me", "c", 4), ("me", "a", 5), ("you", "a", 6)], "owner string, key string, at long")
    _run(wire.unseen(alerts, most=2), "unseen_out", "append")
    assert sorted((r.owner, r.key, r.at) for r in spark.table("unseen_out").collect()) == [("me", "a", 1), ("me", "a", 5), ("me", "b", 3), ("me", "c", 4), ("you", "a", 6)]

    asks = stream("lookups", [("h", 0, 200), ("h", 10, 429), ("h", 20, 200), ("h", 120_010, 200), ("g", 20, 200)], "host string, at long, status int")
    _run(wire.backed_off(asks), "back_out", "append")
    assert [(r.at, r.outcome) for r in spark.table("back_out").where("host = 'h'").orderBy("at").collect()] == [(0, "sent"), (10, "refused"), (20, "held"), (120_010, "sent")]

    reads = stream("reads", [("w", 0, None), ("w", 1, "sun"), ("w", 5, "rain"), ("w", 20, None), ("w", 21, "fog")], "key string, at long, value string")
    _run(wire.served_copies(reads, ttl_ms=10), "copies_out", "append")
    assert [(r.value, r.stale) for r in spark.table("copies_out").orderBy("at").collect()] == [(None, False), ("sun", False), ("sun", False), ("sun", True), ("fog", False)]

    month = 32 * 86_400_000
    asked = stream("serp", [("p", 0), ("p", 86_400_000), ("p", month)], "provider string, at long")
    _run(wire.quota(asked, ttl_ms=1, most=1, per="month"), "month_out", "append")
    assert [r.outcome for r in spark.table("month_out").orderBy("at").collect()] == ["fetched", "capped", "fetched"]
