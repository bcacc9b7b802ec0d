from helpers import rows
from pyspark.sql import functions as F

from tidewire.operators import weather
from tidewire.sources import links


def test_pollen_marine_radar(spark):
    air = spark.createDataFrame([("a", '{"current":{"alder_pollen":2.5,"birch_pollen":0,"grass_pollen":9}}'), ("b", '{"current":{}}'), ("c", None)], "place string, json string")
    assert rows(weather.pollen(air).select("rank", "kind", "grains")) == [(1, "grass", 9.0), (2, "alder", 3.0)]
    sea = spark.createDataFrame([("a", '{"now":"2026-01-01T02:10","forecast":{"forecastday":[{"hour":[{"time":"2026-01-01 01:00","sig_ht_mt":1},{"time":"2026-01-01 02:00","sig_ht_mt":2,"swell_dir":90,"water_temp_f":59.5}]}]}}'), ("b", "{}"), ("c", '{"forecast":{"forecastday":[{"hour":[{"time":"x","swell_ht_ft":1.25}]}]}}')], "place string, json string")
    assert rows(weather.marine(sea).select("place", "wave_ft", "swell_from", "water_f")) == [("a", 6.6, "E", 60.0), ("c", None, None, None)]
    frames = ",".join(f'{{"time":{i},"path":"/f{i}"}}' for i in range(1, 8)) + ',{"time":9,"path":"bad path"}'
    radar = spark.createDataFrame([("a", f'{{"radar":{{"past":[{frames}],"nowcast":[{{"time":20,"path":"/n"}}]}}}}'), ("b", "{}")], "place string, json string")
    assert [r.ms for r in weather.radar_frames(radar).orderBy("step").collect()] == [1000, 3000, 5000, 7000, 20000]
    assert [r.ms for r in weather.radar_frames(radar, 2).orderBy("step").collect()] == [7000, 20000]


def test_nowcast_and_normals(spark):
    made = [(p, i + 1, f"2026-01-01T10:{15 * i:02d}", r) for p, rain in (("dry", [0, 0.001, 0]), ("soon", [0, 0, 0.1]), ("wet", [0.1, 0.2, None]), ("all", [0.1, 0.1, 0.1]), ("none", [None, None])) for i, r in enumerate(rain)]
    got = dict(rows(weather.nowcast(spark.createDataFrame([(a, b, c, None if d is None else float(d)) for a, b, c, d in made], "place string, step int, time string, rain double"))))
    assert got == {"dry": "No rain expected for the next 45 minutes.", "soon": "Rain likely in about 30 minutes.", "wet": "Raining now, easing in about 30 minutes.", "all": "Raining, and it should continue for at least 45 minutes."}
    days = spark.createDataFrame([("a", f"{y}-03-09", float(h)) for y, h in ((2019, 99), (2021, 50), (2022, 51), (2023, 53), (2026, 70))] + [("a", "2025-03-09", None), ("a", "2020-03-10", 1.0)], "place string, date string, high double")
    assert rows(weather.normal_high(days)) == [("a", "2025-03-09", 51.0, 3), ("a", "2026-03-09", 51.0, 3)] or ("a", "2026-03-09", 51.0, 3) in rows(weather.normal_high(days))


def test_links(spark):
    df = spark.createDataFrame([("See https://a.example/1, and https://a.example/1.\nSponsor: https://b.example\n(https://c.example/x)",), (None,)], "d string")
    assert [r.x for r in df.select(links.cited_links(F.col("d")).alias("x")).collect()] == [["https://a.example/1", "https://c.example/x"], []]
    page = "<meta property='og:title' content='T'><meta property='og:image' content='https://i.example/1'>" + "<p>" + "word " * 40 + "</p>" * 1 + ("<p>" + "word " * 60 + "</p>") * 2
    p = spark.createDataFrame([(page,), ("<title>x</title>",), (None,)], "h string")
    assert [None if r.x is None else r.x.title for r in p.select(links.citable(F.col("h")).alias("x")).collect()] == ["T", None, None]
    g = spark.createDataFrame([("59.9, 10.7",), ("95, 10",), ("x",), (None,)], "t string")
    assert [None if r.x is None else (r.x.lat, r.x.lon) for r in g.select(links.position(F.col("t")).alias("x")).collect()] == [(59.9, 10.7), None, None, None]
    s = spark.createDataFrame([('<c data-n-a-sg="A" data-n-a-ts="1">',), ("",)], "h string")
    assert [None if r.x is None else r.x.sg for r in s.select(links.redirect_signature(F.col("h")).alias("x")).collect()] == ["A", None]
