"""The reader's operators on small cases, with the values the behaviour is known by written out."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidewire.functions import media
from tidewire.operators import events, extract, reader, search

NOW = 1_793_404_800_000


def one(spark, column, **values):
    """The value of ``column`` over one row of string columns."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_stop_lists_hold_what_they_must():
    stops = set(extract.KEY_STOP.split())
    assert len(stops) == 208
    assert {"don't", "it's", "photo", "image", "getty", "reuters", "according", "told", "mr", "mrs", "npr", "got", "like"} <= stops
    assert stops.isdisjoint({"even", "ever", "every", "make", "made", "must", "upon", "year", "years"})
    assert search.topic_words("What's happening: updates on the Mars summary") == ["mars"]


def test_keywords_fold_apostrophes(spark):
    text = "It’s a reactor. " + "The reactor doesn’t melt because reactor engineers inspect valves daily. " * 4
    docs = spark.createDataFrame([(1, text, "Reactor valves")], "id long, text string, title string")
    got = [r.word for r in extract.keywords(docs, "id", "text", "title").orderBy("rank").collect()]
    assert got[0] == "reactor" and got[1] == "valves" and not {"it's", "doesn't"} & set(got)


def test_summary_leaves_furniture_and_captions_out(spark):
    told = [f"The reactor number {i} was inspected by engineers on Monday." for i in range(5)]
    text = " ".join(["Photo: The reactor in the sun was empty.", *told, "Let us know what you think of this reactor.", "Posted by the reactor desk 3 hours ago today."])
    docs = spark.createDataFrame([(1, text, "Reactor inspected")], "id long, text string, title string")
    got = [r.sentence for r in extract.summary(docs, "id", "text", "title").collect()]
    assert len(got) == 4 and set(got) <= set(told)


def test_speech(spark):
    html = "<h1>Head</h1><p>One is done .</p><figure>x<figcaption>cap</figcaption></figure><p>Two &amp; three!</p>"
    assert one(spark, reader.speech_text(F.col("h")), h=html) == "Head. One is done. Two & three!"
    assert one(spark, reader.speech_text(F.col("h")), h=None) == ""
    assert one(spark, reader.quick_brief(F.col("t"), F.col("h")), t="Head", h="<p>One. Two. Three.</p>") == "Head. One. Two."
    assert one(spark, reader.quick_brief(F.col("t"), F.col("h")), t="", h="") == ""
    grouped = spark.createDataFrame([(["aaaa", "bb", "", "c" * 12, "d"],), ([],)], "s array<string>").select(reader.grouped_sentences(F.col("s"), 8).alias("g"))
    assert [r.g for r in grouped.collect()] == [["aaaa bb", "c" * 12, "d"], []]


def test_cleaning(spark):
    text = "More stories\nFirst paragraph.\nAdvertisement - Scroll to continue\n\nSecond one, follow us on foot.\nComments (12)\n## Related stories\nPromo\nPromo two"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "y" * 200_000, "x")], "id long, body string, n_ads string")
    got = {r.id: r for r in reader.cleaned(df, "id", "body").collect()}
    assert set(got) == {1, 3, 4} and len(got[4].body) == 200_000
    assert got[1].body == "More stories\nFirst paragraph.\n"
    assert (got[1].n_ads, got[1].n_chrome, got[1].n_tail) == (1, 2, 3) and got[3].body == ""


def test_body_images(spark):
    html = '<img src="https://a.example/p-150x150.jpg"><img src="https://a.example/q.jpg"><p>x</p><img src="https://a.example/p.jpg?w=2"><img src="https://a.example/lead.jpg">'
    df = spark.createDataFrame([(1, html, "https://a.example/lead.jpg"), (2, None, None), (3, "<p>none</p>", None)], "id long, html string, lead string")
    assert rows(reader.body_images(df, "id", "html", "lead", media.image_key).select("place", "kept")) == [(1, True), (2, True), (3, False), (4, False)]


def test_official_alert(spark):
    shape = "pos int, event string, severity string, areas string, headline string, expires_ms long"
    story = "ord string, feed_id string, title string, descr string, ts long, image_url string"
    stories = spark.createDataFrame(
        [("a", "local", "Flood in Millbrook", "", NOW - 1000, None), ("b", "local", "Storm over Millbrook shuts roads, flooding feared", "", NOW - 2000, "http://i"), ("c", "local", "Flood", "elsewhere", NOW, None), ("d", "world", "Flood in Millbrook", "", NOW, None), ("e", "local", "Flood in Millbrook", "", NOW - 7 * 3_600_000, None)], story
    )
    given = [(1, "Wind Warning", "Severe", "Millbrook County", "Wind", None), (2, "Flash Flood Warning", "Severe", "Millbrook County, XX", None, NOW + 1), (3, "Tornado Warning", "Extreme", "Millbrook", "Gone", NOW)]
    got = reader.official_alert(spark.createDataFrame(given, shape), stories, NOW).orderBy("rank").collect()
    assert [(r.level, r.event, r.ord) for r in got] == [("red", "Flash Flood Warning", "b"), ("red", "Flash Flood Warning", "a")]
    assert got[0].headline == "Flash Flood Warning: Millbrook County, XX"
    assert reader.official_alert(spark.createDataFrame(given[2:], shape), stories, NOW).count() == 0
    alone = reader.official_alert(spark.createDataFrame(given[:1], shape), stories.limit(0), NOW).collect()
    assert [(r.level, r.ord) for r in alone] == [("amber", None)]


def test_vote_signals(spark):
    votes = [("s1", "times", ["moon"], 1, 1), ("s2", "times", ["moon"], 1, 2), ("s3", "post", ["sun"], 1, 3), ("s3", "post", ["sun"], 1, 4), ("s4", "post", ["sun"], 1, 5), ("s4", "post", ["sun"], -1, 6), ("s5", "post", ["sun"], -1, 7)]
    df = spark.createDataFrame(votes, "story_id string, outlet string, words array<string>, dir int, at long")
    assert rows(reader.vote_signals(df).select("kind", "key", "weight")) == [("outlets", "post", -2), ("outlets", "times", 2), ("words", "moon", 2), ("words", "sun", -2)]
    assert rows(reader.vote_signals(df, newest=1).select("key")) == [] and reader.vote_signals(df.limit(0)).count() == 0
    many = spark.createDataFrame([(f"x{i}", "times", ["moon"], 1, i) for i in range(20)], df.schema)
    assert {r.weight for r in reader.vote_signals(many).collect()} == {5}


def test_status_line(spark):
    df = spark.createDataFrame([("Home", 71.6, 350.0, 12.4), (None, None, None, None)], "place string, t double, dir double, mph double")
    line = reader.status_line("%l: %t %w 100%% %z", l=F.col("place"), t=F.concat(F.round("t").cast("int").cast("string"), F.lit("°F")), w=reader.wind_text(F.col("mph"), F.col("dir")))
    assert [r.x for r in df.select(line.alias("x")).collect()] == ["Home: 72°F ↓12 mph 100% %z", "?: ? ? 100% %z"]


@pytest.mark.parametrize(("url", "want"), [("https://a.example/caf%C3%A9+x", "https://a.example/café+x"), ("https://a.example/%", "https://a.example/%"), (None, ""), ("https://a.example/%ff", None)])
def test_decoded_url(spark, url, want):
    got = one(spark, reader.decoded_url(F.col("u")), u=url)
    assert got == want if want is not None else got is not None


STORY = "ord string, id string, feed_id string, title string, link string, source string, descr string, ts long, image_url string, breaking int, report_count long"


def test_clusters_with_real_pairs(spark):
    """Outlets that report one event in other words are one cluster; another event and a late report are not."""
    hour = 3_600_000

    def s(n, title, source, ts, image=None):
        return (f"{n:03d}", f"i{n}", "f", title, f"https://{source}.example/{n}", source, "", ts, image, 0, 1)

    made = [
        s(1, "Magnitude 6 earthquake strikes northern Chile coast", "alpha", NOW),
        s(2, "Chile earthquake: magnitude 6 quake strikes northern coast", "beta", NOW - hour, "http://i"),
        s(3, "Magnitude 6 earthquake strikes northern Chile coast, no damage", "gamma", NOW - 2 * hour),
        s(4, "Parliament passes the annual fishing budget", "alpha", NOW),
        s(5, "Magnitude 6 earthquake strikes northern Chile coast", "delta", NOW - 72 * hour),
        s(6, "Opinion: magnitude 6 earthquake strikes northern Chile coast", "eps", NOW - hour),
    ]
    df = spark.createDataFrame(made, STORY)
    pairs = {(r.ord_a, r.ord_b) for r in events.same_event_pairs(df).collect()}
    assert {("001", "003"), ("002", "006")} <= pairs and not any("004" in p or "005" in p for p in pairs)
    got = {r.ord: r for r in events.cluster_stories(df).collect()}
    assert got["001"].cluster == got["002"].cluster == got["003"].cluster == "001" and got["002"].is_lead
    assert got["001"].report_count == 4 and got["004"].cluster_size == got["005"].cluster_size == 1


def test_alerts_with_a_hot_event(spark):
    """A third of all stories on one event: linked through heads, not in pairs."""
    made = [(f"{i:04d}", f"i{i}", "f", f"Explosion rocks Brindale harbour terminal {i % 7}", f"https://o{i % 9}.example/{i}", f"o{i % 9}", "", NOW - i, None, 0, 1) for i in range(400)]
    made += [(f"{i:04d}", f"i{i}", "f", f"Quiet council meeting number {i}", f"https://q.example/{i}", "q", "", NOW, None, 0, 1) for i in range(400, 1200)]
    got = events.find_alerts(spark.createDataFrame(made, STORY), NOW).collect()
    assert [(a.level, a.kind, a.source_count, a.n_stories) for a in got] == [("red", "event", 9, 400)]


def test_nearest_in_blocks_is_the_same(spark):
    vectors = spark.createDataFrame([(i, [float((i * k) % 7 + (i == k)) for k in range(1, 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 3 = 0")
    assert rows(search.nearest_all(vectors, queries, 3, block_bytes=200)) == rows(search.nearest_all(vectors, queries, 3))
    assert search.nearest_all(vectors, queries.limit(0), 3).count() == 0


def test_caps_with_a_hot_outlet(spark):
    """An outlet with a third of all stories: its first three stay, and a cap leaves the others alone."""
    from tidewire.operators import brief, rank

    made = [(f"{i:04d}", f"i{i}", "f", "t", "l", "hot" if i % 3 == 0 else f"o{i}", "", i, None, 0, 1) for i in range(900)]
    df = spark.createDataFrame(made, STORY)
    assert sorted(r.ord for r in rank.cap_sources(df, most=3).where("NOT over AND source = 'hot'").collect()) == ["0000", "0003", "0006"]
    assert rank.cap_sources(df).where("over").count() == 297
    capped = brief.cap_outlets(df.select("ord", "source", F.col("ts").alias("position")), [("hot", 0.1)])
    assert capped.count() == 900 and capped.where("capped").count() == 210
