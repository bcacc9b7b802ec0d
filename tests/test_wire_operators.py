import random

from helpers import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewire.operators import archive, events, extract, graph, rank, search, weather
from tidewire.sources import feeds, providers

STORY = "ord string, id string, feed_id string, title string, link string, source string, badge string, lang string, categories array<string>, descr string, ts long, image_url string, breaking int, report_count long"
NOW = 1_700_000_000_000


def story(n, title=None, link=None, source=None, ts=NOW - 3_600_000, image=None, descr=None, feed="f", breaking=0, count=0):
    return (f"{n:04d}", f"id{n}", feed, title, link, source, None, "en", None, descr, ts, image, breaking, count)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    want = sorted((x, find(x)) for x in parent)
    df = spark.createDataFrame(edges, "a long, b long")
    for parts in (1, 7):
        assert rows(graph.connected_components(df.repartition(parts))) == sorted(want, key=str)
    assert graph.connected_components(df.limit(0)).count() == 0


def fold(stories):
    """The sequential form: two alias maps, the slot last seen wins."""
    by, best, slot = {}, [], {}
    for s in sorted(stories):
        keys = [k for k in (("u", s[4]) if s[4] else None, ("t", s[3]) if s[3] and len(s[3]) > 12 else None) if k]
        at = next((by[k] for k in keys if k in by), None)
        value = (bool(s[11]), len(s[9] or ""), s[10] or 0)
        if at is None:
            at = len(best)
            best.append([value, s[0], s[0]])
        elif value > best[at][0]:
            best[at][:2] = [value, s[0]]
        by.update((k, at) for k in keys)
        slot[s[0]] = at
    return sorted((o, best[a][2], best[a][1] == o) for o, a in slot.items())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.booleans(), st.integers(0, 2)), min_size=1, max_size=14))
def test_dedupe_equals_fold(spark, picks):
    titles, links = ["", "short", "a long enough title", "another long title", "third very long title"], ["", "https://a.example/1", "https://a.example/2", "https://a.example/3", None]
    made = [story(i, titles[t], links[k], image="https://i.example/p.jpg" if p else None, descr="x" * d) for i, (t, k, p, d) in enumerate(picks)]
    want = fold([s[:4] + ((s[4] or "").replace("https://", ""),) + s[5:] for s in made])
    assert rows(events.dedupe_stories(spark.createDataFrame(made, STORY))) == sorted(want, key=str)


def test_clusters_and_alerts(spark):
    made = [
        story(1, "Strong earthquake hits northern Peru coast", source="A"),
        story(2, "Strong earthquake hits northern Peru coast again", source="B", image="x", descr="long"),
        story(3, "Earthquake hits northern Peru", source="C"),
        story(4, "Earthquake hits Peru northern region", source="D"),
        story(5, "Local team wins cup", source="A"),
        story(6, None, None, None, None),
        story(7, "Strong earthquake hits northern Peru coast", source="E", ts=NOW - 50 * 3_600_000),
    ]
    df = spark.createDataFrame(made, STORY)
    found = {r.ord: r for r in events.cluster_stories(df).collect()}
    assert len(found) == 7 and found["0002"].is_lead and found["0001"].cluster == found["0002"].cluster == "0001" and found["0005"].cluster_size == 1
    assert found["0007"].cluster == "0007"
    alert = events.find_alerts(df, NOW).collect()
    assert [(a.level, a.kind, a.source_count, a.n_stories) for a in alert] == [("red", "event", 4, 4)]
    assert events.find_alerts(df.limit(0), NOW).count() == 0 and events.cluster_stories(df.limit(0)).count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([story(i, f"Story {i} about whales", source="S" if i < 5 else None, ts=NOW - i * 3_600_000) for i in range(9)], STORY)
    assert [r.over for r in rank.cap_sources(df).orderBy("ord").collect()] == [False] * 3 + [True] * 2 + [False] * 4
    page = rank.edition(rank.score(df, NOW), spark.createDataFrame([("f", "World", True)], "feed_id string, section_name string, is_wire boolean"))
    assert [(r.slot, r["rank"]) for r in page.orderBy(F.desc("score")).collect()] == [("lead", 1)] + [("secondary", i) for i in range(1, 5)] + [("section", i) for i in range(1, 5)]
    assert rank.new_since(df, 0, NOW).count() == 0 and rank.new_since(df, NOW - 2 * 3_600_000, NOW).count() == 2
    assert rank.topic_heat(df, NOW).where("heat = 5").count() == 9
    rules = rank.word_rules(df, [{"kind": "boost", "terms": ["whales"]}, {"kind": "demote", "outlet": "s"}, {"kind": "mute", "terms": ["story 3"]}], words={"whales": 4, "about": 1})
    assert {(r.ord, r.rule_score, r.muted) for r in rules.collect()} >= {("0000", 4, False), ("0003", 4, True), ("0008", 7, False)}


def test_cap_topics_grows_vocabulary(spark):
    df = spark.createDataFrame([("a", "whales singing loudly", 1), ("b", "whales singing deeply ocean", 2), ("c", "deeply ocean currents", 3), ("d", "unrelated headline words", 4)], "ord string, title string, position int")
    assert rows(rank.cap_topics(df, most=2)) == [("a", 0, False), ("b", 0, False), ("c", 0, True), ("d", 1, False)]


def test_search(spark):
    df = spark.createDataFrame([(1, "red apples fall", None), (2, "red pears", "apple tree apple"), (3, None, None)], "k long, a string, b string")
    index, lengths = search.postings(df, "k", "a", "b")
    assert {r.k for r in search.bm25(index, lengths, "k", "appl* red").collect()} == {1, 2}
    assert search.bm25(index, lengths, "k", "*'").count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0]), (20, [0.8, 0.6])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.nearest(vectors, [1.0, 0.0], 2).collect()] == [0, 20]
    assert rows(search.nearest_all(vectors, vectors.where("vec_id % 20 = 0"), 1).select("query_id", "vec_id")) == [(0, 20), (20, 1)]
    made = [story(1, "Museum opens", source="A"), story(2, "Museum opens!", source="B"), story(3, "The museum closes", source="A"), story(4, "Museum fire", source="PR Newswire")]
    assert [r.ord for r in search.curate(spark.createDataFrame(made, STORY), "the museum").orderBy("position").collect()] == ["0001", "0003"]


def test_feeds(spark):
    rss = "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>https://a.example/1</link><guid isPermaLink='false'>g1</guid><pubDate>x</pubDate><category>c1</category><category>c2</category><category>c3</category><category>c4</category><media:content url='https://i.example/1.jpg' medium='image'/><description>&lt;img src=&quot;https://i.example/2.jpg&quot;&gt; hi</description></item><item><title>no link</title></item></channel></rss>"
    atom = "<feed><entry><title type='html'>T &lt;b&gt;x&lt;/b&gt;</title><link rel='self' href='https://s.example'/><link rel='alternate' href='https://b.example/2'/><id>i2</id><updated>u</updated><published>p</published><author><name>N</name></author><category term='t' label='L'/><summary>s</summary></entry></feed>"
    df = spark.createDataFrame([("r", rss), ("a", atom), ("n", None), ("e", ""), ("j", "{}")], "feed_id string, xml string")
    got = {r.feed_id: r for r in feeds.parse_feeds(df).collect()}
    assert set(got) == {"r", "a"}
    assert (got["r"].title, got["r"].id, got["r"].categories, got["r"].images) == ("A & B", "r::g1", ["c1", "c2", "c3"], ["https://i.example/1.jpg", "https://i.example/2.jpg"])
    assert (got["a"].title, got["a"].link, got["a"].date_text, got["a"].creator, got["a"].categories) == ("T x", "https://b.example/2", "p", "N", ["L"])
    refs = spark.createDataFrame([("UC" + "a" * 22,), ("https://www.youtube.com/@some.one",), ("x",), (None,)], "r string").select(feeds.channel_ref(F.col("r")).alias("c"))
    assert [r.c for r in refs.collect()] == ["id:UC" + "a" * 22, "handle:some.one", None, None]


def test_providers(spark):
    payloads = {
        "thenewsapi": '{"data":[{"title":" A  b","url":"https://x.example/1","source":"s","snippet":"d","image_url":"no","published_at":"2026-10-29T08:00:00Z"},{"title":"dup","url":"https://x.example/1"},{"title":"t","url":"ftp://x"}]}',
        "tmdb": '{"results":[{"id":1,"title":"F","media_type":"movie","overview":"o","poster_path":"/p"},{"id":2,"name":"S","media_type":"tv"},{"id":3,"name":"P","media_type":"person"}]}',
        "nasa": '{"title":"N","date":"2026-10-29","media_type":"image","url":"https://n.example/i.jpg","explanation":"e"}',
        "webz": '{"posts":[{"title":"W","url":"https://w.example/1","language":"english","text":"x  y","published":"2026-10-29T08:00:00Z","breaking":true,"thread":{"site_full":"w.example"}},{"title":"X","url":"https://w.example/2","language":"german"}]}',
        "newsapi": '{"articles":[{"title":"N - Src","url":"https://n.example/1","source":{"name":"Src"}},{"title":"[Removed]","url":"https://n.example/2"}]}',
        "ap": '{"articles":[{"title":"N","url":"https://n.example/1"}]}',
        "newsdata": '{"results":[{"title":"D","link":"https://d.example/1","source_id":"d","pubDate":"2026-10-29 08:18:00"},{"title":"D2","link":"https://d.example/2","duplicate":true}]}',
        "eventregistry": '{"events":{"results":[{"title":{"eng":"Big event"},"totalArticleCount":40},{"title":{"eng":"None"}}]}}',
        "massive": '{"results":[{"title":"M","article_url":"https://m.example/1","description":"d","tickers":["A","B","C","D","E"]}]}',
        "serp": '{"news_results":[{"title":"S","link":"https://s.example/1","date":"10/29/2026, 08:15 AM, +0000 UTC"},{"stories":[{"title":"S2","link":"https://s.example/2"},{"title":"S3","link":"https://s.example/1"}]}]}',
    }
    assert set(payloads) == set(providers.PROVIDERS)
    got = {}
    for name, json in payloads.items():
        df = spark.createDataFrame([(1, json), (2, "broken"), (3, None)], "payload_id long, json string")
        got[name] = providers.normalise(df, name, NOW).orderBy("place").collect()
    assert [(r.title, r.link, r.descr, r.image_url, r.ts) for r in got["thenewsapi"]] == [("A b", "https://x.example/1", "d", "", 1793260800000)]
    assert [(r.title, r.ts) for r in got["tmdb"]] == [("F", NOW), ("S (TV)", NOW - 60000)]
    assert got["nasa"][0].link == "https://apod.nasa.gov/apod/ap261029.html" and got["nasa"][0].image_url == "https://n.example/i.jpg"
    assert [(r.title, r.descr, r.breaking) for r in got["webz"]] == [("W", "x y", True)]
    assert [r.title for r in got["newsapi"]] == ["N"] and got["ap"][0].source == "Associated Press"
    assert [(r.title, r.ts) for r in got["newsdata"]] == [("D", 1793261880000)]
    assert [(r.source, r.report_count) for r in got["eventregistry"]] == [("40 articles", 40)]
    assert got["massive"][0].descr == "d [A B C D]"
    assert [(r.title, r.ts) for r in got["serp"]] == [("S", 1793261700000), ("S2", 0)]


def test_archive(spark):
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1), (None, 9, 9)], "k string, v int, seq int")
    assert {(r.k, r.v) for r in archive.upsert(cur, new, "k", "seq").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    votes = [("x", 1, 1)] * 9 + [("x", 200_000_000, -1)] * 3 + [("y", 5, 1), ("y", 6, -1)]
    assert rows(archive.vote_weights(spark.createDataFrame([(k, t + i, d) for i, (k, t, d) in enumerate(votes)], "key string, ts long, dir int"))) == [("x", 2)]
    recs = archive.archive_records(spark.createDataFrame([story(1, "T", "https://a.example/1", "S"), story(2, "T", None), story(3, None, "https://a.example/2")], STORY))
    assert [(r.domain_key, r.content, r.tags) for r in recs.collect()] == [("https://a.example/1", "S: T", ["S", "feed:f", "en"])]
    known = recs.select("domain_key", "title", F.lit("old").alias("content"), "event_time")
    assert [archive.ingest(k, recs).first().status for k in (recs.limit(0), known, recs)] == ["captured", "updated", "unchanged"]


def test_extract_and_weather(spark):
    text = "Dr. Smith went home on 3.5 roads today. " * 3 + "What now dear old friend? lower case start of a sentence. Caption"
    df = spark.createDataFrame([(1, text, "Smith"), (2, None, None)], "k long, t string, h string")
    assert df.select(F.size(extract.sentences(F.col("t"))).alias("n")).orderBy("k").first().n == 4
    assert extract.keywords(df, "k", "t", "h", least_words=5).orderBy("rank").first().word == "smith"
    assert extract.summary(df, "k", "t", "h", most=2).count() == 2
    page = "<meta property='og:image' content='https://i.example/a.jpg'><p>one</p><p> </p><p>two <a href='#'>x</a></p>"
    h = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r.x for r in h.select(extract.head_image(F.col("h")).alias("x")).collect()] == ["https://i.example/a.jpg", ""]
    assert h.select(extract.paragraphs(F.col("h")).alias("p")).first().p == ["one", "two x"]
    j = '{"current":{"time":"2026-11-01T10:20","temperature_2m":50.5},"hourly":{"time":["2026-11-01T10:00","2026-11-01T11:00","2026-11-01T12:00"],"temperature_2m":[1,-2.5,3],"precipitation_probability":[0,1,2],"weather_code":[0,1,null]},"daily":{"time":["2026-11-01"],"temperature_2m_max":[9.5],"temperature_2m_min":[1],"precipitation_sum":[0.126]},"minutely_15":{"time":["2026-11-01T10:00","2026-11-01T10:15","2026-11-01T10:30"],"precipitation":[0,0.1,null]}}'
    p = spark.createDataFrame([("x", j), ("y", "{}"), ("z", None)], "place string, json string")
    hours = weather.forecast_hours(p)
    assert rows(hours.select("step", "temp", "code")) == [(1, -2.0, 1), (2, 3.0, -1)]
    assert rows(weather.rain_steps(p).select("step", "time")) == [(1, "2026-11-01T10:15"), (2, "2026-11-01T10:30")]
    assert rows(weather.forecast_days(p).select("high", "rain")) == [(10.0, 0.13)]
    assert rows(weather.longest_run(hours, F.col("temp") < 10).select("first_step", "n")) == [(1, 2)]
    w = spark.createDataFrame([("x", '{"alerts":{"alert":[{"event":"Flood Warning","severity":"Moderate","areas":"a","expires":"e"},{"event":"Flood Warning","severity":"Moderate","areas":"a","expires":"e"},{"event":"Tornado Warning","severity":"Extreme"},{"severity":"Minor"}]}}')], "place string, json string")
    assert rows(weather.warnings(w).select("rank", "event")) == [(1, "Tornado Warning"), (2, "Flood Warning")]
    c = spark.createDataFrame([(0.0, 40), (359.0, 300), (225.0, None)], "d double, a int").select(weather.compass(F.col("d")).alias("c"), weather.air_band(F.col("a")).alias("b"))
    assert rows(c) == [("N", "Good"), ("N", "Very unhealthy"), ("SW", "")]


def test_event_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"{a}{b}ro" for a in "bdfgkl" for b in "aeiou"]
    made = []
    for i in range(240):
        base = rng.sample(words, rng.choice([2, 3, 4, 5, 7])) if i % 4 == 0 or not made else rng.sample(made[-1][1], len(made[-1][1]))
        if i % 4 and rng.random() < 0.6:
            base = base[:-1] + [rng.choice(words)]
        made.append((f"{i:04d}", base, rng.choice([0, 10**12]) and 10**12 + rng.randrange(0, 9) * 40_000_000))
    titles = [(o, " ".join(w.title() if rng.random() < 0.4 else w for w in ws), ts) for o, ws, ts in made]
    df = spark.createDataFrame([(o, t, ts) for o, t, ts in titles], "ord string, title string, ts long").selectExpr("ord", "ord id", "title", "ts", "'' link", "'' source", "'' descr", "'' image_url", "0L report_count")
    said = {r.ord: (r.ts, set(r.w), set(r.n)) for r in df.select("ord", "ts", events.cluster_words(F.col("title")).alias("w"), events.entities(F.col("title")).alias("n")).collect()}
    for share, floor in ((0.08, 30), (0.0, 20)):
        df_of = {w: sum(w in x[1] for x in said.values()) for x in said.values() for w in x[1]}
        most = max(floor, int(len(said) * share))
        want = set()
        for a, (ta, wa, na) in said.items():
            for b, (tb, wb, nb) in said.items():
                both = wa & wb
                if a < b and len(both) >= 3 and 2 * len(both) >= len(wa | wb) and min(df_of[w] for w in both) <= most:
                    if (not ta or not tb or abs(ta - tb) <= 129_600_000) and (min(len(na), len(nb)) < 2 or 2 * len(na & nb) >= len(na | nb)):
                        want.add((a, b))
        assert len(want) > 20 and set(rows(events.same_event_pairs(df, share=share, floor=floor))) == want, (share, floor)
    near = {}
    for a, b in rows(events.same_event_pairs(df)):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for r in events.cluster_stories(df).collect():
        seen, todo = {r.ord}, [r.ord]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (r.cluster, r.cluster_size) == (min(seen), len(seen))


def test_words_of_a_template_are_not_paired(spark):
    """Stories that share common words only are not written as pairs."""
    common = [f"{a}{b}t{c}" for a in "bdfgkl" for b in "aeiou" for c in "aio"]
    made = [(f"{i:05d}", " ".join([f"x{i}q", f"y{i}q", f"z{i}q"] + [common[(i * 7 + k * 11) % 90] for k in range(5)]), 10**12 + i) for i in range(3000)]
    df = spark.createDataFrame(made, "ord string, title string, ts long").selectExpr("ord", "ord id", "title", "ts", "'' link", "'' source", "'' descr", "'' image_url", "0L report_count")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    assert events.same_event_pairs(df).count() == 0
    assert store.executorSummary("driver").totalShuffleWrite() - before < 4_000_000


def test_merge_writes_little(spark, tmp_path, monkeypatch):
    """Stories without a double stay where they are, and like titles about others are not fetched to be compared."""
    from tidewire.plans import wire
    from tidewire.queries.wire import wire_merge

    made = [(f"s{i}", "f", f"Mayor Ab{i}er opens new bridge over Lake Ma{i}on in spring", f"https://a.example/{i}", "A", None, "en", None, "d", NOW if i % 9 else None, None, False, 0) for i in range(28)]
    made += [made[0], ("t1", *made[1][1:3], "https://b.example/1", *made[1][4:]), ("t2", "f", "Another title of the same page", *made[2][3:])]
    columns = "story_id string, feed_id string, title string, link string, source string, badge string, lang string, categories array<string>, descr string, ts long, image_url string, breaking boolean, report_count long"
    spark.createDataFrame(made, columns).repartition(3).write.parquet(f"{tmp_path}/wire_stories.parquet")
    written, write = [], events.cut_lineage
    monkeypatch.setattr(events, "cut_lineage", lambda df: [out := write(df), written.append(out.count())][0])
    merged = wire_merge(spark, str(tmp_path))
    assert sorted(r.id for r in merged.collect()) == sorted(f"s{i}" for i in range(28)) and {r.cluster_size for r in merged.collect()} == {1}
    # all stories once before titles and pages are compared, and of like titles fewer than the 378 pairs that they make
    assert max(written) == 30 and written.count(30) == 1 and sum(written) < 130
    monkeypatch.undo()
    assert rows(wire.stories_in_place(spark, str(tmp_path)).drop("categories")) == rows(wire.stories(spark, str(tmp_path)).drop("categories"))
