import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidewire.functions import labels, media
from tidewire.operators import brief, pages, weather

NOW = 1_700_000_000_000


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(("ts", "want"), [(None, ""), (0, ""), (NOW + 10, "just now"), (NOW - 30_000, "30s ago"), (NOW - 61_000, "1m ago"), (NOW - 7_300_000, "2h ago"), (NOW - 3 * 86_400_000, "Nov 11"), (NOW + 10**9, "just now")])
def test_age(spark, ts, want):
    assert spark.createDataFrame([(ts,)], "t long").select(labels.age_label(F.col("t"), NOW).alias("x")).first().x == want


def test_titles_and_pictures(spark):
    assert one(spark, labels.library_title, "[x] The.Long.Road.(2020).S01E02.1080p.WEB-DL.x264-GRP") == "The Long Road"
    assert one(spark, labels.language, "El perro y la casa") == "es" and one(spark, labels.language, None) == "en"
    got = one(spark, media.best_of_srcset, "a.jpg 320w, b.jpg 1280w, c.jpg 640w")
    assert (got.url, got.w) == ("b.jpg", 1280) and one(spark, media.best_of_srcset, "a.jpg 1x, b.jpg 2.5x").w == 2500 and one(spark, media.best_of_srcset, None) is None
    assert one(spark, media.absolute_url, "/p.jpg", "https://a.example/x/") == "https://a.example/p.jpg" and one(spark, media.absolute_url, "data:x", "https://a.example") is None and one(spark, media.absolute_url, None, None) is None
    assert one(spark, media.image_key, "https://i.example/A/w_640/p-640x360.jpg?x=1") == one(spark, media.image_key, "http://i.example/a/p.jpg")
    df = spark.createDataFrame([([("a", 100, 100, "og"), ("b", 700, 400, "img"), ("c", 900, 400, "img")],), ([("a", 1, 1, "img"), ("b", 2, 2, "og")],), ([],)], "c array<struct<url string, w int, h int, via string>>")
    assert [r.x for r in df.select(media.best_image(F.col("c"), {"og": 0, "img": 1}).alias("x")).collect()] == ["c", "b", None]
    cats = spark.createDataFrame([(["X", "Y", "Z"], ["Y", "Q"]), (None, None)], "a array<string>, b array<string>")
    assert [r.x for r in cats.select(labels.merged_categories(F.col("a"), F.col("b"), ["Y", "Z", "Q"]).alias("x")).collect()] == [["Y", "Z", "Q"], ["Other"]]


def test_briefs_and_rules(spark):
    docs = spark.createDataFrame([(1, "Jane Doe paid 40.5 crowns", "A"), (2, "today Jane Doe left", "B"), (3, None, None)], "k int, t string, o string")
    assert ("name", "Jane Doe", 2, 2, True) in rows(brief.topic_map(docs, "k", "t", "o").where("kind = 'name'")) and brief.topic_map(docs, "k", "t", "o").where("item = '40.5'").count() == 1
    said = spark.createDataFrame([(1, "Jane Doe paid 40.5 crowns [1]."), (2, "No source here."), (3, "She paid 99 [1]."), (4, "Fine [7].")], "place int, sentence string")
    told = spark.createDataFrame([(1, "jane doe paid 40.5 crowns")], "n int, text string")
    assert rows(brief.unsupported(said, told)) == [(2, "no citation"), (3, "figure"), (4, "unknown source")]
    text = "# note\nboost solar, wind power\ntrust Reuters\ncap Comic book 10%\ncap X 200%\nboost ,\nfly high\n\n"
    got = rows(brief.parse_rules(spark.createDataFrame([("me", text), ("no", None)], "owner string, rules string")).select("line", "kind", "outlet", "share", "error"))
    assert got == [(2, "boost", None, None, None), (3, "trust", "reuters", None, None), (4, "cap", "comic book", 0.1, None), (5, "cap", None, None, "needs an outlet and a share"), (6, "boost", None, None, "needs at least one word or phrase"), (7, "fly", None, None, "unknown rule")]
    ranked = spark.createDataFrame([(str(i), "The Gazette" if i % 2 else None, i) for i in range(10)], "ord string, source string, position int")
    assert brief.cap_outlets(ranked, [("gazette", 0.2)]).where("capped").count() == 3
    places = spark.createDataFrame([("me", 1, "Oslo", None)], "owner string, place int, city string, region string")
    assert brief.save_place(places, "me", "OSLO", "").count() == 1 and brief.save_place(places, "me", "Bergen", "").count() == 2 and brief.save_place(places, "me", "Bergen", "", most=1).count() == 1


def test_pages(spark):
    para = "A sentence of the story that goes on for a while. " * 5
    page = f"<html><nav><p>{para}</p></nav><article><h2>Head</h2><p>{para}</p><p>{para}</p></article><div><p><a href='#'>{para * 3}</a></p></div><script type='application/ld+json'>{{\"@graph\":[{{\"headline\":\"H\",\"image\":[{{\"url\":\"https://i.example/1.jpg\"}}],\"author\":{{\"name\":\"N\"}}}}]}}</script></html>"
    assert pages.article_text(page).startswith("Head\n\nA sentence") and pages.article_text(page).count("\n\n") == 2
    assert pages.article_text(None) == pages.article_text("<p>short</p>") == "" and pages.article_text("<p>unclosed <div>" + "x" * 100_000) == ""
    assert pages.linked_data(page) == {"headline": "H", "published": "", "author": "N", "image": "https://i.example/1.jpg", "body": ""}
    df = spark.createDataFrame([(1, page), (2, None), (3, "<script type='application/ld+json'>{broken</script>")], "k long, h string")
    assert rows(pages.page_facts(df, "k", "h").select("k", "headline")) == [(1, "H"), (2, ""), (3, "")]
    assert one(spark, pages.decode_entities, "a &amp;lt; &#8217;") == "a < ’" and one(spark, pages.decode_entities, None) is None


def test_official_coverage(spark):
    w = spark.createDataFrame([("x", 1, "Tornado Warning", "Extreme", "Polk County; Lake FL", "e"), ("x", 2, "Breeze", "Minor", "Polk", "e")], "place string, rank int, event string, severity string, areas string, expires string")
    s = spark.createDataFrame([("1", "local", "Tornado near Polk", None, None, NOW), ("2", "local", "Flooding in Lake towns", "", "i", NOW - 10), ("3", "wire", "Tornado in Polk", None, None, NOW), ("4", "local", "Polk wins cup", None, None, NOW)], "ord string, feed_id string, title string, descr string, image_url string, ts long")
    assert rows(weather.official_coverage(w, s, NOW).select("ord", "level", "rank")) == [("1", "red", 2), ("2", "red", 1)]
