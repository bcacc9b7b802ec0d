import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as t
from tidewire.functions.urls import page_key, site_host


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_page_key_variants(spark):
    same = ["https://www.a.example/x/1/", "http://A.EXAMPLE:80/x/1#main", "https://m.a.example:443/x/1?utm_source=f&fbclid=2", "//amp.a.example/x/1", "\nhttps://a.example/x/1?ref=z "]
    assert len({one(spark, page_key, u) for u in same}) == 1
    assert one(spark, page_key, "https://a.example/story?id=1") != one(spark, page_key, "https://a.example/story?id=2")
    assert one(spark, page_key, "https://a.example/s?b=1&a=2") == one(spark, page_key, "https://a.example/s?a=2&b=1")
    for bad in (None, "", "  ", "no link", "mailto:x@y.example"):
        assert one(spark, page_key, bad) is None
    assert one(spark, site_host, "https://user@WWW.b.example:8080/") == "b.example"


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (t.title_key, "Big News: It’s here - The Paper", "big news it s here"),
        (t.title_key, None, ""),
        (t.story_url, "https://www.S.example/A/?utm_source=x&b=2&a=1#f", "s.example/a?a=1&b=2"),
        (t.story_url, "https://s.example/", ""),
        (t.story_url, "https://s.example/search?q=x", ""),
        (t.story_url, "ftp://s.example/a", ""),
        (t.normalised_url, "HTTPS://A.example/B/?utm_medium=1", "https://a.example/b"),
        (t.plain_text, "<p>A &amp; B</p><script>x<y</script>\xa0 c", "A & B c"),
        (t.markdown, '<h2>T</h2><p>a <b>b</b> <a href="u">c</a></p><ul><li>x</li></ul>', "## T\n\na **b** [c](u)\n\n- x"),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_words_and_names(spark):
    assert sorted(one(spark, t.cluster_words, "Markets jumped as prices rising - Paper")) == ["jump", "market", "pric", "ris"]
    assert one(spark, t.heat_words, None) == []
    assert sorted(one(spark, t.entities, "Mayor Jane Doe's iPhone of 2025")) == ["2025", "doe", "iphone", "jane", "mayor"]
    assert one(spark, t.is_opinion, "Opinion: no", "https://a.example/x") and one(spark, t.is_opinion, "x", "https://a.example/op-ed/1") and not one(spark, t.is_opinion, "Opinions differ", None)
    assert one(spark, t.reading_minutes, "w " * 500) == 3 and one(spark, t.reading_minutes, None) == 1
