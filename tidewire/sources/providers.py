"""API payloads of news services as story rows: one declarative mapping per service."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class Provider:
    """How one service's payload reads.  Expressions are SQL over the item's fields and ``pos``, ``now_ms``."""

    schema: str
    items: str
    title: str
    link: str
    source: str
    descr: str
    image: str = "''"
    ts: str = "0"
    keep: str = "true"
    extra: dict[str, str] = field(default_factory=dict)
    distinct: bool = False
    most: int = 60


def _iso(x: str) -> str:
    return f"coalesce(unix_millis(try_to_timestamp({x})), 0)"


#: The shapes of the services' answers.
PROVIDERS: dict[str, Provider] = {
    "thenewsapi": Provider("data array<struct<title string, url string, source string, description string, snippet string, image_url string, published_at string>>", "data", "title", "url", "source", "coalesce(nullif(description, ''), snippet)", "image_url", _iso("published_at"), distinct=True),
    "tmdb": Provider(
        "results array<struct<id bigint, title string, name string, media_type string, overview string, backdrop_path string, poster_path string>>", "results",
        "concat(coalesce(nullif(title, ''), name), if(media_type = 'tv', ' (TV)', ''))", "concat('https://www.themoviedb.org/', media_type, '/', id)", "'TMDB Trending'", "overview",
        "concat('https://image.tmdb.org/t/p/w780', coalesce(backdrop_path, poster_path))", "now_ms - pos * 60000", "id is not null and media_type in ('movie', 'tv') and pos < 20",
    ),
    "nasa": Provider(
        "title string, date string, media_type string, url string, thumbnail_url string, explanation string", "array(struct(title, date, media_type, url, thumbnail_url, explanation))", "title",
        "concat('https://apod.nasa.gov/apod/', if(date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$', concat('ap', substring(replace(date, '-', ''), 3), '.html'), ''))", "'NASA Picture of the Day'", "explanation",
        "if(media_type = 'image', url, thumbnail_url)", "coalesce(unix_millis(try_to_timestamp(concat(date, 'T12:00:00Z'))), 0)",
    ),
    "webz": Provider("posts array<struct<title string, url string, language string, text string, published string, crawled string, breaking boolean, thread struct<title string, site string, site_full string, main_image string>>>", "posts", "coalesce(nullif(title, ''), thread.title)", "url", "coalesce(nullif(thread.site_full, ''), thread.site)", "left(trim(regexp_replace(text, '\\\\s+', ' ')), 320)", "thread.main_image", _iso("coalesce(published, crawled)"), "language = 'english'", {"breaking": "coalesce(breaking, false)"}, True),
    "newsapi": Provider("articles array<struct<title string, url string, description string, urlToImage string, publishedAt string, source struct<name string>>>", "articles", "if(source.name <> '' and endswith(title, concat(' - ', source.name)), left(title, length(title) - length(source.name) - 3), title)", "url", "source.name", "description", "urlToImage", _iso("publishedAt"), "title <> '[Removed]'"),
    "ap": Provider("articles array<struct<title string, url string, description string, urlToImage string, publishedAt string>>", "articles", "title", "url", "'Associated Press'", "description", "urlToImage", _iso("publishedAt"), "title <> '[Removed]'"),
    "newsdata": Provider("results array<struct<title string, link string, source_name string, source_id string, description string, image_url string, pubDate string, duplicate boolean>>", "results", "title", "link", "coalesce(nullif(source_name, ''), source_id)", "description", "image_url", _iso("concat(replace(pubDate, ' ', 'T'), 'Z')"), "not coalesce(duplicate, false)", distinct=True),
    "eventregistry": Provider(
        "events struct<results array<struct<title struct<eng string>, summary struct<eng string>, totalArticleCount bigint>>>", "events.results", "title.eng",
        "concat('https://news.google.com/search?q=', url_encode(trim(title.eng)), '&hl=en-US&gl=US&ceid=US%3Aen')", "concat(totalArticleCount, ' articles')", "summary.eng", "''", "now_ms - pos * 120000", "coalesce(totalArticleCount, 0) > 0", {"report_count": "totalArticleCount"},
    ),
    "massive": Provider("results array<struct<title string, article_url string, description string, image_url string, published_utc string, tickers array<string>, publisher struct<name string>>>", "results", "title", "article_url", "coalesce(nullif(publisher.name, ''), 'Markets')", "concat(coalesce(description, ''), if(size(tickers) > 0, concat(' [', array_join(slice(tickers, 1, 4), ' '), ']'), ''))", "image_url", _iso("published_utc")),
    "serp": Provider(
        "news_results array<struct<title string, link string, source struct<name string>, thumbnail string, date string, stories array<struct<title string, link string, source struct<name string>, thumbnail string, date string>>>>",
        "flatten(transform(news_results, n -> if(n.stories is not null, n.stories, array(struct(n.title, n.link, n.source, n.thumbnail, n.date)))))", "title", "link", "source.name", "''", "thumbnail",
        "coalesce(unix_millis(try_to_timestamp(regexp_extract(date, '^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}, [0-9]{1,2}:[0-9]{2} [AP]M)', 1), 'M/d/y, h:mm a')), 0)", distinct=True, most=30,
    ),
}


def normalise(payloads: DataFrame, name: str, now_ms: int = 0) -> DataFrame:
    """provider, payload_id, place, title, link, source, descr, image_url, ts, breaking, report_count.

    ``payloads``: payload_id, json.  Unreadable payloads and items without title or web link give no rows; with
    ``distinct`` the first row of a link in a payload stays; at most ``most`` rows of a payload.
    """
    p = PROVIDERS[name]
    parsed = payloads.select("payload_id", F.from_json("json", p.schema).alias("j")).select("payload_id", "j.*")
    items = parsed.select("payload_id", F.expr(f"posexplode({p.items})").alias("pos", "item")).select("payload_id", "pos", F.lit(now_ms).cast("long").alias("now_ms"), "item.*")
    clean = lambda e: F.trim(F.regexp_replace(F.coalesce(F.expr(e).cast("string"), F.lit("")), r"\s+", " "))
    image: Column = F.coalesce(F.expr(p.image), F.lit(""))
    rows = items.where(F.expr(f"coalesce({p.keep}, false)")).select(
        F.lit(name).alias("provider"), "payload_id", F.col("pos").alias("place"), clean(p.title).alias("title"), F.coalesce(F.expr(p.link), F.lit("")).alias("link"), clean(p.source).alias("source"), clean(p.descr).alias("descr"),
        F.when(image.rlike("(?i)^https?://"), image).otherwise("").alias("image_url"), F.expr(p.ts).cast("long").alias("ts"), F.expr(p.extra.get("breaking", "false")).alias("breaking"), F.expr(p.extra.get("report_count", "0")).cast("long").alias("report_count"),
    ).where((F.col("title") != "") & F.col("link").rlike("(?i)^https?://"))
    if p.distinct:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("payload_id", "link").orderBy("place"))).where("_n = 1").drop("_n")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("payload_id").orderBy("place"))).where(F.col("_n") <= p.most).drop("_n")
