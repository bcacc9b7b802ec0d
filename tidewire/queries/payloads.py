"""Every news service's payload, made of the wire's stories in that service's shape, one payload a story."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewire.plans.wire import NOW_MS, STORIES_SQL, stories
from tidewire.queries import query, sqltext as q
from tidewire.sources import providers

_COLUMNS = ("payload_id", "title", "link", "source", "descr", "image_url", "ts")
_TS = "coalesce(ts, 0) // 1000 * 1000"
_IMAGE = "CASE WHEN regexp_matches(coalesce(image_url, ''), '(?i)^https?://') THEN image_url ELSE '' END"


def _clean(x: str) -> str:
    return f"trim({q.sub(q.blank(x), r'\s+', ' ')})"


def _sql(title: str = "title", link: str = "link", source: str = "source", descr: str = "descr", image: str = _IMAGE, ts: str = _TS, where: str = "true") -> str:
    return (
        f"WITH {STORIES_SQL} SELECT * FROM (SELECT ord AS payload_id, {_clean(title)} AS title, coalesce({link}, '') AS link, {_clean(source)} AS source, {_clean(descr)} AS descr, {image} AS image_url, CAST({ts} AS BIGINT) AS ts FROM stories WHERE {where}) x"
        " WHERE title <> '' AND regexp_matches(link, '(?i)^https?://')"
    )


def _iso() -> Column:
    return F.date_format(F.timestamp_millis(F.coalesce("ts", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _as(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def _many(name: str, item: Column) -> Column:
    return F.struct(F.array(item).alias(name))


def _register(name: str, payload, sql: str) -> None:
    @query(f"provider_{name}", sql)
    def run(spark, d):
        """One service's payloads as story rows."""
        made = stories(spark, d).select(F.col("ord").alias("payload_id"), F.to_json(payload()).alias("json"))
        return providers.normalise(made, name, NOW_MS).select(*_COLUMNS)


c = F.col
_register("thenewsapi", lambda: _many("data", _as(title=c("title"), url=c("link"), source=c("source"), snippet=c("descr"), description=F.lit(""), image_url=c("image_url"), published_at=_iso())), _sql())
_register("ap", lambda: _many("articles", _as(title=c("title"), url=c("link"), description=c("descr"), urlToImage=c("image_url"), publishedAt=_iso())), _sql(source="'Associated Press'"))
_register(
    "webz",
    lambda: _many("posts", _as(title=F.lit(""), url=c("link"), language=F.when(c("lang") == "en", "english").otherwise("other"), text=c("descr"), crawled=_iso(), thread=_as(title=c("title"), site=c("source"), main_image=c("image_url")))),
    _sql(descr=f"left({_clean('descr')}, 320)", where="lang = 'en'"),
)
_register(
    "newsdata",
    lambda: _many("results", _as(title=c("title"), link=c("link"), source_name=F.lit(""), source_id=c("source"), description=c("descr"), image_url=c("image_url"), pubDate=F.date_format(F.timestamp_millis(F.coalesce("ts", F.lit(0))), "yyyy-MM-dd HH:mm:ss"), duplicate=c("lang") == "fr")),
    _sql(where="coalesce(lang, '') <> 'fr'"),
)
_register(
    "massive",
    lambda: _many("results", _as(title=c("title"), article_url=c("link"), description=c("descr"), image_url=c("image_url"), published_utc=_iso(), tickers=F.array(F.lit("AA"), F.lit("BB"), F.lit("CC"), F.lit("DD"), F.lit("EE")), publisher=_as(name=c("source")))),
    _sql(source="coalesce(nullif(source, ''), 'Markets')", descr="concat(coalesce(descr, ''), ' [AA BB CC DD]')"),
)
_register(
    "tmdb",
    lambda: _many("results", _as(id=F.length("ord").cast("long"), name=c("title"), media_type=F.when(c("lang") == "de", "person").otherwise("tv"), overview=c("descr"), poster_path=F.lit("/p.jpg"))),
    _sql(title="concat(title, ' (TV)')", link="concat('https://www.themoviedb.org/tv/', length(ord))", source="'TMDB Trending'", image="'https://image.tmdb.org/t/p/w780/p.jpg'", ts=str(NOW_MS), where="coalesce(lang, '') <> 'de' AND title IS NOT NULL"),
)
_register(
    "nasa",
    lambda: _as(title=c("title"), date=F.lit("2026-10-03"), media_type=F.when(c("lang") == "en", "image").otherwise("video"), url=c("image_url"), thumbnail_url=F.lit("https://t.example/t.jpg"), explanation=c("descr")),
    _sql(link="'https://apod.nasa.gov/apod/ap261003.html'", source="'NASA Picture of the Day'", image=f"CASE WHEN lang = 'en' THEN {_IMAGE} ELSE 'https://t.example/t.jpg' END", ts="1791028800000"),
)
_register(
    "eventregistry",
    lambda: _as(events=_many("results", _as(title=_as(eng=c("title")), summary=_as(eng=c("descr")), totalArticleCount=F.when(c("lang") == "es", 0).otherwise(7).cast("long")))),
    _sql(link="'https://e.example'", source="'7 articles'", image="''", ts=str(NOW_MS), where="coalesce(lang, '') <> 'es' AND title IS NOT NULL").replace("coalesce('https://e.example', '') AS link", "concat('https://news.google.com/search?q=', replace(replace(replace(url_encode(trim(title)), '%20', '+'), '%2A', '*'), '~', '%7E'), '&hl=en-US&gl=US&ceid=US%3Aen') AS link"),
)
_register(
    "serp",
    lambda: _many("news_results", _as(title=F.lit("head"), stories=F.array(_as(title=c("title"), link=c("link"), source=_as(name=c("source")), thumbnail=c("image_url"), date=F.lit("10/03/2026, 07:00 AM, +0000 UTC")), _as(title=c("title"), link=c("link"), source=_as(name=F.lit("again")), thumbnail=F.lit(""), date=F.lit(""))))),
    _sql(descr="''", ts="1791010800000"),
)
