"""What a reader's page does with items and texts: patterns, ids, addresses, cleaning, speech, alerts in force, signals.

Defined results: null and blank texts, links and names give '' or null as each docstring says; very long texts are
handled whole; repeated rows give the same result each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.functions.text import blank, plain_text, thinness, word_count
from tidewire.operators.weather import WEATHER_WORDS, warning_level

#: Headings that open what is no longer the story, labels of ad slots, and a page's own controls.
TAIL_HEAD = r"(?i)^\s*(?:next article|previous article|read next|up next|more\b.{0,40}|related\b.{0,40}|recommended\b.{0,40}|trending\b.{0,40}|you (?:may|might) also like|popular\b.{0,40}|latest\b.{0,40}|don'?t miss|more from\b.{0,40}|sponsored\b.{0,40})\s*:?\s*$"
AD_LABELS = r"(?i)^(?:(?:advertisement|advertising|sponsored(?: content)?|story continues(?: below)?|scroll to continue(?: reading)?|continue reading below)[\s:.—-]*)+$"
PAGE_CHROME = r"(?i)\bcomments?\s*\(\d+\)|\bcopied!|\bleave a comment\b|\bshare (?:this|on|via)\b|\bfollow us on\b"
#: Words of an area's name that do not name it.
AREA_WORDS = r"(?i)\b(?:county|inland|coastal|metro|western|eastern|northern|southern)\b"
#: Fixed value: a sentence's end before white space.
SENTENCE_GAP = r"(?<=[.!?…])\s+"


def feed_pattern(media_contents: Column, content: Column, full_words: int = 200) -> Column:
    """'A' of an item with media or a short body, 'B' of one whose body is the whole story."""
    has_media = F.coalesce(F.size(media_contents), F.lit(0)) > 0
    return F.when(~has_media & (word_count(plain_text(content)) > full_words), "B").otherwise("A")


def generated_id(source: Column, post_id: Column, guid: Column, link: Column) -> Column:
    """The id of an item from its post id, else its guid, else its link (last 40 characters); null without any."""
    slug = lambda c: F.right(F.regexp_replace(c, r"(?i)[^a-z0-9]", "-"), F.lit(40))
    return F.when(blank(post_id) != "", F.concat(source, F.lit("-post-"), post_id)).when(blank(guid) != "", F.concat(source, F.lit("-guid-"), slug(guid))).when(blank(link) != "", F.concat(source, F.lit("-url-"), slug(link)))


def encoded(text: Column) -> Column:
    """A text as a component of an address (letters, digits and -_.!~*'() stay)."""
    out = F.url_encode(blank(text))
    for code, char in ((r"\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, char)
    return out


def author_url(name: Column, source: Column, pages: dict[str, str], search: str) -> Column:
    """The author's page: ``pages`` by source with {} for the slug of the name, else ``search`` with name and source."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(blank(name)), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    out = F.concat(F.lit(search), encoded(F.concat(blank(name), F.lit(" "), blank(source))))
    for key, page in pages.items():
        before, after = page.split("{}")
        out = F.when(source == key, F.concat(F.lit(before), slug, F.lit(after))).otherwise(out)
    return out


def place_query(place: Column, region: Column) -> Column:
    """'City' or 'City, Region' (the region only if the city does not hold it); '' without a city."""
    p, r = F.trim(blank(place)), F.trim(blank(region))
    return F.when(p == "", "").when((r != "") & ~F.contains(F.lower(p), F.lower(r)), F.concat(p, F.lit(", "), r)).otherwise(p)


def decoded_url(url: Column) -> Column:
    """A link with its percent codes decoded, as it stands if they are none or broken; '' for null."""
    clear = F.try_url_decode(F.regexp_replace(url, r"\+", "%2B"))
    return F.when(blank(url).rlike("%[0-9A-Fa-f]{2}"), F.coalesce(clear, url)).otherwise(blank(url))


def is_web_url(url: Column) -> Column:
    """Whether a link is an address of the web."""
    return blank(url).rlike(r"(?i)^\s*https?://[^\s/?#]+")


def for_enrichment(items: DataFrame, channel: Column) -> DataFrame:
    """The columns an enrichment reads: item_id, url, feed_source, feed_pattern, description (500 characters), thinness, is_thin, n_categories, scrape_needed.

    A page is fetched again (``scrape_needed``) where the feed gave a thin body and no full text.
    """
    pattern = feed_pattern(F.col("media_contents"), F.col("content_encoded"))
    why = thinness(F.col("content_encoded"), F.col("description"))
    out = items.select("item_id", F.col("link").alias("url"), channel.alias("feed_source"), pattern.alias("feed_pattern"), F.left(plain_text(F.col("description")), F.lit(500)).alias("description"), why.alias("thinness"), F.coalesce(F.size("categories"), F.lit(0)).alias("n_categories"))
    thin = ~F.col("thinness").isin("full_html", "sufficient")
    return out.withColumn("is_thin", thin).withColumn("scrape_needed", thin & (F.col("feed_pattern") == "A"))


def merged(items: DataFrame, answers: DataFrame, allowed: list[str], most: int = 3) -> DataFrame:
    """item_id, title, summary, category, sentiment of items with the answers of an enrichment (item_id, summary, categories, sentiment).

    Categories of the answer come first, then the feed's; those allowed, the first ``most``, else 'Other'.  A
    sentiment outside the four known ones is neutral; items without an answer keep what the feed gave.
    """
    a = answers.select("item_id", F.col("summary").alias("said"), F.col("categories").alias("judged"), F.col("sentiment").alias("felt")).dropDuplicates(["item_id"])
    none = F.array().cast("array<string>")
    kept = F.slice(F.filter(F.array_distinct(F.concat(F.coalesce("judged", none), F.coalesce("categories", none))), lambda c: c.isin(*allowed)), 1, most)
    return items.join(a, "item_id", "left").select(
        "item_id",
        F.coalesce("title", F.lit("(untitled)")).alias("title"),
        F.col("said").alias("summary"),
        F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("Other"))).alias("category"),
        F.when(F.col("felt").isin("positive", "negative", "neutral", "mixed"), F.col("felt")).otherwise("neutral").alias("sentiment"),
    )


def line_kind(line: Column) -> Column:
    """'tail' of a heading behind which the story is over, 'ad' of slot labels, 'chrome' of a page's controls, else 'text'; null for blank lines."""
    shown = F.trim(F.regexp_replace(F.regexp_replace(blank(line), r"[\s\x{A0}]+", " "), r"^#{1,6}\s+", ""))
    return F.when(shown == "", None).when((F.length(shown) < 60) & shown.rlike(TAIL_HEAD), "tail").when(shown.rlike(AD_LABELS), "ad").when((F.length(shown) < 80) & shown.rlike(PAGE_CHROME), "chrome").otherwise("text")


def cleaned(articles: DataFrame, key: str, text: str) -> DataFrame:
    """key, body, n_ads, n_chrome, n_tail: a text of one block per line without ad labels, page controls and its tail.

    The tail begins at the first tail heading that has something before it.
    """
    kinds = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(x.alias("line"), line_kind(x).alias("kind")))
    rows = articles.where(F.col(text).isNotNull()).select(key, kinds.alias("all"))
    first = F.array_position(F.transform("all", lambda x: F.when(x["kind"] == "tail", "t").otherwise("")), "t")
    opens = F.array_position(F.transform("all", lambda x: F.when(x["kind"].isNotNull(), "x").otherwise("")), "x")
    later = F.array_position(F.transform("all", lambda x, i: F.when((x["kind"] == "tail") & (i + 1 > F.col("opens")), "t").otherwise("")), "t")
    cut = rows.withColumn("opens", opens).withColumn("cut", F.when(first == F.col("opens"), later).otherwise(first))
    held = cut.withColumn("held", F.when(F.col("cut") > 0, F.slice("all", 1, F.greatest(F.col("cut").cast("int") - 1, F.lit(0)))).otherwise(F.col("all")))
    count = lambda kind: F.size(F.filter("held", lambda x: x["kind"] == kind))
    body = F.array_join(F.transform(F.filter("held", lambda x: x["kind"].isNull() | x["kind"].isin("text", "tail")), lambda x: x["line"]), "\n")
    return held.select(key, body.alias("body"), count("ad").alias("n_ads"), count("chrome").alias("n_chrome"), (F.size("all") - F.size("held")).alias("n_tail"))


def body_images(pages: DataFrame, key: str, html: str, lead: str, image_key) -> DataFrame:
    """key, place, url, kept of each picture of a body: dropped if it is the lead picture or stood earlier in the body."""
    urls = F.regexp_extract_all(blank(F.col(html)), F.lit(r"(?is)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    each = pages.select(key, image_key(F.col(lead)).alias("lead"), F.transform(urls, lambda u: F.struct(u.alias("url"), image_key(u).alias("k"))).alias("all"))
    seen = lambda i: F.exists(F.slice("all", 1, i), lambda y: y["k"] == F.get(F.col("all"), i)["k"])
    marked = F.transform("all", lambda x, i: F.struct((i + 1).alias("place"), x["url"].alias("url"), ((x["k"] == "") | ((x["k"] != F.col("lead")) & ~seen(i))).alias("kept")))
    return each.select(key, F.explode(marked).alias("x")).select(key, "x.place", "x.url", "x.kept")


def speech_text(html: Column) -> Column:
    """HTML as text to be read aloud: block ends are full stops, captions are left out."""
    s = F.regexp_replace(blank(html), r"(?is)<(figure|figcaption)[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?i)</(?:p|h[1-6]|li|blockquote|div)>", ". ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", ". ")
    s = plain_text(s)
    s = F.regexp_replace(s, r"\s+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(s, r"([.!?…])(?:\s*\.)+", "$1"))


def grouped_sentences(sentences: Column, most: int = 650) -> Column:
    """Sentences gathered into pieces of at most ``most`` characters; a longer sentence is a piece of its own."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, raw: Column) -> Column:
        t, cur = F.trim(raw), acc["cur"]
        full = (cur != "") & (F.length(cur) + 1 + F.length(t) > most)
        return F.when(t == "", acc).when(full, F.struct(F.concat(acc["out"], F.array(cur)).alias("out"), t.alias("cur"))).otherwise(F.struct(acc["out"].alias("out"), F.when(cur == "", t).otherwise(F.concat(cur, F.lit(" "), t)).alias("cur")))

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))


def quick_brief(title: Column, html: Column, n: int = 2) -> Column:
    """The headline, then the first ``n`` sentences of the body."""
    head, spoken = F.trim(blank(title)), speech_text(html)
    lead = F.array_join(F.slice(F.filter(F.split(spoken, SENTENCE_GAP), lambda x: x != ""), 1, n), " ")
    return F.when(lead == "", head).when(head == "", lead).when(head.rlike(r"[.!?…]$"), F.concat(head, F.lit(" "), lead)).otherwise(F.concat(head, F.lit(". "), lead))


def official_alert(warnings: DataFrame, stories: DataFrame, now_ms: int, city: str = "", within_ms: int = 21_600_000) -> DataFrame:
    """level, event, areas, headline, rank, ord: the most urgent warning in force and the local stories about it, those with pictures first.

    ``warnings``: place, event, severity, areas, headline, expires_ms (null: no end), in their order ``pos``.  A red
    one comes before the first; without any in force there are no rows; without stories one row with null ``ord``.
    """
    live = warnings.withColumn("level", warning_level(F.col("event"), F.col("severity"))).where("level IS NOT NULL").where(F.coalesce(F.col("expires_ms") > now_ms, F.lit(True)))
    top = live.orderBy((F.col("level") != "red").cast("int"), "pos").limit(1)
    places = F.filter(F.transform(F.concat(F.split(blank(F.col("areas")), "[;,]"), F.array(F.lit(city))), lambda p: F.lower(F.trim(F.regexp_replace(F.regexp_replace(p, r"\b[A-Z]{2}\b", ""), AREA_WORDS, "")))), lambda p: F.length(p) > 3)
    one = top.select("level", "event", "areas", F.coalesce("headline", F.concat_ws(": ", "event", "areas")).alias("headline"), places.alias("places"))
    said = F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("descr"))))
    near = stories.where((F.col("feed_id") == "local") & blank(F.col("title")).rlike(WEATHER_WORDS) & (F.lit(now_ms) - F.coalesce("ts", F.lit(0)) <= within_ms))
    told = near.select("ord", "ts", (blank(F.col("image_url")) != "").cast("int").alias("pictured"), said.alias("said"))
    # one warning of bounded size against the local stories of six hours
    met = told.join(F.broadcast(one), F.exists(F.col("places"), lambda p: F.contains(F.col("said"), p)))
    ranked = met.withColumn("rank", F.row_number().over(W.orderBy(F.desc("pictured"), F.desc("ts"), "ord"))).select("level", "event", "areas", "headline", "rank", "ord")
    return one.join(ranked.select("event", "areas", "rank", "ord"), ["event", "areas"], "left").select("level", "event", "areas", "headline", "rank", "ord")


def vote_signals(votes: DataFrame, limit: int = 5, floor: int = 2, newest: int = 500) -> DataFrame:
    """kind, key, weight of what a reader's votes have taught, strongest first in ``rank``.

    ``votes``: story_id, outlet, words, dir (1 or -1), at.  Of one story the last vote counts, and none where it repeats
    the standing one (it takes it back); the ``newest`` votes count; a weight is held within ``limit`` and shown from
    ``floor`` on.
    """
    own = W.partitionBy("story_id").orderBy("at")
    # runs of equal votes alternate between standing and taken back; another direction starts a new run
    run = votes.withColumn("turn", F.sum((F.coalesce(F.lag("dir").over(own), F.lit(0)) != F.col("dir")).cast("int")).over(own))
    last = run.groupBy("story_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.max("dir").alias("dir"), F.max_by("outlet", "at").alias("outlet"), F.max_by("words", "at").alias("words"))
    standing = last.groupBy("story_id").agg(F.max_by(F.struct("n", "at", "dir", "outlet", "words"), "turn").alias("v")).select("story_id", "v.*").where("n % 2 = 1")
    kept = standing.orderBy(F.desc("at"), "story_id").limit(newest)
    signs = kept.select("dir", F.explode(F.concat(F.array(F.struct(F.lit("outlets").alias("kind"), F.col("outlet").alias("key"))), F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.struct(F.lit("words").alias("kind"), w.alias("key"))))).alias("s"))
    weights = signs.groupBy("s.kind", "s.key").agg(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.sum("dir"))).cast("int").alias("weight")).where(F.abs("weight") >= floor)
    return weights.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("weight")), "kind", "key")))


def rule_stats(judged: DataFrame) -> DataFrame:
    """muted, raised, lowered, flagged: how many stories the rules touched (rows of `word_rules`)."""
    shown = ~F.col("muted")
    return judged.agg(F.count_if(F.col("muted")).alias("muted"), F.count_if(shown & (F.col("rule_score") > 0)).alias("raised"), F.count_if(shown & (F.col("rule_score") < 0)).alias("lowered"), F.count_if(shown & F.col("flagged")).alias("flagged"))


def translated(stories: DataFrame, translations: DataFrame) -> DataFrame:
    """``stories`` with title and descr of their translation (id, title, descr) where there is one."""
    t = translations.dropDuplicates(["id"]).select(F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("descr").alias("_descr"))
    joined = stories.join(t, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("title", F.coalesce("_title", "title")).withColumn("descr", F.coalesce("_descr", "descr")).drop("_id", "_title", "_descr")


#: Arrows of the eight winds, from north on.
ARROWS = ("↓", "↙", "←", "↖", "↑", "↗", "→", "↘")


def status_line(form: str, **values: Column) -> Column:
    """A line such as '%l %t' with each %x replaced by ``values[x]``, '?' where it is null, and %% by %; other marks stay."""
    parts: list[Column] = []
    at = 0
    while at < len(form):
        if form[at] == "%" and at + 1 < len(form):
            k = form[at + 1]
            parts.append(F.lit("%") if k == "%" else F.coalesce(values[k].cast("string"), F.lit("?")) if k in values else F.lit("%" + k))
            at += 2
        else:
            parts.append(F.lit(form[at]))
            at += 1
    return F.concat(*parts) if parts else F.lit("")


def wind_text(mph: Column, degrees: Column) -> Column:
    """The arrow of the wind's direction and its speed; null without a speed."""
    arrows = F.array(*[F.lit(a) for a in ARROWS])
    turn = F.floor(F.pmod(degrees, F.lit(360)) / 45 + 0.5).cast("int") % 8
    return F.when(mph.isNotNull(), F.concat(F.when(degrees.isNull(), "").otherwise(F.element_at(arrows, turn + 1)), F.floor(mph + 0.5).cast("string"), F.lit(" mph")))
