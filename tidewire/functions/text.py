"""Text and identity scalars of stories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: a trailing publisher of 2 to 40 characters behind a spaced dash or bar.
PUBLISHER_TAIL = r"\s+[-–—|]\s+[^-–—|]{2,40}$"
#: Words that say nothing about an event (clusters).
CLUSTER_STOP = "a an and are as at be but by for from has have he her his how in into is it its of on or our over she that the their them they this to up was we were what when where which who why will with you your after before about says said say new now just more most than then there these those not no yes can could would should may might also still amid report reports reportedly update live watch video photos photo news today"
#: Words that say nothing about a topic (heat).
HEAT_STOP = "about after again against also amid before being could from have into just like more most over said says than that their them then there these they this those through what when where which while will with would your here first last year years week weeks today night time back best ever every show shows season episode review trailer watch video photos live update news report reports new"
#: Query parameters that say nothing about the page a story is on.
STORY_TRACKING = r"^(?:utm_.*|fbclid|gclid|dclid|msclkid|mc_[a-z]+|ref|ref_src|referrer|cmp|cid|ocid|taid|igshid|_ga|_gl|oly_.*|s_cid|smid|soc_src|soc_trk)$"
SCRIPTS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>"
#: What marks a story as opinion.
OPINION_TITLE = r"(?i)^\s*(?:opinion|commentary|editorial|op-?ed|column|perspective|hot take)\s*[:|–—-]"
OPINION_PATH = r"(?i)/(?:opinions?|commentary|editorials?|op-?eds?|columns?|columnists?|perspectives?)(?:/|$)"


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def strip_publisher(title: Column) -> Column:
    """The title without its publisher tail; '' for null."""
    return F.trim(F.regexp_replace(blank(title), PUBLISHER_TAIL, ""))


def title_key(title: Column) -> Column:
    """Lower case, publisher dropped, everything but letters and digits one space; '' for null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(title)), PUBLISHER_TAIL, ""), r"[^\p{L}\p{N}]+", " "))


def story_url(link: Column) -> Column:
    """Identity of a story's page: host without www, path without final slash, kept parameters sorted, all lower case.

    '' for null, other schemes, a bare site and a search page.
    """
    text = F.trim(blank(link))
    host = F.regexp_replace(F.lower(F.regexp_extract(text, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(text, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike("(?i)" + STORY_TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    known = (host != "") & (path != "") & (path != "/") & ~path.rlike(r"^/search/?$")
    return F.when(known, F.lower(F.concat(host, F.regexp_replace(path, r"/+$", ""), tail))).otherwise("")


def normalised_url(link: Column) -> Column:
    """The link in lower case without utm parameters, fragment and one final slash; '' for null."""
    bare = F.regexp_replace(F.trim(blank(link)), r"#.*$", "")
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^utm_"))
    joined = F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.lower(F.regexp_replace(joined, r"/$", ""))


def article_id(link: Column) -> Column:
    """The md5 of the normalised link."""
    return F.md5(normalised_url(link))


def is_opinion(title: Column, link: Column) -> Column:
    """Whether the title opens with, or the path holds, a word for opinion."""
    path = F.regexp_extract(blank(link), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return blank(title).rlike(OPINION_TITLE) | path.rlike(OPINION_PATH)


def plain_text(html: Column) -> Column:
    """HTML to text: scripts dropped, tags to spaces, the common entities decoded, white space collapsed; '' for null."""
    text = F.regexp_replace(blank(html), SCRIPTS, " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, char)
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


MARKDOWN_STEPS = (
    (r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1"),
    (r"(?is)<blockquote\b[^>]*>(.*?)</blockquote>", "\n\n> $1\n\n"),
    (r"(?is)<(?:strong|b)(?:\s[^>]*)?>(.*?)</(?:strong|b)>", "**$1**"),
    (r"(?is)<(?:em|i)(?:\s[^>]*)?>(.*?)</(?:em|i)>", "*$1*"),
    (r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
    (r"(?i)<br\s*/?>|</p>|</div>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#0?39;", "'"), (r"&amp;", "&"),
    (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
)


def markdown(html: Column, limit: int = 16_000) -> Column:
    """HTML to markdown: headings, list points, quotes, emphasis and links; at most ``limit`` characters."""
    text = F.regexp_replace(blank(html), SCRIPTS, "")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    for pattern, to in MARKDOWN_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.left(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit(limit))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.size(F.filter(F.split(blank(text), r"\s+"), lambda w: w != ""))


def reading_minutes(text: Column) -> Column:
    """Minutes at 200 words each, at least one, halves up."""
    return F.greatest(F.lit(1), F.floor(word_count(text) / 200 + 0.5).cast("int"))


def thinness(content: Column, description: Column) -> Column:
    """Why a content is thin: 'full_html', 'duplicates_description', 'starts_with_description', 'too_short' or 'sufficient'."""
    body, lead = plain_text(content), plain_text(description)
    words = word_count(body)
    return (
        F.when(blank(content).rlike(r"(?i)<(?:p|div|article|section)\b") & (words >= 200), "full_html")
        .when((body == lead) & (body != ""), "duplicates_description")
        .when((lead != "") & (F.length(lead) >= 80) & F.startswith(body, F.left(lead, F.lit(80))) & (words < 120), "starts_with_description")
        .when(words < 80, "too_short")
        .otherwise("sufficient")
    )


def stem(word: Column) -> Column:
    """A light English stem: ing, ed, es and s, the first that fits."""
    n = F.length(word)
    return (
        F.when((n > 5) & word.endswith("ing"), F.substring(word, F.lit(1), n - 3))
        .when((n > 4) & (word.endswith("ed") | word.endswith("es")), F.substring(word, F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def tokens(text: Column, split: str, least: int, stop: str, stemmed: bool = False, numbers: bool = True) -> Column:
    """Distinct tokens of lower-case ``text``: split at ``split``, at least ``least`` long, not in ``stop``."""
    stops = F.array(*[F.lit(w) for w in stop.split()])
    kept = F.filter(F.split(F.lower(blank(text)), split), lambda w: (F.length(w) >= least) & ~F.array_contains(stops, w) & (F.lit(numbers) | ~w.rlike(r"^\d+$")))
    return F.array_distinct(F.transform(kept, stem) if stemmed else kept)


def cluster_words(title: Column) -> Column:
    """The stemmed words by which stories of one event are compared."""
    return tokens(F.regexp_replace(blank(title), PUBLISHER_TAIL, ""), r"[^\p{L}\p{N}]+", 2, CLUSTER_STOP, stemmed=True)


def heat_words(title: Column) -> Column:
    """The words by which the heat of a topic is measured."""
    return tokens(F.regexp_replace(F.lower(blank(title)), r"['’]s\b", ""), r"[^a-z0-9]+", 4, HEAT_STOP, numbers=False)


def entities(title: Column) -> Column:
    """Stemmed tokens that look like names: capitalised, mixed in case or with a digit."""
    stops = F.array(*[F.lit(w) for w in CLUSTER_STOP.split()])
    raw = F.transform(F.split(F.regexp_replace(blank(title), PUBLISHER_TAIL, ""), r"[^\p{L}\p{N}']+"), lambda w: F.regexp_replace(w, r"(?i)'s?$", ""))
    named = F.filter(raw, lambda w: (F.length(w) >= 2) & ~F.array_contains(stops, F.lower(w)) & (w.rlike(r"^\p{Lu}") | w.rlike(r"\p{Ll}\p{Lu}") | w.rlike(r"\d")))
    return F.array_distinct(F.transform(named, lambda w: stem(F.lower(w))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct values; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
