"""DuckDB spellings of the text functions, for the statements beside the queries."""

from __future__ import annotations

from tidewire.functions import text as t

TAIL = t.PUBLISHER_TAIL


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def strip_publisher(x: str) -> str:
    return f"trim({sub(blank(x), TAIL)})"


def title_key(x: str) -> str:
    return f"trim({sub(sub(f'lower({blank(x)})', TAIL), r'[^\p{L}\p{N}]+', ' ')})"


def stem(w: str) -> str:
    return (
        f"(CASE WHEN length({w}) > 5 AND ends_with({w}, 'ing') THEN left({w}, length({w}) - 3) WHEN length({w}) > 4 AND (ends_with({w}, 'ed') OR ends_with({w}, 'es')) THEN left({w}, length({w}) - 2) "
        f"WHEN length({w}) > 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END)"
    )


def words_in(stop: str) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop.split()) + ")"


def tokens(x: str, split: str, least: int, stop: str, stemmed: bool = False, numbers: bool = True) -> str:
    keep = f"length(w) >= {least} AND w NOT IN {words_in(stop)}" + ("" if numbers else r" AND NOT regexp_matches(w, '^\d+$')")
    out = f"list_filter(string_split_regex(lower({blank(x)}), '{split}'), lambda w: {keep})"
    return f"list_distinct(list_transform({out}, lambda w: {stem('w')}))" if stemmed else f"list_distinct({out})"


def cluster_words(x: str) -> str:
    return tokens(sub(blank(x), TAIL), r"[^\p{L}\p{N}]+", 2, t.CLUSTER_STOP, True)


def heat_words(x: str) -> str:
    return tokens(sub(f"lower({blank(x)})", r"['’]s\b"), r"[^a-z0-9]+", 4, t.HEAT_STOP, numbers=False)


def entities(x: str) -> str:
    raw = f"list_transform(string_split_regex({sub(blank(x), TAIL)}, '[^\\p{{L}}\\p{{N}}'']+'), lambda w: regexp_replace(w, '(?i)''s?$', ''))"
    named = f"list_filter({raw}, lambda w: length(w) >= 2 AND lower(w) NOT IN {words_in(t.CLUSTER_STOP)} AND (regexp_matches(w, '^\\p{{Lu}}') OR regexp_matches(w, '\\p{{Ll}}\\p{{Lu}}') OR regexp_matches(w, '\\d')))"
    return f"list_distinct(list_transform({named}, lambda v: {stem('lower(v)')}))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) - {shared} > 0 THEN CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared}) ELSE 0.0 END)"


def opinion(title: str, link: str) -> str:
    path = f"regexp_extract({blank(link)}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"(regexp_matches({blank(title)}, '{t.OPINION_TITLE}') OR regexp_matches({path}, '{t.OPINION_PATH}'))"


def outlet(source: str, ident: str) -> str:
    return f"lower(CASE WHEN {blank(source)} <> '' THEN {source} ELSE {ident} END)"


def age(ts: str, now: int) -> str:
    return f"greatest(0.0, ({now} - coalesce({ts}, 0)) / 3600000.0)"


def story_url(link: str) -> str:
    x = f"trim({blank(link)})"
    host = f"regexp_replace(lower(regexp_extract({x}, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"
    path = f"regexp_extract({x}, '^(?i:https?)://[^/?#]*([^?#]*)', 1)"
    kept = f"list_sort(list_filter(string_split(regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], '(?i){t.STORY_TRACKING}')))"
    return (
        f"CASE WHEN {host} <> '' AND {path} <> '' AND {path} <> '/' AND NOT regexp_matches({path}, '^/search/?$') "
        f"THEN lower(concat({host}, regexp_replace({path}, '/+$', ''), CASE WHEN len({kept}) > 0 THEN concat('?', array_to_string({kept}, '&')) ELSE '' END)) ELSE '' END"
    )


def normalised_url(link: str) -> str:
    bare = f"regexp_replace(trim({blank(link)}), '#.*$', '')"
    kept = f"list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^utm_'))"
    return f"lower(regexp_replace(concat(regexp_extract({bare}, '^([^?]*)', 1), CASE WHEN len({kept}) > 0 THEN concat('?', array_to_string({kept}, '&')) ELSE '' END), '/$', ''))"


def word_count(x: str) -> str:
    return f"len(list_filter(string_split_regex({blank(x)}, '\\s+'), lambda w: w <> ''))"


def plain_text(x: str) -> str:
    out = sub(sub(blank(x), t.SCRIPTS, " "), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "''"), ("&amp;", "&")):
        out = sub(out, entity, char)
    return f"trim({sub(out, r'[\s\x{A0}]+', ' ')})"


def markdown(x: str, limit: int = 16_000) -> str:
    out = sub(blank(x), t.SCRIPTS, "")
    for level in range(1, 7):
        out = sub(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + r" \1" + "\n\n")
    for pattern, to in t.MARKDOWN_STEPS:
        out = sub(out, pattern, to.replace("$1", r"\1").replace("$2", r"\2").replace("'", "''"))
    return f"left(trim({sub(out, r'^\s+|\s+$', '')}), {limit})"
