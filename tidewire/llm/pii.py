"""Personal details in free text by a semi-Markov conditional random field over candidate segments.

A text is segmented into entities of bounded length and single outside characters.  Whole-span features
(shape of the number, form of the address, pattern of the name, the words before and after, case) score a
segment for a kind; the score of a segmentation is the sum over its segments, outside text scores 0.  Only
spans that some trigger admits (`candidates`) can score, so the dynamic program runs over those, and outside
them the text costs nothing.  Weights are trained here by gradient ascent on the conditional likelihood of
sentences that `training_texts` composes from a grammar, a bounded number of them (``n_train``), with the
given names in use.  Being a given name in use is one trigger of a name; initials, titles ("Ms") and ages
(", 44,") beside two words with capitals are others, so names outside the list are found where the text
announces them.  The fit also counts the words that stand in lower case over all documents; the common ones
among them tell common words from surnames.

Defined results: null, empty and blank texts hold nothing; very long texts are searched whole; a detail that
stands twice in a text is one row of `find`, and both places are replaced by `redact`; overlapping details
are decided jointly, the best sum of scores wins.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewire.session import cut_lineage, ship, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Particles of surnames.
PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "la", "las", "los", "le", "du", "des", "di", "da", "zu", "zum", "ter", "ten", "y", "af", "dos"}
#: Words that make a place, firm, ship or storm of the name before or after them.
PLACE_AFTER = set("wharf terminal basin heights bridge mill street st road rd avenue ave lane ln close row crescent square park bay point quay island hill station airport harbour port tower hall house school college hospital stadium theatre bank valley creek lake river beach county square gardens place court drive way box".split())
FIRM_AFTER = set("trust works group holdings media foods labs partners mutual energy games transit authority pictures union foundation inc ltd plc llc gmbh ag corp company co bank press institute university limited sons brothers associates".split())
THING_BEFORE = set("trawler ship vessel yacht tanker freighter cruiser tug lifeboat boat schooner steamer mv hms ss storm hurricane typhoon cyclone sturm orkan hurrikan tempête ouragan chalutier navire cargo bateau paquebot tormenta borrasca huracán pesquero buque barco carguero kutter schiff frachter fähre saint st sankt cyclone".split())
#: Words that announce the person, number or address behind them.
PERSON_BEFORE = set("by from names name photograph photo foto comment reporting said told according laut selon según sagte déclaré dijo cita cite ist von par por author text contact ms mr mrs dr prof".split())
ID_BEFORE = re.compile(r"(?:social security|taxpayer|tax(?:payer)? (?:number|id)|national insurance|insurance no|\bssn|\bitin|\bnin\b|passport|\bid\b|identity|sécurité sociale|\bnir\b|steuer-?id|ausweis|sozialversicherung|identifikationsnummer|\bdni\b|\bnie\b|\bnif\b|documento|personal(?:ausweis)?)[^\w]*(?:n(?:umber|o|um|úm|r|º|°)?\.?(?:ero)?)?[^\w]*(?:as|is|lautet|:)?\s*$", re.I)
PHONE_BEFORE = re.compile(r"(?:tel|tél|phone|call|text|line|fax|mobile|office|reach|ring|unter|anrufen|appeler|téléphone|au|llamar|en el|teléfono|móvil|le)\.?\s*[:,]?\s*$", re.I)
THING_NUMBER = re.compile(r"(?:\blot|docket|isbn(?:-1[03])?|build|version|parcel|order|case|invoice|ticket|edition|bus|code|page|reference|ref|model|serial|release|chapter|volume|issn|doi)\s*(?:no\.?|number|#|:)?\s*$", re.I)

_EMAIL = re.compile(
    r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*(?:\s{0,2}(?:@|\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\}|<\s?at\s?>)\s{0,2}|\s+at\s+(?=[\w-]+(?:\s+dot\s+[\w-]+)+))"
    r"[^\W_][\w-]*(?:(?:\.|\s{0,2}(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\}|<\s?dot\s?>)\s{0,2}|\s+dot\s+)[^\W_][\w-]*)+",
    re.I,
)
_AT = re.compile(r"@|[\[({<] ?[aA][tT] ?[\])}>]")
_NUMBER = re.compile(r"(?:\(?\+ ?|\()?\d(?:(?:[ \u00a0\u202f.\-/]{0,2}|\)[ .\-/]{0,2}| ?\((?=0\))|(?<=\(0)\) ?)\d){6,24}(?:\s?\(\d\d\)|(?:[- ]?[A-Z])(?!\w))?(?![\d@])")
_LETTERED_HINT = re.compile(r"(?<!\w)[A-Z]{1,2}[ -]?\d[\dA-Z ]")
_DIGITS = re.compile(r"\d[\d.,]*")
_LETTERED = re.compile(r"(?<!\w)(?:[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[A-Za-z]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[A-Da-d]|[XYZxyz][ -]?\d{7}[ -]?[A-Za-z]|(?=[A-Z0-9]*[A-Z][A-Z0-9]*\d)[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8,9}(?:[- ]?\d{1,4})?|(?=\w*[A-Z]\w*\d)[A-Z]\d{2,4}[A-Z]\d{3}-?\d{3})(?!\w)")
_ID_SHAPES = {
    "ssn": re.compile(r"^[0-9]\d\d([ -])\d\d\1\d{4}$"),
    "nine": re.compile(r"^9\d{8}$"),
    "nino": re.compile(r"^[A-Z]{2}([ -]?)\d\d\1\d\d\1\d\d\1[A-D]$", re.I),
    "nir": re.compile(r"^[12]([ .-]?)\d\d\1\d\d\1\d[\dAB]\1\d{3}\1\d{3}(?:[ .-]?\(?\d\d\)?)?$"),
    "steuer": re.compile(r"^\d\d([ ]?)\d{3}\1\d{3}\1\d{3}$"),
    "dni": re.compile(r"^\d{2}\.?\d{3}\.?\d{3}[ -]?[A-Z]$", re.I),
    "nie": re.compile(r"^[XYZ][ -]?\d{7}[ -]?[A-Z]$", re.I),
    "iban": re.compile(r"^[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"),
    "card": re.compile(r"^[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{1,7}$"),
    "ausweis": re.compile(r"^(?=.*[A-Z])[A-Z0-9]{9,13}(?:[- ]?\d{1,4})?$"),
}
_PHONE_SHAPES = {
    "plus": re.compile(r"^\(?\+\s?\d{1,3}\)?[\s ().\-/\d]{6,}$"),
    "us": re.compile(r"^(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}$"),
    "trunk": re.compile(r"^\(?0\d{1,4}\)?[ /.-]?\d[\d .\-/]{4,}$"),
    "es": re.compile(r"^(?:[5-9]\d\d[ -]?\d{4}[ -]?\d{3}|[5-9]\d\d[ -]?\d{3}[ -]?\d{3}|[5-9]\d\d(?:[ -]\d\d){3}|[5-9]\d{9})$"),
}
_EN_TYPE = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Cl|Crescent|Cres|Row|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Ter|Boulevard|Blvd|Square|Sq|Hill|Gardens|Gdns|Grove|Mews|Walk|Parade|Highway|Hwy)"
_NAME = r"[^\W\d_][\w’'-]*"
_TAIL = r"(?:[ ](?!(?:À|EN|EST|RESTE|IN|AT)\b)(?-i:[A-ZÀ-Þ])[\w’'-]*)?"
_EN_ADDRESS = re.compile(rf"\d{{1,5}}(?:\s?[-–]\s?\d{{1,5}})?\s?[A-Za-z]?,?[ ]{{1,2}}(?:(?:[NSEW]\.|North|South|East|West|Upper|Lower|Old|New|Saint|St\.)[ ]{{1,2}})*(?:{_NAME}[ ]{{1,2}}){{1,3}}?{_EN_TYPE}(?!\w)", re.I)
_FR_ADDRESS = re.compile(rf"\d{{1,5}}(?:\s?[-–]\s?\d{{1,5}})?(?:\s?(?:bis|ter|quater|[A-D])(?!\w))?,?[ ]{{1,2}}(?:rue|r\.|avenue|av\.|boulevard|bd\.?|bvd|quai|impasse|place|pl\.|chemin|allée|cours|route|square|passage|esplanade)[ ]{{1,2}}(?:(?:de[ ]la|de[ ]l[’']|de|du|des|d[’']|le|la|les|l[’'])[ ]*)?{_NAME}(?:[ ](?:de|du|des|la)[ ](?-i:[A-ZÀ-Þ])[\w’'-]*)?{_TAIL}", re.I)
_DE_ADDRESS = re.compile(r"(?:(?:An der|Am|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den|Hinter der)[ ]{1,2}(?-i:[A-ZÄÖÜ])[\w-]+|(?:(?:Alte|Neue|Obere|Untere|Große|Kleine|Lange|Hohe|Erste|Zweite)[rsn]?[ ])?(?-i:[A-ZÄÖÜ])[\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|pfad|chaussee|brücke))[ ]{0,2}\d{1,4}(?:\s?[-–]\s?\d{1,4})?(?:\s?[a-z](?!\w))?(?!\w)", re.I)
_DE_END = re.compile(r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|pfad|chaussee|brücke|(?:an der|am|an den|im|in der|auf der|auf dem|zum|zur|unter den|hinter der)[ ]{1,2}[\w-]+)[ ]{0,2}$", re.I)
_ES_ADDRESS = re.compile(rf"(?<!\w)(?:Calle|C/|C\.|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Pl\.|Paseo|P\.º|Pº|Camino|Cno\.?|Ronda|Travesía|Carretera|Ctra\.?|Glorieta|Cuesta)[ ]*(?:(?:de la|de los|de las|del|de|la|el|los|las)[ ]+)?{_NAME}(?:[ ](?:de|del|la|los|las)[ ]{_NAME}|[ ]{_NAME})?,?[ ]*(?:n\.?[ ]?[ºo°]\.?[ ]*|núm\.?[ ]*|número[ ]*)?\d{{1,5}}(?:\s?[-–]\s?\d{{1,5}})?(?:\s?[A-Da-d](?!\w))?(?!\d)", re.I)
_ES_WORDS = ("calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "ronda", "travesía", "carretera", "ctra", "glorieta", "cuesta", "cno.", "pza", "p.º", "pº", "av.")
_INITIAL = re.compile(r"(?<![\w.’'])[^\W\d_](?=\.[ \u00a0\u202f]{0,3}[^\W_])")
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_GAP = re.compile(r"^[ \t    ]{1,3}$")
_INITIAL_GAP = re.compile(r"^\.[ \t    ]{0,3}$")
_COMMA_GAP = re.compile(r"^,[ \t    ]{1,3}$")
_UNLISTED = re.compile(r"(?:(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Sra?|Srta|Señora?|Don|Doña)\.?[ \u00a0])(?=[^\W\d_a-z]\w+[ \u00a0])|(?<![\w’'.-])(?=[^\W\d_a-z][\w’'-]+[ \u00a0](?:(?:van|von|de|del|der|la)[ \u00a0]){0,2}[^\W\d_a-z][\w’'-]+(?:, \d\d,| \(\d\d\)))")
_TITLE_BEFORE = frozenset("mr mrs ms miss dr prof herr herrn frau mme mlle monsieur madame sr sra srta señor señora don doña".split())
_STREETS = frozenset("calle avenida avda plaza paseo camino ronda travesía carretera glorieta cuesta rue avenue boulevard quai place impasse chemin allée am an im zum zur".split())
_AGE_AFTER = re.compile(r"(?:, \d\d,| \(\d\d\))")
_PLACE_END = re.compile(r"(?:burn|ford|mere|ton|wick|stead|holm|low|mouth|gate|port|ness|well|bale|dale|side|combe|minster|ham|ry|le|pale|haven|bury|ville|dorf|heim)$", re.I)
_FUNCTION = set("the a an of on in at to for and or by with from into near under after before is was were are not now about between while as that this per cent million crowns months pages years people stops".split())


class Model:
    """Weights of span features with the lexicons they look into."""

    def __init__(self, given: Iterable[str], common: Iterable[str] = (), weights: dict[str, float] | None = None):
        self.given = frozenset(x.lower() for x in given if x)
        self.common = frozenset(common) | _FUNCTION
        self.weights = dict(weights or {})
        self._finder = None

    def places(self, text: str, low: str) -> list[int]:
        """Where a given name stands as a word of its own or first in a hyphenated one."""
        if not self.given:
            return []
        if self._finder is None:
            try:
                import ahocorasick

                self._finder = ahocorasick.Automaton()
                for g in self.given:
                    self._finder.add_word(g, len(g))
                self._finder.make_automaton()
            except ImportError:
                self._finder = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(self.given, key=len, reverse=True))) + r")(?![^\W_])")
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if isinstance(self._finder, re.Pattern):
            return [m.start() for m in self._finder.finditer(low)]
        size, out = len(low), []
        for end, length in self._finder.iter(low):
            s = end - length + 1
            if (s == 0 or not low[s - 1].isalnum()) and (end + 1 == size or not low[end + 1].isalnum()):
                out.append(s)
        return out

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)


def _iban_holds(text: str) -> bool:
    """Whether the check digits of a bank account number hold (remainder of 97)."""
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _card_holds(text: str) -> bool:
    """Whether the check digit of a card number holds (doubled every second digit)."""
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


_CHECKED = {"iban": _iban_holds, "card": _card_holds}


def _case(word: str) -> str:
    return "up" if word.isupper() and len(word) > 1 else "lo" if word[0].islower() else "ti"


def _names(text: str, low: str, model: Model) -> Iterator[tuple[int, int, str, list[str]]]:
    seen: set[tuple[int, int]] = set()
    spots = sorted({*model.places(text, low), *(m.start() for m in _INITIAL.finditer(text)), *(m.end() for m in _UNLISTED.finditer(text))})
    at = 0
    while at < len(spots):
        first = last = spots[at]
        while at < len(spots) and spots[at] - last < 90:
            last = spots[at]
            at += 1
        lo, hi = max(0, first - 70), min(len(text), last + 110)
        while lo and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        for s, e, kind, f in _names_in(text, lo, hi, set(spots), model):
            if (s, e) not in seen:
                seen.add((s, e))
                yield s, e, kind, f


def _names_in(text: str, lo: int, hi: int, spots: set[int], model: Model) -> Iterator[tuple[int, int, str, list[str]]]:
    given, common = model.given, model.common
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text, lo, hi)]
    n = len(tokens)

    def is_given(word: str) -> bool:
        low = word.lower()
        return low in given or ("-" in low and all(p in given for p in low.split("-")))

    def gap(i: int) -> str:
        return text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else "\n"

    def surname_end(j: int) -> tuple[int, str] | None:
        """Index of the surname token from token j on, over particles, and the pattern so far."""
        k = j
        while k < n and k - j < 4 and tokens[k][2].lower() in PARTICLES and _GAP.match(gap(k)):
            k += 1
        if k < n and len(tokens[k][2]) >= 3 and tokens[k][2].lower() not in PARTICLES:
            return k, "P" if k > j else ""
        return None

    def make(i: int, k: int, s: int, pattern: str) -> tuple[int, int, str, list[str]]:
        word = tokens[s][2]
        low = word.lower()
        before = tokens[i - 1][2].lower() if i else ""
        lead = text[tokens[i - 1][1] : tokens[i][0]] if i else text[: tokens[i][0]]
        joined = bool(i) and bool(_GAP.match(lead))
        after = tokens[k + 1][2].lower() if k + 1 < n and _GAP.match(gap(k)) else ""
        first = tokens[i][2]
        f = [f"n:{pattern}", f"n:case:{_case(word)}"]
        if _case(first) != _case(word) and not (len(first) == 1):
            f.append("n:mixed")
        if low in common:
            f.append("n:common")
        if "-" in low and any(p in common for p in low.split("-")):
            f.append("n:common")
        if low in PLACE_AFTER or low in FIRM_AFTER:
            f.append("n:thing")
        if after in FIRM_AFTER or after in PLACE_AFTER:
            f.append("n:thing_after")
        if joined and before in THING_BEFORE:
            f.append("n:thing_before")
        if joined and before == "the":
            f.append("n:the")
        if before in PERSON_BEFORE and (joined or ":" in lead):
            f.append("n:announced")
        if ":" in lead or "\n" in lead or not i:
            f.append("n:opens")
        if _PLACE_END.search(low):
            f.append("n:place_end:G" if pattern[0] != "S" else "n:place_end:open" if "n:opens" in f or "n:announced" in f else "n:place_end")
        if pattern.startswith("I"):
            if joined and not before.islower() and before not in common:
                f.append("n:I:after_name")
            if re.search(r"\d\s*$", lead):
                f.append("n:I:number")
            f.append("n:I:announced" if "n:announced" in f or "n:opens" in f else "n:I:free")
        return tokens[i][0], tokens[k][1], "person_name", f

    for i in range(n):
        if tokens[i][0] not in spots:
            continue
        word = tokens[i][2]
        if len(word) > 1 and is_given(word):
            j, pattern = i + 1, "G"
            while j < n and len(tokens[j][2]) == 1 and (_GAP.match(gap(j - 1)) or _INITIAL_GAP.match(gap(j - 1))) and tokens[j][2].lower() not in PARTICLES:
                if not _INITIAL_GAP.match(gap(j)):
                    break
                j, pattern = j + 1, pattern + "I"
            # two given names in a row
            g2 = j
            if g2 == i + 1 and g2 < n and _GAP.match(gap(i)) and is_given(tokens[g2][2]) and len(tokens[g2][2]) > 1:
                got = surname_end(g2 + 1) if _GAP.match(gap(g2)) else None
                if got:
                    yield make(i, got[0], got[0], "GG" + got[1] + "S")
            if j < n and (_GAP.match(gap(j - 1)) or (len(pattern) > 1 and _INITIAL_GAP.match(gap(j - 1)))):
                got = surname_end(j)
                if got:
                    yield make(i, got[0], got[0], pattern + got[1] + "S")
            # surname first
            e, tail = i, ""
            while e + 1 < n and len(tokens[e + 1][2]) == 1 and _GAP.match(gap(e)) and text[tokens[e + 1][1] : tokens[e + 1][1] + 1] == ".":
                e, tail = e + 1, tail + "I"
            if i and _COMMA_GAP.match(gap(i - 1)) and len(tokens[i - 1][2]) >= 3:
                b = i - 1
                while b and b > i - 4 and tokens[b - 1][2].lower() in PARTICLES and _GAP.match(gap(b - 1)):
                    b -= 1
                start, end, kind, f = make(b, e, i - 1, "S,G" + tail)
                yield start, end + (1 if tail else 0), kind, f + ([] if text[end + bool(tail) : end + bool(tail) + 1] in ("", ",", ".", ":", ";", "\n", ")", " ") else ["n:odd_end"])
            elif i and _GAP.match(gap(i - 1)) and len(tokens[i - 1][2]) >= 3 and not is_given(tokens[i - 1][2]) and tokens[i - 1][2].lower() not in common and _case(tokens[i - 1][2]) != "lo":
                start, end, kind, f = make(i - 1, e, i - 1, "SG" + tail)
                yield start, end + (1 if tail else 0), kind, f
        elif len(word) > 1 and word[0].isupper() and word.lower() not in common and word.lower() not in _STREETS and i + 1 < n and _GAP.match(gap(i)):
            got = surname_end(i + 1)
            if got and tokens[got[0]][2][0].isupper():
                s, e, kind, f = make(i, got[0], got[0], "U" + got[1] + "S")
                titled = bool(i) and tokens[i - 1][2].lower() in _TITLE_BEFORE
                yield s, e, kind, f + ["n:U:title" if titled else "n:U:bare"] + ["n:U:age"] * bool(_AGE_AFTER.match(text, e)) + ["n:thing"] * (word.lower() in PLACE_AFTER or word.lower() in FIRM_AFTER)
        elif len(word) == 1 and word.isalpha() and text[tokens[i][1] : tokens[i][1] + 1] == "." and (i == 0 or text[tokens[i][0] - 1 : tokens[i][0]] not in (".", "’", "'")):
            j, pattern = i + 1, "I"
            while j < n and len(tokens[j][2]) == 1 and _INITIAL_GAP.match(gap(j - 1)) and text[tokens[j][1] : tokens[j][1] + 1] == ".":
                j, pattern = j + 1, pattern + "I"
            if j < n and _INITIAL_GAP.match(gap(j - 1)):
                got = surname_end(j)
                if got:
                    yield make(i, got[0], got[0], pattern + got[1] + "S")


def _numbers(text: str, digits: list[int]) -> Iterator[tuple[int, int, str, list[str]]]:
    spans: set[tuple[int, int]] = set()
    if _LETTERED_HINT.search(text):
        spans |= {(m.start(), m.end()) for m in _LETTERED.finditer(text)}
    done = 0
    for at in digits:
        if at < done:
            continue
        start = at
        while start and at - start < 3 and text[start - 1] in "+( ":
            if text[start - 1] == " " and text[start - 2 : start - 1] != "+":
                break
            start -= 1
        if start and (text[start - 1].isalnum() or text[start - 1] in "@_"):
            continue
        m = _NUMBER.match(text, start) or (_NUMBER.match(text, at) if start < at else None)
        if m is None:
            continue
        done = m.end()
        spans.add((m.start(), m.end()))
        trimmed = re.sub(r"(?:\s?\(\d\d\)|[- ]?[A-Za-z])$", "", m.group())
        spans.add((m.start(), m.start() + len(trimmed)))
        if m.group().startswith("(") and m.group().count("(") > m.group().count(")"):
            spans.add((m.start() + 1, m.end()))
    for s, e in spans:
        span = text[s:e].replace(" ", " ")
        before = text[max(0, s - 48) : s]
        announced_id, announced_phone, thing = bool(ID_BEFORE.search(before)), bool(PHONE_BEFORE.search(before)), bool(THING_NUMBER.search(before))
        longer = len(span) / 10
        flat = re.sub(r"\s+", " ", span)
        for kind, shapes, own, other in (("id_number", _ID_SHAPES, announced_id, announced_phone), ("phone", _PHONE_SHAPES, announced_phone, announced_id)):
            hits = [x for x, r in shapes.items() if r.match(flat) and (x not in _CHECKED or _CHECKED[x](flat))]
            if not hits:
                continue
            digits = sum(c.isdigit() for c in span)
            f = [f"d:{kind}:{x}" for x in hits] + [f"d:{kind}:announced" if own else f"d:{kind}:plain"]
            if other and not own:
                f.append(f"d:{kind}:other")
            if thing:
                f.append("d:thing")
            if re.match(r"\s?\(\d\d\)", text[e : e + 5]):
                f.append("d:key_left")
            if digits < 8 or digits > 15:
                f.append("d:odd_count")
            f.append("d:long" if longer > 1.2 else "d:short")
            if re.match(r"[.,]?\d|-\d", text[e : e + 2]) or re.search(r"\d[.,/-]$", before):
                f.append("d:part")
            yield s, e, kind, f


def _addresses(text: str, low: str, digits: list[int]) -> Iterator[tuple[int, int, str, list[str]]]:
    spans: list[tuple[int, int, int]] = []
    for at in digits:
        if at and (text[at - 1].isalnum() or text[at - 1] in ".,-–/"):
            if not text[at - 1].isalpha() and text[at - 1] not in ".":
                continue
        else:
            for n, form in ((0, _EN_ADDRESS), (1, _FR_ADDRESS)):
                m = form.match(text, at)
                if m:
                    spans.append((n, m.start(), m.end()))
        if _DE_END.search(text, max(0, at - 34), at):
            for m in _DE_ADDRESS.finditer(text, max(0, at - 60), min(len(text), at + 16)):
                if m.start() < at <= m.end() and (m.start() == 0 or not text[m.start() - 1].isalnum()):
                    spans.append((2, m.start(), m.end()))
    if any(w in low for w in _ES_WORDS):
        spans += [(3, m.start(), m.end()) for m in _ES_ADDRESS.finditer(text)]
    for n, s, e in spans:
        span = text[s:e]
        names = [w for w in re.findall(r"[^\W\d_]+", span) if len(w) > 1]
        f = [f"a:{n}"]
        if n == 0 and any(w.lower() in _FUNCTION for w in names[:-1]):
            f.append("a:function")
        if n == 0 and not all(w[0].isupper() for w in names):
            f.append("a:lower")
        if n == 3 and re.search(r"\d{4,}$", span):
            f.append("a:year")
        if n == 3 and any(w.lower() in ("en", "a", "y", "por", "con", "tras") for w in names):
            f.append("a:function")
        if re.search(r"(?:\bbus|\bbuild|\blot|\bno)\s*$", text[max(0, s - 12) : s], re.I):
            f.append("a:thing")
        yield s, e, "street_address", f


def candidates(text: str, model: Model) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every admitted segment."""
    out: list[tuple[int, int, str, list[str]]] = []
    low = text.lower()
    places = [m.start() for m in _AT.finditer(text)]
    if " dot " in low:
        places += [m.start() for m in re.finditer(r"(?<=\w) +at +(?=[\w-]+ +dot )", low)]
    done = 0
    for at in places:
        if at < done:
            continue
        for m in _EMAIL.finditer(text, max(done, at - 80), min(len(text), at + 140)):
            if m.start() <= at < m.end():
                tail = re.split(r"[.\s\[\](){}<>]+|dot", m.group(), flags=re.I)[-1]
                out.append((m.start(), m.end(), "email", ["e", "e:alpha" if tail.isalpha() and len(tail) >= 2 else "e:digits"]))
                done = m.end()
    digits = [m.start() for m in _DIGITS.finditer(text)]
    if digits:
        out += _numbers(text, digits)
        out += _addresses(text, low, digits)
    out += _names(text, low, model)
    return out


def best_segments(cands: list[tuple[int, int, str, list[str]]], model: Model) -> list[tuple[int, int, str]]:
    """The segmentation of the highest score; segments of score 0 or less stay outside."""
    scored = sorted((e, s, kind, v) for s, e, kind, f in cands if (v := model.score(f)) > 0)
    ends = [x[0] for x in scored]
    best, take = [0.0], []
    for n, (e, s, kind, v) in enumerate(scored):
        k = bisect_right(ends, s, 0, n)
        use = best[k] + v > best[n]
        best.append(best[k] + v if use else best[n])
        take.append(k if use else -1)
    out, n = [], len(scored)
    while n:
        if take[n - 1] >= 0:
            e, s, kind, _ = scored[n - 1]
            out.append((s, e, kind))
            n = take[n - 1]
        else:
            n -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def train(texts: list[tuple[str, list[tuple[int, int, str]]]], model: Model, rounds: int = 6, rate: float = 0.5, decay: float = 0.002) -> Model:
    """Gradient ascent (AdaGrad) on the conditional log-likelihood of the gold segmentations."""
    lattices = []
    for text, gold in texts:
        cands = sorted(candidates(text, model), key=lambda c: (c[1], c[0], c[2]))
        if cands:
            wanted = set(gold)
            lattices.append((cands, [(s, e, k) in wanted for s, e, k, _ in cands]))
    w, square = model.weights, {}
    for _ in range(rounds):
        for cands, gold in lattices:
            ends = [c[1] for c in cands]
            starts = sorted(range(len(cands)), key=lambda i: cands[i][0])
            score = [model.score(c[3]) for c in cands]
            ahead = [0.0]  # log sum over segmentations that use only the first n candidates
            for n, c in enumerate(cands):
                ahead.append(_log_add(ahead[n], ahead[bisect_right(ends, c[0], 0, n)] + score[n]))
            order = {i: r for r, i in enumerate(starts)}
            begins = [cands[i][0] for i in starts]
            back = [0.0] * (len(cands) + 1)
            for r in range(len(cands) - 1, -1, -1):
                i = starts[r]
                nxt = max(r + 1, _first_from(begins, cands[i][1]))
                back[r] = _log_add(back[r + 1], back[nxt] + score[i])
            z = ahead[-1]
            for n, c in enumerate(cands):
                left = ahead[bisect_right(ends, c[0])] if c[0] >= 0 else 0.0
                right = back[max(order[n] + 1, _first_from(begins, c[1]))]
                p = exp(min(0.0, left + score[n] + right - z))
                g = (1.0 if gold[n] else 0.0) - p
                if abs(g) < 1e-4:
                    continue
                for f in c[3]:
                    d = g - decay * w.get(f, 0.0)
                    square[f] = square.get(f, 1e-6) + d * d
                    w[f] = w.get(f, 0.0) + rate * d / square[f] ** 0.5
    return model


def _first_from(begins: list[int], at: int) -> int:
    lo, hi = 0, len(begins)
    while lo < hi:
        mid = (lo + hi) // 2
        if begins[mid] < at:
            lo = mid + 1
        else:
            hi = mid
    return lo


def training_texts(given: list[str], common: list[str], n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` sentences with their gold segments, composed from a grammar of cases and look-alikes."""
    rng = random.Random(seed)
    heads, mids, tails = "Bar Cald Dorn Ell Fay Gor Hess Kirk Lund Mund Nash Osk Penn Ros Sand Thor Und Var Welt Zell".split(), ["", "a", "e", "i", "o", "en", "er", "im"], "ack and art berg eck el er inger ix ley man mont old ond orn ow sen sky stein ulf".split()
    lower = [w for w in common if len(w) > 3 and w.isalpha()] or ["panel", "report", "season", "morning"]
    surname = lambda: rng.choice(["", "", "", "", "O’", "Mc"]) + rng.choice(heads) + rng.choice(mids) + rng.choice(tails if rng.random() > 0.12 else ["ton", "ness", "ham", "ford", "ley", "well"])
    place = lambda: rng.choice(heads) + rng.choice(mids) + rng.choice("burn ford mere ton wick stead holm mouth gate port ness well dale side combe minster ham".split())
    firm = lambda: rng.choice(heads) + rng.choice("a e i o u".split()) + " " + rng.choice(sorted(FIRM_AFTER)).title()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def full() -> str:
        g = rng.choice(given)
        if rng.random() < 0.15:
            g += "-" + rng.choice(given)
        s = surname() if rng.random() > 0.12 else surname() + "-" + surname()
        r = rng.random()
        if r < 0.15:
            name = f"{g} {rng.choice('ABCDEFGHJKLMNPRST')}. {s}"
        elif r < 0.3:
            name = f"{g} {rng.choice(['van der', 'von', 'de', 'de la', 'del', 'zu', 'du', 'van'])} {s}"
        elif r < 0.45:
            name = f"{s}, {g}"
        elif r < 0.6:
            name = f"{rng.choice('ABCDEFGHJKLMNPRST')}. {s}"
        else:
            name = f"{g} {s}"
        r = rng.random()
        return name.upper() if r < 0.12 else name.lower() if r < 0.2 and not re.match(r"\w\. ", name) else name

    def unlisted() -> str:
        g = rng.choice(heads) + rng.choice("a o i ima ara iel usha".split())
        return f"{g} {rng.choice(['', '', '', 'de ', 'van '])}{surname()}"

    def iban() -> str:
        country, account = rng.choice(["GB", "DE", "FR", "ES"]), "".join(rng.choice("0123456789") for _ in range(18))
        key = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        flat = f"{country}{key:02d}{account}"
        return flat if rng.random() < 0.4 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    def card() -> str:
        d = "4" + digits(14)
        d += next(c for c in "0123456789" if _card_holds(d + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return rng.choice([f"+44 (0)20 {digits(4)} {digits(4)}", f"+44 7{digits(3)} {digits(6)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"07{digits(3)} {digits(6)}", f"({rng.randint(201, 989)}) 555-{digits(4)}", f"1-{rng.randint(201, 989)}-555-{digits(4)}", f"{rng.randint(201, 989)}.555.{digits(4)}", f"{rng.randint(201, 989)}-555-{digits(4)}", f"+1{rng.randint(201, 989)}555{digits(4)}", f"+1 {rng.randint(201, 989)} 555 {digits(4)}", f"+49 171 {digits(8)}", f"(0171) {digits(8)}", f"030 {digits(5)}-{digits(3)}", f"0{digits(3)}/{digits(4)}-{digits(3)}", f"+33 1 99 {digits(2)} {digits(2)} {digits(2)}", f"01-99-{digits(2)}-{digits(2)}-{digits(2)}", f"06.39.{digits(2)}.{digits(2)}.{digits(2)}", f"01{digits(8)}", f"+34 555 01 {digits(2)} {digits(2)}", f"555 0{digits(3)} {digits(3)}", f"5550{digits(6)}", f"(+34) 555-0{digits(3)}-{digits(3)}", f"01 99 {digits(2)} {digits(2)} {digits(2)}"])

    def number() -> str:
        return rng.choice([f"9{digits(2)}-{digits(2)}-{digits(4)}", f"9{digits(2)} {digits(2)} {digits(4)}", f"9{digits(8)}", f"QQ {digits(2)} {digits(2)} {digits(2)} C", f"QQ-{digits(2)}-{digits(2)}-{digits(2)}-B", f"QQ{digits(6)}A", f"1 {digits(2)} 13 99 {digits(3)} {digits(3)} {digits(2)}", f"2 {digits(2)} 13 99 {digits(3)} {digits(3)} ({digits(2)})", f"2{digits(2)}1399{digits(8)}", f"00 {digits(3)} {digits(3)} {digits(3)}", f"00{digits(9)}", f"T{digits(4)}K{digits(3)}-{digits(3)}", f"L0X{digits(3)}Y{digits(6)}", f"{digits(8)}-{rng.choice('PRFMQ')}", f"{digits(2)}.{digits(3)}.{digits(3)}-{rng.choice('PRFMQ')}", f"{digits(8)}{rng.choice('PRFMQ')}", f"X{digits(7)}-{rng.choice('PRFMQ')}"])

    def address() -> str:
        k, x, y = rng.randint(1, 2500), rng.choice(heads), surname().replace("’", "").replace("Mc", "").title()
        return rng.choice([f"{k} {y} {rng.choice(['Street', 'Road', 'Lane', 'Ave', 'St', 'Rd', 'Close', 'Row', 'Crescent'])}", f"{k}-{k + 2} {y} Lane", f"{k}B {x} {y} Road", f"{k} W. {y} Close", f"{k} North {y} Row", f"{k} bis, avenue des {y}s", f"{k} bis avenue des {y}s", f"{k} avenue de la {y}", f"{k} rue du {x} {y}", f"{k} ter bd de la {y}", f"{k}, quai de l’{y}", f"{y}straße {k % 300}a", f"{y}weg {k % 300}", f"An der {y}brücke {k % 300}b", f"{y}str. {k % 300}", f"Calle de la {y} {k % 300}", f"C/ del {y} {k % 300}", f"Plaza de la {y}, n.º {k % 300}", f"Paseo del {y} {x} {k % 300}"])

    def email() -> str:
        user, host = rng.choice([surname().lower(), rng.choice(given).lower() + "." + surname().lower(), surname().lower() + digits(2), surname().lower() + "+news"]).replace("’", ""), rng.choice(heads).lower() + rng.choice(["", "-mail", "-press"])
        at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", "."), (" [at] ", "[dot]"), (" (at) ", "[dot]"), ("[at]", " [dot] ")])
        x = user + at + host + dot + rng.choice(["example", "test", "invalid"])
        return x.upper() if rng.random() < 0.15 else x

    makers = {"person_name": full, "phone": phone, "id_number": number, "street_address": address, "email": email}
    frames = {
        "person_name": ["Reporting by {} in {p}", "Photograph: {}", "Foto: {}", "{}, {p}", "“We wait,” said {} of {f}.", "The {c} {c}. {} said the {c} would fail.", "The register names {} as director.", "Comment from {}: the {c} failed", "Laut {} prüft {f} das Haus.", "Selon {}, {f} attend.", "{c} {} told {f} so.", "sagte {} von {f}.", "dijo {}, de {f}."],
        "phone": ["Call {} now.", "Tel.: {}", "Press office: {}", "Text {} to take part.", "A line, {}, gives tides.", "{}, weekdays only", "unter {} erreichbar.", "appeler le {}.", "llamar al {}."],
        "id_number": ["ID: {}", "{} appears on page two.", "social security number as {}.", "National insurance no. {} appears.", "taxpayer number {} unredacted.", "NIR : {}", "sécurité sociale {}.", "Steuer-ID {}.", "DNI {}.", "Documento: {}"],
        "street_address": ["Letters: {}, {p}", "The tenant of {} in {p} declined.", "a flat at {}, {p}, at dawn.", "notice for {} was withdrawn.", "Das Haus {} in {p} bleibt.", "Le local du {} à {p} reste.", "El local de {}, en {p}, sigue."],
        "email": ["Contact: {}", "Statements went to {}; none was answered.", "mailto:{}", "({}) are published", "“reply to {}”."],
    }
    decoys = [
        lambda: f"The trawler {rng.choice(given)} {place()} left port late.",
        lambda: f"{rng.choice(['Storm', 'Hurricane', 'Sturm', 'Borrasca'])} {rng.choice(given)} {rng.choice(['crossed', 'hit'])} {place()} overnight.",
        lambda: f"The {rng.choice(given)} Mill Trust runs 30 sites.",
        lambda: f"the census near {rng.choice(given)} {rng.choice(sorted(PLACE_AFTER)).title()} had failed.",
        lambda: f"{rng.choice(given)} {rng.choice(lower)} the {rng.choice(lower)}.",
        lambda: f"as vitamin {rng.choice('CDEK')}. {rng.choice(lower).title()} on the {rng.choice(lower)} began.",
        lambda: f"in {place()}, {rng.choice(given)} {rng.choice(lower)} it.",
        lambda: f"The notice carries the docket {digits(3)}-{digits(2)}-{digits(5)}.",
        lambda: f"ISBN 978-0-00-{digits(6)}-{digits(1)} is sold out.",
        lambda: f"Lot {digits(8)} sold for {digits(3)} crowns.",
        lambda: f"Lot {rng.choice('123456789')}{digits(8)} sold.",
        lambda: f"The parcel code is ZX{digits(6)}.",
        lambda: f"Build {digits(1)}.{digits(3)}.{digits(2)} of the app. Turnover rose from {digits(3)},{digits(3)} to {digits(2)},{digits(3)}.",
        lambda: f"Install widget@{digits(2)}.{digits(1)}.{digits(1)} from the archive. Follow @{place().lower()}wire.",
        lambda: f"Bus {digits(2)} now stops at {surname()} Lane.",
        lambda: f"cost {digits(2)} million crowns on the road between {place()} and {place()}.",
        lambda: f"Open 10:15-11:45 on {digits(2)} days. {digits(40)}",
        lambda: f"{digits(3)} pages of evidence in a row.",
        lambda: f"{rng.choice(['The', 'near', 'for'])} {firm()}, {rng.randint(18, 90)}, {rng.choice(lower)} it.",
        lambda: f"from {rng.choice(heads)} {rng.choice(sorted(PLACE_AFTER)).title()}, {rng.randint(18, 90)}, it ran.",
        lambda: f"Order {rng.choice('23456')}{digits(15)} left.",
    ]
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    while len(out) < n:
        if rng.random() < 0.05:
            head, name = f"in {place()} ", f"{rng.choice(given)} {surname()}"
            out.append((f"{head}{name} {rng.choice(lower)} so.", [(len(head), len(head) + len(name), "person_name")]))
            continue
        if rng.random() < 0.06:
            head, name, tail = rng.choice(["“We wait,” said ", "", f"{rng.choice(lower)} by "]), unlisted(), f", {rng.randint(18, 90)}, of {place()}."
            if rng.random() < 0.5:
                head, tail = head + rng.choice(["Mr ", "Ms ", "Dr. ", "Herr ", "Frau ", "Mme ", "Sra. "]), f" {rng.choice(lower)} it."
            out.append((head + name + tail, [(len(head), len(head) + len(name), "person_name")]))
            continue
        if rng.random() < 0.04:
            head, number_ = rng.choice(["Account: ", "paid to ", "Card ", "IBAN "]), rng.choice([iban, card])()
            out.append((f"{head}{number_} by noon.", [(len(head), len(head) + len(number_), "id_number")]))
            continue
        if rng.random() < 0.4:
            out.append((rng.choice(decoys)(), []))
            continue
        kind = rng.choice(KINDS)
        if kind == "person_name" or rng.random() < 0.3:
            kind = "person_name"
        value = makers[kind]()
        frame = rng.choice(frames[kind]).replace("{p}", place()).replace("{f}", firm())
        while "{c}" in frame:
            frame = frame.replace("{c}", rng.choice(lower), 1)
        at = frame.index("{}")
        gold = [(at, at + len(value), kind)]
        text = frame.replace("{}", value)
        out.append((text, gold))
    return out


_LOWER = re.compile(r"(?<![\w’'.-])[^\W\d_]+(?:[’'-][^\W\d_]+)*")


def common_words(docs: DataFrame, least: int = 5, one_in: int = 300) -> list[str]:
    """Lower-case words of at least ``least`` documents and of one document in ``one_in``, counted over all documents.

    Batches send their counts, not their texts; the share bounds the list to ``one_in`` times the words of a document.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[str, int] = {"": len(pdf)}
            for text in pdf["text"]:
                for w in {w for w in find_all(text or "") if w[0].islower()}:
                    counts[w] = counts.get(w, 0) + 1
            yield pd.DataFrame({"word": list(counts), "n": pd.Series(list(counts.values()), dtype="int64")})

    find_all = _LOWER.findall
    found = cut_lineage(spread(docs.select("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = found.where("word = ''").first()
    if total is None:
        return []
    return sorted(r.word for r in found.where((F.col("word") != "") & (F.col("n") >= max(least, total.n // one_in))).collect())


def fit(docs: DataFrame, given_names: DataFrame, n_train: int = 4000, most_names: int = 200_000) -> Model:
    """The trained model.

    Its lexicon of common words is counted over all documents; ``n_train`` sentences are composed, not drawn from
    them.  The given names are a table of fixed size, and more than ``most_names`` of them are an error, never a
    part of them.
    """
    listed = given_names.select("given_name").distinct().limit(most_names + 1).collect()
    if len(listed) > most_names:
        raise ValueError(f"more than {most_names} given names")
    given = sorted({r[0].strip() for r in listed if r[0] and r[0].strip()})
    common = common_words(docs)
    names = {x.lower() for x in given}
    model = Model(given, [w for w in common if w not in names])
    if not given:
        model.given = frozenset()
        given = ["Robin"]
    return train(training_texts(given, common, n_train), model)


def _spans(docs: DataFrame, model: Model) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.given, model.common, model.weights))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import pii as own

        m = own.Model(*shared.value)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                rows += [(doc_id, kind, s, e, text[s:e]) for s, e, kind in own.best_segments(own.candidates(text, m), m)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_kind", "start", "stop", "found_text"])

    return spread(docs.where(F.length("text") > 0).select("doc_id", "text")).mapInPandas(search, "doc_id long, pii_kind string, start int, stop int, found_text string")


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, pii_kind, found_text of every detail, each once per document."""
    spans = _spans(docs, model)
    # equal details of one document come from one batch row, so this distinct combines map-side
    return spans.select("doc_id", "pii_kind", "found_text").distinct()


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and text with each detail replaced by its kind in capitals in angle brackets (null stays null)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.given, model.common, model.weights))

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidewire.llm import pii as own

        m = own.Model(*shared.value)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if text:
                    parts, at = [], 0
                    for s, e, kind in own.best_segments(own.candidates(text, m), m):
                        parts += [text[at:s], f"<{kind.upper()}>"]
                        at = e
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": out})

    return spread(docs.select("doc_id", "text")).mapInPandas(replace, "doc_id long, text string")
