import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidewire.llm import boilerplate, sitelines, tokenizer, truncation

V = "rec_table string, rec_id long, source_id string, column_name string, text string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "blank"), ("", "blank"), (" \n", "blank"), ("<p></p>", "blank"),
        ("The stadium stayed shut.", "complete"), ("Did it fail?</p>", "complete"), ("It was a shrug and “we shall see…”", "complete"), ("It stayed shut. ⚽", "complete"), ("It stayed shut. […]", "complete"), ("avant l&#8217;été.", "complete"),
        ("In pictures – Velba", "label"), ("Podcast: X and what comes next (32 min)", "label"), ("Why X want Y | 4 min read", "label"), ("Done at last. (Photo: Vasti Works)", "label"), ("Full table at https://a.example/t/1", "label"),
        ("The panel delayed the southern...", "marked"), ("Le budget de […]</p>", "marked"), ("The overdue review [&#8230;]", "marked"), ("promised by… Read the full story »", "marked"), ("in the… Weiterlesen", "marked"), ("and (sic)...", "marked"),
        ("All shut. About 66 per cent of residents in Thams", "stops"), ("All shut. “We asked for a harvest,”", "stops"), ("It failed. He told Julia G.", "stops"),
        ("About 52 per cent of cyclists in Wynva", "fragment"), ("despite warnings</", "broken_markup"), ("betwee&#82</p>", "broken_markup"), ('the seven<a href="https:/', "broken_markup"),
    ],
)
def test_endings(text, want):
    assert truncation.ending(text) == want


def test_truncated_at_spike(spark):
    rng = random.Random(3)
    sentence = lambda n: ("word " * n).strip()[: n - 1]
    cut = [("t", i, "s", "d", (f"{i} Full stop here. " + sentence(400))[:155]) for i in range(40)]
    label = [("t", 100, "s", "d", ("Podcast: " + "x" * 200)[:155]), ("t", 101, "s", "d", "Podcast: on")]
    fine = [("t", 200 + i, "s", "d", sentence(rng.randrange(20, 150)) + ".") for i in range(60)] + [("t", 300, None, "d", None), ("t", 301, None, "d", ""), ("t", 302, "o", "d", "y" * 200_000 + ".")]
    df = spark.createDataFrame([r + ("clash",) for r in cut + label + fine + [cut[0]]], V + ", evidence string")
    got = truncation.find_truncated(df)
    assert {r.rec_id for r in got.where("evidence = 'spike'").collect()} == set(range(40)) | {100}
    assert got.where("rec_id >= 101").count() == 0 and got.where("rec_id = 0").count() == 2
    assert truncation.find_truncated(df.limit(0)).count() == 0


def test_spikes_of_each_table(spark):
    """A limit of one table shows although the same source's other table holds longer texts."""
    cut = [("a", i, "s", "d", (f"{i} Full stop here. " + "word " * 80)[:155]) for i in range(20)] + [("a", 100, "s", "d", ("Podcast: " + "x" * 200)[:155])]
    longer = [("b", 200 + i, "s", "d", "w" * (200 + 3 * i) + ".") for i in range(100)]
    got = truncation.find_truncated(spark.createDataFrame(cut + longer, V))
    assert {r.rec_id for r in got.where("evidence = 'spike'").collect()} == set(range(20)) | {100}


def test_run_up_below_a_word_limit(spark):
    """Texts cut at the last whole word before 120 characters: no length repeats often, all stand just below it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 11)))
    cut = []
    for i in range(60):
        text = "One is done. "
        while len(text) <= 120:
            text += word() + " "
        cut.append(("t", i, "s", "d", text[:120].rsplit(" ", 1)[0]))
    fine = [("t", 100 + i, "s", "d", ("word " * rng.randrange(4, 60)).strip() + ".") for i in range(60)]
    loose = [("t", 200, "s", "d", "One is done. It was"), ("t", 201, None, "d", "One is done. It was")]
    got = {r.rec_id: r.evidence for r in truncation.find_truncated(spark.createDataFrame(cut + fine + loose, V)).collect()}
    assert set(got) == set(range(60)) | {200, 201} and got[200] == got[201] == "stops"
    assert sum(e == "run_up" for e in got.values()) >= 50


HTML = """<div class="c-1">
<span><a href="/x">Sections: Front page, World</a></span>
<script>var q=1;</script>
</div>
<div class="c-2">
<h1>The Headline</h1>
<p>The voluntary regulator surveyed the observatory, and the quarry stayed shut for weeks.</p>
<div>ADVERTISEMENT – SCROLL TO CONTINUE</div>
<h3>Yarbaside – Rivdrago Foods: voices</h3>
<p>Readers who share the story of <a href="/t">Triven Foods</a> with friends in Cormocombe are part of the study.</p>
<li>For tenants, the quiet patent matters less than the battery promised by Globenex Labs.</li>
</div>

<div class="c-3">
<p>Colin A covers inland affairs in B for The C and joined the title from D.</p>
<p>Back to top</p>
</div>"""


PLAIN = boilerplate.Wording()
SITE = boilerplate.Wording(dict.fromkeys(("covers", "affairs", "joined", "rights", "reserved", "©"), 3.0), -4.0)


def test_page_roles():
    roles = boilerplate.page_roles(HTML, "The Headline", True, SITE)
    assert [i for i, r in enumerate(roles, 1) if r == "furniture"] == [2, 8, 15, 16]
    assert [i for i, r in enumerate(roles, 1) if r == "story"] == [6, 7, 9, 10, 11]
    text = "Skip to main content\n\n# Own title\n\nA sentence about cookies on the portal was a complaint.\n- Headline without stop\nOWN TITLE\n## A – B: the numbers\n© 2026 X Ltd. All rights reserved.\nThe panel measured it. It was wtihin the shrinking and the very long sentence that an editor forgot to end with a stop"
    assert [i for i, r in enumerate(boilerplate.page_roles(text, "Own title", False, SITE), 1) if r == "furniture"] == [1, 6, 9]
    assert boilerplate.page_roles(None, None, True, PLAIN) == [] and boilerplate.page_roles("", "t", False, PLAIN) == []
    assert boilerplate.page_roles("x" * 300_000 + ".", None, False, PLAIN) == ["story"]


def test_prose_outside_the_container():
    """Sentences no list knows, in a block beside the container, and a sibling that goes on with the story."""
    story = "<p>The voluntary regulator surveyed the observatory, and the quarry, to some surprise, stayed shut for weeks.</p>"
    page = ["<div>", *[story] * 4, "</div>", "<div>", *[story] * 2, "</div>", "<div>", "<p>Our reporter has lived beside the harbour since the spring.</p>", "</div>"]
    roles = boilerplate.page_roles("\n".join(page), None, True, PLAIN)
    assert [i for i, r in enumerate(roles, 1) if r == "story"] == [2, 3, 4, 5, 8, 9]
    assert [i for i, r in enumerate(roles, 1) if r == "furniture"] == [12]


def invented(rng, n):
    """Pages and plain texts of an invented language: sentences of the story, and of a site that nobody listed."""
    syllable = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(2))
    story, site = [syllable() + "a" for _ in range(300)], [syllable() + "x" for _ in range(25)]
    tell = lambda words, k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    pages, texts = [], []
    for i in range(n):
        own = [tell(story, 18) for _ in range(20)]
        around = [tell(site, 7) for _ in range(3)]
        pages.append(("rss_items", i, None, "\n".join(["<div>", *[f"<p>{x}</p>" for x in own], "</div>", "<div>", *[f"<p>{x}</p>" for x in around], "</div>"]), True))
        texts.append(("news_articles", i, None, "\n".join([tell(story, 18), tell(site, 7), tell(story, 9), tell(site, 9)]), False))
    return pages, texts


def test_the_trees_teach_what_stands_in_plain_texts(spark):
    pages, texts = invented(random.Random(8), 60)
    columns = "rec_table string, rec_id long, title string, body string, is_html boolean"
    wording = boilerplate.learn_wording(spark.createDataFrame(pages, columns))
    got = rows(boilerplate.furniture_lines(spark.createDataFrame(texts, columns), wording).select("rec_id", "line_no"))
    assert got == sorted([(i, n) for i in range(60) for n in (2, 4)], key=str)
    # without trees there is nothing to learn, and finished sentences are story
    assert not boilerplate.learn_wording(spark.createDataFrame(texts, columns)).weights
    assert boilerplate.learn_wording(spark.createDataFrame(pages, columns).limit(0)).weights == {}
    assert boilerplate.furniture_lines(spark.createDataFrame(texts, columns), PLAIN).count() == 0


def test_furniture_frames(spark):
    df = spark.createDataFrame([("rss_items", 1, None, None, True, 5), ("rss_items", 2, "t", "", True, 5), ("rss_items", 3, "The Headline", HTML, True, 5), ("rss_items", 3, "The Headline", HTML, True, 5)], "rec_table string, rec_id long, title string, body string, is_html boolean, line_no int")
    assert boilerplate.furniture_lines(df, SITE).count() == 8
    assert boilerplate.furniture_lines(df.limit(0), PLAIN).count() == 0
    main = {r.rec_id: r.main for r in boilerplate.main_text(df, SITE).collect()}
    assert main[1] is None and main[2] == "" and main[3].count("\n") == 4


def test_site_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["Read more", "read  MORE", "Share\xa0this", "SHARE this ", "Legal notice.", "", "  ", "Straße", "unique"]
    docs = [(i, rng.choice(["A", "A", "A", "B", None]), "\n".join(rng.choice(pool) + (str(rng.random()) if rng.random() < 0.3 else "") for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    docs += [(100, "A", None), (101, "A", "y" * 100_000)]
    key = lambda s: " ".join(s.split()).lower()
    seen = {}
    for i, s, c in docs:
        for k in {key(x) for x in (c or "").split("\n")} - {""} if s else ():
            seen.setdefault((s, k), set()).add(i)
    want = sorted((i, n) for i, s, c in docs if s and c for n, x in enumerate(c.split("\n"), 1) if key(x) and len(seen[s, key(x)]) >= 6)
    df = spark.createDataFrame([d + ("z",) for d in docs], "row_id long, source_name string, content string, line_no string")
    for length in (1, 3):
        assert rows(sitelines.frequent_sequences(df, 6, length)[1].select("row_id", "line_no")) == sorted(want, key=str)
    sequences, places = sitelines.frequent_sequences(df, 6, 3)
    clean = {r.row_id: r.content for r in sitelines.strip_lines(df, places).collect()}
    assert clean[100] is None and len(clean[101]) == 100_000 and all("Legal notice." not in (clean[i] or "").split("\n") for i, s, _ in docs if s == "A")
    assert sitelines.frequent_sequences(df.limit(0))[1].count() == 0
    # a sequence is reported with its support
    pair = spark.createDataFrame([(i, "S", f"own {i}\nfirst\nmiddle {i}\nsecond") for i in range(7)], "row_id long, source_name string, content string")
    assert {(r.length, r.n_docs) for r in sitelines.frequent_sequences(pair, 6, 3)[0].collect()} == {(1, 7), (2, 7)}


def test_site_sequences_with_gaps(spark):
    """A line between others in half of the documents, and sequences longer than three."""
    docs = [(i, "S", "\n".join(["A", *(["B"] if i % 2 else []), f"own {i}", "C", "D", "E"])) for i in range(12)]
    found = sitelines.frequent_sequences(spark.createDataFrame(docs, "row_id long, source_name string, content string"))[0].collect()
    got = {}
    for r in found:
        got[r.length, r.n_docs] = got.get((r.length, r.n_docs), 0) + 1
    # A, C, D, E stand in all twelve, B in six: every choice with and without B
    assert got == {(1, 12): 4, (1, 6): 1, (2, 12): 6, (2, 6): 4, (3, 12): 4, (3, 6): 6, (4, 12): 1, (4, 6): 4, (5, 6): 1}

def test_tokenizer(spark):
    import tiktoken

    with open(tokenizer.RANK_FILE, "rb") as f:
        raw = f.read()
    whole = tiktoken.Encoding("t", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_ranks(raw), special_tokens={})
    texts = ["", None, "Hello  world", "naïve café 👧🏽 \n\n x", "<|endoftext|>", "a" * 5000, "The quick brown fox. " * 5000, " lead", "tab\t\ttab ", "﻿bom ﬁnal"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    enc = tokenizer.encode_corpus(df.select("doc_id", "text"), chunk_chars=1000)
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in tokenizer.decode_corpus(enc).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenizer.encode_corpus(df.select("doc_id", "text").limit(0)).count() == 0
    for text in (texts[6], "ab " * 400 + "  cd\xa0 ef " * 300):
        assert "".join(tokenizer.pieces(text, 100)) == text
        assert [i for p in tokenizer.pieces(text, 100) for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text)
    assert rows(df.select(F.size("ids"))) == [(1,)] * len(texts)
