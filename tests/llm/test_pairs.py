import random
import shutil
from itertools import combinations

import pytest
from helpers import rows

from tidewire.llm import history, leakage, neardup, pii

WORDS = [f"w{i}" for i in range(4000)]
ART = "row_id long, title string, description string, content string, print string"


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    base = [[rng.choice(WORDS) for _ in range(90)] for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(rng.randrange(0, 5)):
            c = list(b)
            for _ in range(rng.randrange(0, 8)):
                c[rng.randrange(len(c))] = rng.choice(WORDS)
            texts.append(c)
    made = [(i, " ".join(t[:8]), " ".join(t[8:20]), " ".join(t[20:]) + ".", None) for i, t in enumerate(texts)]
    made += [(900, None, None, None, None), (901, "", "", "", None), (902, "one", None, None, None), (903, "One!", None, None, None), (904, None, None, "Back to top", None)]
    made += [(1000 + i, *made[0][1:]) for i in range(30)]
    sets = {r[0]: set(neardup.sequences("\n".join(x or "" for x in r[1:4])).tolist()) for r in made}
    sets[904] = set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.45 * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    want = sorted((i, find(i)) for i in sets if sets[i])
    df = spark.createDataFrame(made, ART)
    groups = neardup.near_duplicate_groups(df)
    assert rows(groups) == sorted(want, key=str)
    pairs = {(r.row_id_a, r.row_id_b) for r in neardup.group_pairs(groups).collect()}
    assert pairs == {(a, b) for a, b in combinations(sorted(i for i, _ in want), 2) if find(a) == find(b)}
    assert neardup.near_duplicate_groups(df.limit(0)).count() == 0


def test_hot_block_members_all_meet(spark):
    """Texts that share one block's head but are close to each other only."""
    rng = random.Random(9)
    common = [rng.choice(WORDS) for _ in range(60)]
    made = []
    for i in range(40):
        own = [rng.choice(WORDS) for _ in range(30)]
        made += [(2 * i, " ".join(common + own), None, None, None), (2 * i + 1, " ".join(common + own[:28] + ["zz", f"q{i}"]), None, None, None)]
    sizes = {}
    for r in neardup.near_duplicate_groups(spark.createDataFrame(made, ART)).collect():
        sizes[r.group_id] = sizes.get(r.group_id, 0) + 1
    assert sum(sizes.values()) == 80 and all(n % 2 == 0 for n in sizes.values())


def test_borderline_pairs_are_found(spark):
    """Isolated pairs just at the threshold, and just below it."""
    made, want = [], set()
    for i in range(400):
        a = [f"p{i}x{k}" for k in range(102)]
        shared = 63 if i % 2 else 62
        b = a[: shared + 2] + [f"q{i}x{k}" for k in range(100 - shared)]
        made += [(2 * i, " ".join(a), None, None, None), (2 * i + 1, " ".join(b), None, None, None)]
        x, y = (set(neardup.sequences(" ".join(t)).tolist()) for t in (a, b))
        if len(x & y) >= 0.45 * len(x | y):
            want.add((2 * i, 2 * i + 1))
    groups = neardup.near_duplicate_groups(spark.createDataFrame(made, ART))
    assert len(want) == 200 and {(r.row_id_a, r.row_id_b) for r in neardup.group_pairs(groups).collect()} == want


def test_clear_pairs_need_no_sequences(spark, monkeypatch):
    """Pairs well above or below the threshold are decided by their fingerprints, and these are small."""
    made = []
    for i in range(300):
        shared = 86 if i < 100 else 25
        a = [f"c{i}x{k}" for k in range(102)]
        made += [(2 * i, " ".join(a), None, None, None), (2 * i + 1, " ".join(a[: shared + 2] + [f"d{i}x{k}" for k in range(100 - shared)]), None, None, None)]
    asked, exact = [], neardup._exact
    monkeypatch.setattr(neardup, "_exact", lambda pairs, *rest: (asked.append(pairs.count()), exact(pairs, *rest))[1])
    groups = neardup.near_duplicate_groups(spark.createDataFrame(made, ART))
    assert {(r.row_id_a, r.row_id_b) for r in neardup.group_pairs(groups).collect()} == {(2 * i, 2 * i + 1) for i in range(100)}
    assert sum(asked) < 20


def test_copies_beyond_broadcast(spark, monkeypatch):
    """Copies fold in the same way when there are too many for a broadcast."""
    made = [(i, " ".join(WORDS[40 * (i % 5) : 40 * (i % 5) + 40]), None, None, None) for i in range(40)]
    made += [(100 + i, " ".join(WORDS[40 * i : 40 * i + 38] + ["x", "y"]), None, None, None) for i in range(3)]
    df = spark.createDataFrame(made, ART)
    want = sorted([(i, i % 5) for i in range(40)] + [(100 + i, i) for i in range(3)])
    for most in (neardup.BROADCAST_ROWS, 3):
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", most)
        assert sorted((r.row_id, r.group_id) for r in neardup.near_duplicate_groups(df).collect()) == want


FEEDS = "source_id string, source_name string"
HIST = "row_id long, source_id string, source_name string, title string, link string, guid string, ord long"
ITEM = "item_id long, source_id string, title string, link string, guid string, words string"


def _titles(rng, n):
    vocab = [f"t{i}" for i in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = list(rng.choice(out))
            for _ in range(rng.randrange(1, 4)):
                k = rng.random()
                if k < 0.4:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                elif k < 0.7:
                    w.append(rng.choice(vocab))
                elif len(w) > 5:
                    w.pop()
        else:
            w = rng.sample(vocab, rng.randrange(4, 26))
        out.append(w)
    return out


def test_repeats_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    titles = _titles(rng, 260)
    old = [(i, rng.choice(["a", "b", None]), rng.choice(["A", None]), " ".join(t), rng.choice([None, f"https://www.x.example/p/{i % 40}/?utm_source=q"]), rng.choice([None, "", f" g{i % 50}"]), 7) for i, t in enumerate(titles[:80])]
    new = [(i, rng.choice(["a", "b"]), rng.choice(["{} - A", "{}"]).format(" ".join(t)), rng.choice([None, "", f"http://x.example/p/{rng.randrange(200)}#top"]), rng.choice([None, f"g{rng.randrange(400)}\n"]), "x") for i, t in enumerate(titles[80:])]
    new += [(900, "a", None, None, None, None), (901, "a", "one two", None, None, None), (902, "a", "One two - A", None, None, None), (903, "a", "v " * 3000 + " ".join(WORDS[:300]), None, None, None), (904, "a", " ".join(WORDS[:301]), None, None, None)]
    name = {"a": "A", "b": "B"}

    def words(title, outlet):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (title or "").lower()).split()]
        if outlet and len(w) > 1 and w[-1] == outlet.lower():
            w = w[:-1]
        return frozenset(w) if len(w) >= 5 else None

    seen, want = [], set()
    for i, s, n, t, link, g in [(-1, r[1], r[2] or name.get(r[1]), r[3], r[4], r[5]) for r in old] + [(r[0], r[1], name[r[1]], r[2], r[3], r[4]) for r in new]:
        g, p, w = (g or "").strip(), (link or "").split("//")[-1].replace("www.", "").split("?")[0].split("#")[0].rstrip("/"), words(t, n)
        if i >= 0 and any((g and g == a[1] and s is not None and s == a[0]) or (p and p == a[2]) or (w and a[3] and 5 * len(w & a[3]) >= 4 * len(w | a[3])) for a in seen):
            want.add(i)
        seen.append((s, g, p, w))
    feeds = spark.createDataFrame(list(name.items()), FEEDS)
    o = history.arrivals(spark.createDataFrame(old, HIST), feeds, "row_id", True)
    items = spark.createDataFrame(new, ITEM)
    n = history.arrivals(items, feeds, "item_id", False)
    assert {r.id for r in history.repeats(o, n).collect()} == want
    assert history.repeats(o, n.limit(0)).count() == 0
    # batch after batch against the stored table
    path = str(tmp_path / "table")
    found = set()
    history.append_batch(path, o, "old")
    for lo, hi in ((0, 60), (60, 130), (130, 1000)):
        batch = history.arrivals(items.where(f"item_id >= {lo} AND item_id < {hi}"), feeds, "item_id", False)
        mine = {r.id for r in history.check_batch(spark, path, batch, f"b{lo}").collect()}
        found |= mine
    # a batch that is delivered again replaces itself, and one without mark does not count
    assert {r.id for r in history.check_batch(spark, path, batch, "b130").collect()} == mine
    history.append_batch(path, batch, "half")
    shutil.rmtree(f"{path}/marks/of=half")
    assert {r.id for r in history.judge(spark, path, batch, "b130").collect()} == mine
    assert found == want


def test_leaks_against_brute_force(spark):
    rng = random.Random(13)
    vocab = [f"v{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(8)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        src = rng.choice(items[:8])[1].split()
        k = rng.choice([13, 14, 15, 16, 22])
        at = rng.randrange(0, len(src) - k)
        piece = src[at : at + k]
        if d % 3 == 0:
            piece = [x.upper() + "," for x in piece]
        elif d % 3 == 1 and k > 20:
            piece[10] = "substituted"
        docs.append((d, "\n".join([" ".join(w), "  ".join(piece), "end"])))
    docs += [(100, None), (101, ""), (102, "Ärger café " * 40), (103, "v1 " * 30_000)]

    def held(doc, item):
        a, b = leakage.words_of(doc), leakage.words_of(item)
        grams = {tuple(b[i : i + 15]) for i in range(len(b) - 14)}
        return any(tuple(a[i : i + 15]) in grams for i in range(len(a) - 14))

    want = sorted((d, i) for d, t in docs for i, x in items if held(t, x))
    dd, ii = spark.createDataFrame([d + (1,) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, item_text string")
    for limit in (8_000_000, 0):
        assert rows(leakage.leaks(dd, ii, broadcast_chars=limit).where("exact_words >= 15").select("doc_id", "item_id")) == sorted(want, key=str)
    assert leakage.leaks(dd.limit(0), ii).count() == 0 and leakage.leaks(dd, ii.limit(0)).count() == 0
    assert leakage.leaks(dd, ii).where("exact_words < 15 AND tolerant_words >= 15").count() > 0
    assert leakage.words_of("É​TÉ, l’œuvre") == ["ete", "l", "œuvre"]


GIVEN = ["Julia", "Owen", "Nina", "Jörg", "Hélène"]


def test_pii(spark):
    texts = {
        1: "“We asked,” said Julia G. Holcarim of Vecca Group. Call +44 (0)20 7946 0604 or (893) 555-0192.",
        2: "Contact: fenbax-owen [at] desk[dot]helven[dot]example\nHOLNESS, NINA, Osloford. mailto:a+news@b.co.example",
        3: "NIR : 1 96 13 99 951 516 (85)\nID: 967-34-6390. QQ 46 19 97 C appears on page two. Steuer-ID 00 148 624 795.",
        4: "The tenant of 82-84 W. Fernhill Lane in Rysmo declined. Courrier : 167 ter, avenue des Tanneurs, Dunlo\nPost an: Erlengasse 173b, Tormi\nCorreo: Plaza de la Ermita, n.º 123, Zelmi",
        5: "The trawler Julia Osmoruburn left port. Storm Nina crossed it. The Owen Mill Trust runs 3 sites. near Julia Wharf. Lot 98936284 sold. docket 410-14-00372. ISBN 978-0-00-449258-6. widget@43.4.2 and Bus 94 now stops at Quarry Lane.",
        6: "Laut Jörg von Tarmoviss prüft Trimi Foundation das Haus. Reporting by T. Obrjunt in Stoden",
        7: None,
        8: "",
        9: "x " * 100_000 + "said Owen Holdand of Y. said Owen Holdand of Y.",
    }
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, start string")
    model = pii.fit(docs, spark.createDataFrame([(g,) for g in GIVEN], "given_name string"))
    got = {}
    for r in pii.find(docs, model).collect():
        got.setdefault(r.doc_id, set()).add((r.pii_kind, r.found_text))
    assert got == {
        1: {("person_name", "Julia G. Holcarim"), ("phone", "+44 (0)20 7946 0604"), ("phone", "(893) 555-0192")},
        2: {("email", "fenbax-owen [at] desk[dot]helven[dot]example"), ("person_name", "HOLNESS, NINA"), ("email", "a+news@b.co.example")},
        3: {("id_number", "1 96 13 99 951 516 (85)"), ("id_number", "967-34-6390"), ("id_number", "QQ 46 19 97 C"), ("id_number", "00 148 624 795")},
        4: {("street_address", "82-84 W. Fernhill Lane"), ("street_address", "167 ter, avenue des Tanneurs"), ("street_address", "Erlengasse 173b"), ("street_address", "Plaza de la Ermita, n.º 123")},
        6: {("person_name", "Jörg von Tarmoviss"), ("person_name", "T. Obrjunt")},
        9: {("person_name", "Owen Holdand")},
    }
    red = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert red[1] == "“We asked,” said <PERSON_NAME> of Vecca Group. Call <PHONE> or <PHONE>." and red[5] == texts[5] and red[7] is None and red[8] == "" and red[9].count("<PERSON_NAME>") == 2
    assert pii.find(docs.limit(0), model).count() == 0


def test_pii_held_out_accuracy():
    common = ["panel", "report", "season", "morning", "asked", "director"]
    model = pii.train(pii.training_texts(GIVEN, common, 2500, seed=1), pii.Model(GIVEN, common))
    held = pii.training_texts(GIVEN, common, 600, seed=2)
    right = sum(pii.best_segments(pii.candidates(t, model), model) == gold for t, gold in held)
    assert right >= 0.97 * len(held)


#: Written by hand, not from the grammar of the training: (text, its details by kind).
OTHER_SOURCE = [
    ("Xiomara Quillfeather, 52, said the plan had failed.", {"person_name": ["Xiomara Quillfeather"]}),
    ("The letter was signed by Karim Haddad, 44, and posted to 12 Orchard Road.", {"person_name": ["Karim Haddad"], "street_address": ["12 Orchard Road"]}),
    ("Dr. Amara Okonkwo can be reached on +44 20 7946 0123 or a.okonkwo@clinic.example.", {"person_name": ["Amara Okonkwo"], "phone": ["+44 20 7946 0123"], "email": ["a.okonkwo@clinic.example"]}),
    ("Transfer the deposit to GB82 WEST 1234 5698 7654 32 before Friday.", {"id_number": ["GB82 WEST 1234 5698 7654 32"]}),
    ("He paid with 4111 1111 1111 1111 at the till; order 4111 1111 1111 1112 was void.", {"id_number": ["4111 1111 1111 1111"]}),
    ("Write to P.O. Box 44; the Harbour Trust, 40, closed in spring.", {}),
    ("Frau Annegret von Sallwitz wohnt in der Lindenstraße 8a.", {"person_name": ["Annegret von Sallwitz"], "street_address": ["Lindenstraße 8a"]}),
    ("“It is late,” Julia Kettering told the council on Monday.", {"person_name": ["Julia Kettering"]}),
    ("Hurricane Julia reached Port Maddox at 06:30 with 120 km/h winds.", {}),
    ("Ask for Owen R. Tully at owen [at] tully [dot] example.", {"person_name": ["Owen R. Tully"], "email": ["owen [at] tully [dot] example"]}),
    ("Mme Solange Périer habite 14 rue des Lilas.", {"person_name": ["Solange Périer"], "street_address": ["14 rue des Lilas"]}),
    ("Revenue of 4,120,300 crowns in 2024 beat the 3,998,112 of 2023.", {}),
    ("Her social security number, 219-09-9999, stood in the open.", {"id_number": ["219-09-9999"]}),
    ("The museum opened Hall 3 to 1,200 visitors.", {}),
    ("Laut Jörg Aumüller bleibt die Brücke gesperrt.", {"person_name": ["Jörg Aumüller"]}),
    ("Press office: (212) 555-0147, open on weekdays.", {"phone": ["(212) 555-0147"]}),
]


def test_pii_of_another_source():
    """Precision and recall over hand-written sentences, half of their names not in the list of given names."""
    common = ["panel", "report", "season", "morning", "asked", "director", "late", "void", "open", "told"]
    model = pii.train(pii.training_texts(GIVEN, common, 4000, seed=1), pii.Model(GIVEN, common))
    found = wanted = both = 0
    for text, details in OTHER_SOURCE:
        got = {(kind, text[s:e]) for s, e, kind in pii.best_segments(pii.candidates(text, model), model)}
        want = {(kind, x) for kind, xs in details.items() for x in xs}
        found, wanted, both = found + len(got), wanted + len(want), both + len(got & want)
    assert both >= 0.9 * wanted and both >= 0.9 * found


def test_too_many_given_names_are_an_error(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="given names"):
        pii.fit(docs, spark.createDataFrame([(f"n{i}",) for i in range(12)], "given_name string"), most_names=10)


def test_tolerant_recall_against_brute_force():
    """Passages of 30 words with one substitution in each 8-word block: how many the seeds reach of those that count."""
    rng = random.Random(3)
    reached = counted = 0
    for i in range(400):
        item = [rng.choice(WORDS) for _ in range(30)]
        doc = list(item)
        for start in range(0, 24, 8):
            doc[start + rng.randrange(8)] = "zz"
        text = [rng.choice(WORDS) for _ in range(rng.randrange(20))] + doc + [rng.choice(WORDS) for _ in range(9)]
        shift = next(k for k in range(len(text)) if text[k : k + 30] == doc)
        # brute force: the comparison along the diagonal from every equal word
        best = max(leakage.overlap(text, item, shift + k, k)[1] for k in range(30) if doc[k] == item[k])
        places = {}
        for h, q in leakage.seeds(item, 1):
            places.setdefault(h, []).append(q)
        hits = sorted({(p, 0, q) for h, p in leakage.seeds(text, 8) for q in places.get(h, ())})
        found = max((t for _, t in leakage._judge(text, hits, {0: item}).values()), default=0)
        if best >= 15:
            counted += 1
            reached += found >= 15
    assert counted >= 300 and reached >= 0.8 * counted, (reached, counted)


def test_short_items_leak_whole(spark):
    docs = spark.createDataFrame([(1, "He said: ÉTÉ comme hiver, again"), (2, "ete comme"), (3, None), (4, ""), (5, "x " * 50_000 + "ete comme hiver")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Été, comme hiver!"), (2, ""), (3, None), (4, "again"), (5, "w " * 20)], "item_id long, item_text string")
    assert rows(leakage.short_leaks(docs, items)) == [(1, 1), (1, 4), (5, 1)]
    assert leakage.short_leaks(docs, items.limit(0)).count() == 0 and leakage.short_leaks(docs.limit(0), items).count() == 0


def test_common_words_are_counted_over_all_documents(spark):
    # 20 in 6,000: the share that makes a word common, whatever part of the documents holds it; long texts count too
    texts = ["every page" + (" harbour" if i < 20 else "") + (" rarely" if i < 19 else "") + (" lengthy" * 2600 if i >= 5980 else "") for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.common_words(docs) == ["every", "harbour", "lengthy", "page"]
    assert pii.common_words(docs.limit(0)) == []
