import math
import random
from collections import Counter

import pytest

from glyphmill.llm import copies, distinctive, forms, leaks, overlap, packing, spam, splits, termcount


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spoiled(rng, text, share, alphabet):
    t = list(text)
    for _ in range(int(len(t) * share)):
        k = rng.randrange(len(t))
        rng.choice([lambda: t.__setitem__(k, rng.choice(alphabet)), lambda: t.insert(k, rng.choice(alphabet)), lambda: len(t) > 1 and t.pop(k)])()
    return "".join(t)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(11)
    words, signs = ["".join(rng.choices("ꜣꞽꜥwbpfmnrhḥ", k=rng.randrange(2, 7))) for _ in range(60)], [chr(0x13000 + k) for k in range(40)]
    rows = []
    for i in range(220):
        text, glyphs = " ".join(rng.choices(words, k=rng.randrange(6, 22))), "".join(rng.choices(signs, k=rng.randrange(15, 60)))
        if i % 2 and rows:
            old = rng.choice(rows)
            text, glyphs = spoiled(rng, old[3], rng.random() * 0.2, "ꜣꞽwb "), spoiled(rng, old[2], rng.random() * 0.2, signs)
        rows.append((i, ["train", "train", "validation", "test", None][rng.randrange(5)], glyphs, text, "s", "clash"))
    rows += [(900, "train", None, None, None, "x"), (901, "test", "", "", None, "x"), (902, "test", rows[0][2], rows[0][3], "s", "x"), (903, "train", rows[0][2], rows[0][3], "s", "x"), (904, "train", rows[0][2], rows[0][3], "s", "x")]
    examples = spark.createDataFrame(rows, "id long, split string, hieroglyphs string, transliteration_gold string, source string, text string")
    bench = [(f"C{i}", spoiled(rng, rng.choice(rows[:220])[3], 0.1, "ꜣꞽ ")) for i in range(20)] + [("C99", None)]
    competitive = spark.createDataFrame(bench, "benchmark_id string, expected_transliteration string")
    want = set()
    for set_, key, reading, glyphs in [(r[1], str(r[0]), r[3], r[2]) for r in rows if r[1] in ("validation", "test")] + [("competitive", b, t, None) for b, t in bench]:
        for i, split, g, t, *_ in rows:
            if split != "train":
                continue
            for a, b, least in ((forms.comparison(reading), forms.comparison(t), 30), (forms.sign_string(glyphs), forms.sign_string(g), 20)):
                if min(len(a), len(b)) >= least and edits(a, b) * 100 <= 15 * max(len(a), len(b)):
                    want.add((set_, key, i))
    found = overlap.overlaps(examples, competitive)
    assert {(r.eval_set, r.eval_key, r.train_id) for r in found.collect()} == want and len(want) > 60
    assert sum(r.pairs for r in overlap.overlap_report(found).collect()) == found.count()
    assert overlap.overlaps(examples.limit(0), competitive.limit(0)).count() == 0


def test_overlaps_of_refrains(spark):
    rng = random.Random(3)
    signs = [chr(0x13000 + k) for k in range(12)]
    rows = [(0, "train", "".join(signs[:6]) * 4, "htpdnswprm" * 4), (1, "test", "".join(signs[:2] + [signs[9]] + signs[3:5] + [signs[9]]) + "".join(signs[:6]) * 3, "htpdXswprX" + "htpdnswprm" * 3)]
    for i in range(2, 90):  # refrains of all periods, spoiled anywhere
        text, glyphs = "".join(rng.choices("htpdnswrm", k=rng.randrange(2, 14))), "".join(rng.choices(signs, k=rng.randrange(2, 9)))
        old = rng.choice(rows)
        text, glyphs = (spoiled(rng, old[3], rng.random() * 0.18, "htpXY"), spoiled(rng, old[2], rng.random() * 0.18, signs)) if i % 3 else (text * (45 // len(text)), glyphs * (30 // len(glyphs)))
        rows.append((i, rng.choice(["train", "test"]), glyphs, text))
    examples = spark.createDataFrame([(*r, "s") for r in rows], "id long, split string, hieroglyphs string, transliteration_gold string, source string")
    want = set()
    for kind, col, form in (("reading", 3, forms.comparison), ("signs", 2, forms.sign_string)):
        texts = [(r[0], r[1], t) for r in rows if len(t := form(r[col])) >= overlap.LEAST_LENGTH[kind]]
        want |= {(str(i), j, kind) for i, a, x in texts if a == "test" for j, b, y in texts if b == "train" if edits(x, y) <= max(len(x), len(y)) * 15 // 100}
    found = overlap.overlaps(examples, spark.createDataFrame([], "benchmark_id string, expected_transliteration string"))
    assert {("1", 0, "reading"), ("1", 0, "signs")} <= want and {(r.eval_key, r.train_id, r.kind) for r in found.collect()} == want


def test_overlap_bounds():
    import numpy as np

    for kind, q in overlap.GRAMS.items():
        lengths = np.arange(overlap.LEAST_LENGTH[kind], 1500)
        for n, c in zip(lengths, overlap.least(lengths, q), strict=True):
            assert 1 <= c == min(m - q + 1 - q * (m * 15 // 100) for m in range(n, n * 100 // 85 + 1))


def test_related_texts(spark):
    rng = random.Random(4)
    rows = [(i, f" nil-t {rng.randrange(60)}", f"s_{rng.randrange(70)}") for i in range(90)] + [(100, None, "s_1"), (101, "no_text_id", "s_2"), (102, "lone", None), (103, "", ""), (104, "NIL_T_1", "S-1"), (105, "nil_t_2", "s_77"), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, source_text_id string, source_sentence_id string")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    norm = lambda v: None if v is None else ("_".join(v.strip().upper().replace("-", " ").replace("_", " ").split()) or None)
    clean = [(i, None if norm(t) == "NO_TEXT_ID" else norm(t), norm(s)) for i, t, s in rows]
    for _, t, s in clean:
        if t and s:
            root[find(("t", t))] = find(("s", s))
    texts = sorted({t for _, t, _ in clean if t})
    want = {(a, b) for a in texts for b in texts if a < b and find(("t", a)) == find(("t", b))}
    for block in (1000, 7):
        assert sorted((r.text_a, r.text_b) for r in splits.related_texts(df, block).collect()) == sorted(want) and want
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = splits.assign_splits(df, plan, whole=4).collect()
    assert len(got) == len(rows) and len({r.component for r in got}) == len({(r.component, r.split) for r in got})
    by_id = {r.id: r for r in got}
    for i, t, s in clean:
        for j, u, v in clean:
            linked = (t and u and find(("t", t)) == find(("t", u))) or (s and s == v) or (t and v and find(("t", t)) == find(("s", v)))
            if linked and i is not None and j is not None:
                assert by_id[i].split == by_id[j].split
    assert splits.related_texts(df.limit(0)).count() == 0 and splits.assign_splits(df.limit(0), plan).count() == 0
    assert {r.split for r in splits.assign_splits(df, plan.limit(0)).collect()} == {None}


def test_shares(spark):
    df = spark.range(6000).selectExpr("id", "concat('t', id div 3) AS source_text_id", "concat('s', id) AS source_sentence_id")
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = {r.split: r["count"] / 6000 for r in splits.assign_splits(df, plan).groupBy("split").count().collect()}
    assert got["train"] == pytest.approx(0.8, abs=0.01) and got["test"] == pytest.approx(0.1, abs=0.01)


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(termcount, "BLOCK", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randrange(9)))) for i in range(60)] + [(60, None), (61, ""), (62, "A Ａ a")]
    df = spark.createDataFrame(rows, "term long, t string").repartition(5)
    occ, rec = Counter(), Counter()
    for _, t in rows:
        w = forms.reading_terms(t)
        occ.update(w)
        rec.update(set(w))
    got = termcount.term_counts(df, {"t": forms.reading_terms}, 30, 0.6).collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == {w: (occ[w], rec[w]) for w in occ} and len({r.term_id for r in got}) == len(got)
    assert {r.term: r.mark for r in got} == {w: "rare" if rec[w] < 30 else "common" if rec[w] > 0.6 * 63 else None for w in occ}
    assert termcount.term_counts(df.limit(0), {"t": forms.reading_terms}).count() == 0


@pytest.mark.parametrize("bits", [1 << 26, 1 << 19])
def test_copies(spark, bits):
    rng = random.Random(9)
    texts = [rng.choice(["ꞽw ḥr", "I̓W  ḤR.", "sḏm=f", "SḎM F", "nn", " ", None, "x" * 50_000]) for _ in range(80)] + [f"lone {i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, form string").repartition(6)
    groups = {}
    for i, t in enumerate(texts):
        if f := forms.comparison(t):
            groups.setdefault(f, []).append(i)
    rows = copies.canonical_rows(df, "t", "id", "form", "text")
    assert {(r.keep_id, r.copy_id) for r in copies.copy_pairs(rows, bits).collect()} == {(v[0], i) for v in groups.values() for i in v[1:]}
    assert {(r.keep_id, r.copies) for r in copies.collapse(rows, bits).collect()} == {(v[0], len(v)) for v in groups.values()}
    assert copies.copy_pairs(rows.limit(0)).count() == 0


def test_dfr(spark):
    rows = [(1, "a a a b", "1|x 2|y"), (2, "a c", "1|x"), (3, None, None), (4, "", ""), (5, "b b", "3|z;3|z")]
    df = spark.createDataFrame(rows, "id long, transliteration_gold string, lemma_sequence string")
    got = {(r.field, r.id, r.term): r for r in distinctive.dfr_scores(df, "id").collect()}
    assert got[("lemma_sequence", 5, "3")].tf == 2 and len(got) == 9
    assert {k: r.score for k, r in got.items()} == pytest.approx({(r.field, r.id, r.term): r.score for r in distinctive.dfr_scores(df, "id", hot_share=0.0).collect()})
    tfn, mean = 3 * math.log2(1 + (8 / 5) / 4), 4 / 5
    assert got[("transliteration_gold", 1, "a")].score == pytest.approx((math.log2(1 + mean) + tfn * math.log2((1 + mean) / mean)) / (tfn + 1))
    assert distinctive.dfr_scores(df.limit(0), "id").count() == 0


def test_packing(spark):
    rng = random.Random(10)
    counts = [(i, rng.choice([0, None, 1, 40, 99, 100, 101, 250, rng.randrange(1, 130)])) for i in range(3000)]
    df = spark.createDataFrame(counts, "id long, n_tokens long")
    got = packing.pack_texts(df, [("s", 100), ("none", 0)], open_packs=16, texts_a_shard=1000).collect()
    packs, pieces = Counter(), {}
    for r in got:
        if r.pack_name == "s":
            pieces.setdefault(r.id, []).append(r)
            if r.pack_id is not None:
                packs[r.pack_id] += r.n_tokens
        else:
            assert r.pack_id is None
    assert max(packs.values()) <= 100 and sum(packs.values()) == sum(n or 0 for _, n in counts) and sum(packs.values()) / (100 * len(packs)) > 0.9
    for i, n in counts:
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == (n or 0) and len(own) == max(1, -(-(n or 0) // 100)) and all(a.start_token + a.n_tokens == b.start_token for a, b in zip(own, own[1:]))
    assert packing.pack_texts(df.limit(0), [("s", 100)]).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "The stela from Per-Nera"), (2, None), (3, ""), (4, "ꜣ𓀀 " * 60_000)], "doc_id long, text string")
    got = {r.id: r.n_tokens for r in packing.token_counts(docs, "doc_id", "text").collect()}
    assert got[2] == got[3] == 0 and got[1] == len(packing.encoder(packing.TOKENIZER).encode_ordinary("The stela from Per-Nera")) and got[4] > 60_000
    sizes = spark.createDataFrame([("short", 512)], "pack_name string, capacity int")
    assert packing.pack_fill(packing.pack_documents(docs, sizes), sizes).first().fill > 0.95


def test_leaks(spark):
    item = "When Numosere had passed Kom Tyti he laid before the scribe of the fields 319 jars of oil. Then he left."
    items = spark.createDataFrame([(1, "en", item), (2, "en", "too short to be found"), (3, "en", None)], "item_id long, lang string, text string")
    part = "before\nthe <b>scribe</b> of the  fields&nbsp;319 jars, of OIL: then he l­eft. More"
    other = item.replace("Numosere", "Seseru").replace("319", "17")
    docs = spark.createDataFrame([(10, "x " + item), (11, part), (12, " ".join(item.split()[:12])), (13, other), (14, None), (15, ""), (10, item), (16, "laid " + item[:40] + " zzz " + item[40:70])], "doc_id long, text string")
    want = {(1, 10), (1, 11)}
    rows = None
    for block, piece in ((leaks.BLOCK_WORDS, leaks.PIECE), (20, 50_000), (leaks.BLOCK_WORDS, 3), (12, 2)):
        got = leaks.leaked_items(docs, items, block, piece)
        got = sorted(tuple(r) for r in got.collect())
        assert {(r[0], r[1]) for r in got if r[2]} == want
        rows = rows or got
        assert got == rows
    slots = {r[1]: r for r in rows}
    assert slots[13][2] == 0 and slots[13][3] > 0
    assert leaks.leaked_items(docs.limit(0), items).count() == 0 and leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_leaks_with_other_names(spark):
    item = "Möge Retiankh in der zweiten Kolumne stehen, solange man in Hut-Semose noch einen Festkalender unter den Leuten bewahrt."
    items = spark.createDataFrame([(1, "de", item), (2, "de", "Da fand man den Krug und die Stele am Rand, denn Semose war tot."), (3, None, item.upper())], "item_id long, lang string, text string")
    assert {r.word for r in leaks.item_names(items.where("item_id < 3")).collect()} == {"retiankh", "hut", "semose"}
    swapped = lambda a, b: item.replace("Retiankh", a).replace("Semose", b)
    docs = [(1, swapped("Badjaka", "Fera")), (2, swapped("Stele", "Fera")), (3, swapped("Badjaka", "Fera").replace("Festkalender", "Krug").replace("Kolumne", "Stele")), (4, item.lower()), (5, item.upper()), (6, swapped("badjaka", "fera")), (7, item.replace("Semose", "Retiankh"))]
    got = {(r.item_id, r.doc_id): r for r in leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {d for (i, d), r in got.items() if i == 1 and r.exact_windows and not r.slot_windows} == {4, 5}
    assert {d for (i, d), r in got.items() if i == 1 and r.slot_windows and not r.exact_windows} == {1, 2, 7}


def test_spam(spark):
    prose = "The overseer of the harbour says that this stela was found near the base of a wall, and it is unclear whether the scribe meant the cult of the ancestors. "
    heap = "eye amulet gold ring offer mummy toy cheap scarab " * 12
    links = "\n".join(f"[Best Price](http://shop{k}.example/p)" for k in range(12))
    gloss = "\n".join(f"𓀀\tḥr{k}\tword{k}" for k in range(30))
    offerings = ", ".join(f"{k} ꜣpdn, {k} bꞽty" for k in range(40))
    docs = [(1, prose * 3, "en"), (2, heap, "en"), (3, links, None), (4, gloss, "en"), (5, offerings, "de"), (6, prose + heap, "en"), (7, prose * 6 + heap[:150], "en"), (8, None, None), (9, "", "en"), (10, prose * 2 + " see https://a.example/b", "xx"), (11, " ".join(f"#amulet_{k % 5}" for k in range(40)), "en")]
    docs += [(100 + k, prose, "en") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {r.doc_id for r in spam.page_scores(df).where("is_spam").collect()} == {2, 3, 6, 11}
    assert spam.page_scores(df).count() == len(docs) and spam.page_scores(df.limit(0)).count() == 0
