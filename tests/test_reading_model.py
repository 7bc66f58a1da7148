import itertools
import math
import random
from collections import Counter

import pytest

from glyphmill.operators import reading_model as M
from glyphmill.operators import signs as G

CODE = {c: chr(0x13000 + i) for i, c in enumerate("ABCDEPQXUV")}


def frame(spark, rows):
    g = lambda s: " ".join("".join(CODE[c] for c in w) for w in s.split())
    return spark.createDataFrame([(i, g(s), r) for i, (s, r) in enumerate(rows)], "id long, hieroglyphs_norm string, transliteration_gold string")


def read(spark, rows, query, **options):
    model = M.fit(frame(spark, rows))
    out = M.decode(model, frame(spark, [(query, "")]), "id", "hieroglyphs_norm", **options).orderBy("pos").collect()
    return [r.predicted for r in out], out


CASES = [
    ([("Q A", "q x")] * 3 + [("P A", "p y")] * 2, "P A", {}, ["p", "y"]),
    ([("A D", "x d")] * 3 + [("A E", "y e")] * 2, "A E", {"right": 0.0}, ["y", "e"]),
    ([("A D", "x c")] * 3 + [("A E", "y c")] * 2, "A E", {}, ["y", "c"]),
    ([("A D", "x c")] * 3 + [("A E", "y c")] * 2, "A E", {"right": 0.0}, ["x", "c"]),
]


@pytest.mark.parametrize(("rows", "query", "options", "want"), CASES)
def test_context(spark, rows, query, options, want):
    assert read(spark, rows, query, **options)[0] == want


def test_misaligned_and_unseen(spark):
    assert M.fit(frame(spark, [("A B C", "x y")])).emission.count() == 0
    assert read(spark, [("A", "x")], "B")[0] == [""]
    assert read(spark, [("A", "x"), ("", "")], "")[0] == []


def test_fallback(spark):
    words, rows = read(spark, [("AB C", "known c")] * 2, "ABX")
    assert words == ["known"] and not rows[0].was_seen and rows[0].fallback_similarity == 0.667
    assert read(spark, [("AB C", "known c")] * 2, "ABX", threshold=0.7)[0] == [""]
    assert read(spark, [("AB C", "known c")] * 2, "ABX", use_fallback=False)[0] == [""]


def test_shares(spark):
    _, rows = read(spark, [("A", "x")] * 3 + [("A", "y")], "A")
    assert [(c.reading, c.share) for c in rows[0].candidates] == [("x", 0.75), ("y", 0.25)] and rows[0].attested_count == 4


def test_decode_equals_all_paths(spark):
    """The best path among all, by terms computed from plain counters."""
    rng = random.Random(3)
    rows = [(" ".join(s), " ".join(rng.choice("xyz") for _ in s)) for s in (rng.choices("ABCD", k=rng.randrange(1, 5)) for _ in range(40))]
    tables = [Counter() for _ in range(4)]
    for s, r in rows:
        s, r = [CODE[c] for c in s.split()], r.split()
        for i in range(len(s)):
            p, n = (s[i - 1], r[i - 1]) if i else ("<s>", "<s>"), s[i + 1] if i + 1 < len(s) else "<s>"
            for t, k in zip(tables, [(s[i],), (p[1],), (p[0], s[i]), (s[i], n)]):
                t[(k, r[i])] += 1

    def term(t, key, reading):
        own = {r: n for (k, r), n in t.items() if k == key}
        return math.log(0.1) if not own else math.log((own.get(reading, 0) + 0.1) / (sum(own.values()) + 0.1 * len(own)))

    queries = ["A B C D", "D D A", "B"]
    model = M.fit(frame(spark, rows))
    got = {}
    for r in M.decode(model, frame(spark, [(q, "") for q in queries]), "id", "hieroglyphs_norm").collect():
        got.setdefault(r.id, {})[r.pos] = r.predicted
    for i, q in enumerate(queries):
        s = [CODE[c] for c in q.split()]
        options = [sorted({r for (k, r) in tables[0] if k == (x,)}) for x in s]

        def score(path):
            total = 0.0
            for j, r in enumerate(path):
                prev_s, prev_r = (s[j - 1], path[j - 1]) if j else ("<s>", "<s>")
                nxt = s[j + 1] if j + 1 < len(s) else "<s>"
                total += 0.6 * term(tables[0], (s[j],), r) + term(tables[1], (prev_r,), r) + 0.8 * term(tables[2], (prev_s, s[j]), r) + 0.8 * term(tables[3], (s[j], nxt), r)
            return total

        best = max(score(p) for p in itertools.product(*options))
        assert score([got[i][k] for k in sorted(got[i])]) == pytest.approx(best, abs=1e-9)


def random_model(spark, n=40):
    rng = random.Random(5)
    rows = [(" ".join(s), " ".join(rng.choice("xyz") for _ in s)) for s in (rng.choices(["A", "B", "C", "D", "AB", "CE"], k=rng.randrange(1, 6)) for _ in range(n))]
    return M.fit(frame(spark, rows)), frame(spark, [(q, "") for q in ["A B C D", "D AB A", "ABE B", "Q A V", "CE ABD"]])


@pytest.mark.parametrize("options", [{}, {"transition": 0.3, "right": 0.0}, {"use_fallback": False}])
def test_decode_by_arrays_equals_joins(spark, options):
    """A model that a task can't hold is decoded by joins; both ways tell the same."""
    model, queries = random_model(spark)
    by = [sorted(map(str, M.decode(model, queries, "id", "hieroglyphs_norm", held=held, **options).collect())) for held in (10_000, 0)]
    assert by[0] == by[1] and len(by[0]) == 14


def test_decode_shuffles_no_pairs_of_candidates(spark):
    """Pairs of neighbouring candidates and of groups that share a glyph filled the disk when they were shuffled."""
    model, queries = random_model(spark)
    names = "id", "hieroglyphs_norm"
    plan = M.decode(model, queries, *names)._jdf.queryExecution().toString()
    assert "lattice" not in plan and "moves" not in plan
    assert "common" not in M.nearest_groups(model, queries.selectExpr("explode(split(hieroglyphs_norm, ' ')) AS sign"))._jdf.queryExecution().toString()


def test_steps_count_apart_from_candidates(spark, monkeypatch):
    """Candidates and steps counted together sent a 1 GB model to the joins, which filled the disk; parts keep all steps."""
    model, queries = random_model(spark)
    names = "id", "hieroglyphs_norm"
    held = 26  # candidates of the signs to decode; there are 12 counts of steps besides
    want = sorted(map(str, M.decode(model, queries, *names).collect()))
    monkeypatch.setattr(M, "STEPS_AT_ONCE", 3)
    out = M.decode(model, queries, *names, held=held)
    assert "lattice" not in out._jdf.queryExecution().toString() and sorted(map(str, out.collect())) == want


def test_decode_all_equals_decode(spark):
    """An evaluation decodes once for both of its weights."""
    model, queries = random_model(spark)
    names = "id", "hieroglyphs_norm"
    both = M.decode_all(model, queries, *names, {"predicted": {}, "left_only": {"right": 0.0}}).collect()
    for column, options in (("predicted", {}), ("left_only", {"right": 0.0})):
        assert {(r.id, r.pos): r[column] for r in both} == {(r.id, r.pos): r.predicted for r in M.decode(model, queries, *names, **options).collect()}


def test_nearest_groups_in_blocks(spark):
    model, _ = random_model(spark)
    unseen = spark.createDataFrame([("".join(CODE[c] for c in s),) for s in ["ABE", "CED", "PQ", "DA"]], "sign string")
    total = {r.sign: r.total for r in model.groups().collect()}
    want = {}
    for (s,) in unseen.collect():
        near = [(-len({*s} & {*g}) / len({*s} | {*g}), -n, g) for g, n in total.items() if {*s} & {*g}]
        if near:
            want[s] = (min(near)[2], -min(near)[0])
    for block in (2, 1000):
        assert {r.sign: (r.group, r.similarity) for r in M.nearest_groups(model, unseen, block).collect()} == want


def test_sign_index(spark):
    rows = [("A", "sw"), ("A", "nswt"), ("B", "n.t"), ("B", "n(.ꞽ).t"), ("C", "z")]
    index = G.sign_index(G.attestations(G.aligned(frame(spark, rows))))
    summary = G.multivalence(index).first()
    assert (summary.sign_groups, summary.literal_multi, summary.genuinely_multivalent, summary.editorial_only) == (3, 2, 1, 1)
    assert [r.sign for r in G.ranked_multivalent(index).collect()] == [CODE["A"]]


def test_evaluate(spark):
    rows = [("A B", "x y")] * 6 + [("A C", "z c")] * 6 + [("B", "y")] * 8
    r = M.evaluate(frame(spark, rows)).first()
    assert r.corpus_sentences == 20 and r.train_sentences + r.held_out_sentences == 20 and 0 <= r.acc_all_context <= 1


def test_size_sweep_runs_one_size_after_another(spark):
    """All sizes in one plan filled the driver's memory."""
    rows = frame(spark, [("A B", "x y")] * 6 + [("A C", "z c")] * 6 + [("B", "y")] * 8)
    out = M.size_sweep(rows, [8, None])
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert out.collect() == [M.evaluate(rows.orderBy("id").limit(8)).first(), M.evaluate(rows).first()]


def test_summaries_shuffle_no_pairs_of_candidates(spark):
    """A summary and an evaluation decode as `decode` does; pairs in the shuffle filled the disk at 1 GB."""
    model, queries = random_model(spark)
    for out in (M.decode_summary(M.decode(model, queries, "id", "hieroglyphs_norm"), "id"), M.evaluate(frame(spark, [("A B", "x y")] * 6 + [("A", "z")] * 6))):
        plan = out._jdf.queryExecution().toString()
        assert "lattice" not in plan and "moves" not in plan


def test_review_sheet_shuffles_no_pairs_of_candidates(spark):
    from glyphmill.plans.queries import QUERIES

    plan = QUERIES["expert_review_sheet"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lattice" not in plan and "moves" not in plan
