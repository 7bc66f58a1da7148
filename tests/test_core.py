import datetime as dt
import math
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import benchmarks, evaluate, explore, review, suggest
from glyphmill.sources import corpus as C


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (X.norm_text, " A  b\tC ", "a b c"), (X.norm_mdc, "A*b::c  (d)_e-f", "a:b:c d_e-f"), (X.norm_translit, "Ꜣḥ ḫẖ šṯḏ ꜥ", "ah khkh shtjdj a"), (X.norm_pipe, " A | |b|b", "a|b|b"),
    (X.norm_hieroglyphs, "𓀀x𓀁  -𓀂", "𓀀 𓀁 𓀂"), (X.norm_hieroglyphs, None, ""), (X.parse_bool, " Yes ", True), (X.parse_bool, "0", False), (X.tokens, "A:b-c d_e", ["a", "b", "c", "d_e"]),
    (X.loose_reading, "n(.ꞽ).t", "n t"), (X.canonical_reading, "n(.ꞽ).t", "nt"), (X.lemma_ids, "1|a 2|b 1|c |d", ["1", "2"]), (X.norm_text, "a  b", "a b"), (X.has_signs, "x𓀀", True),
])
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_overlaps(spark):
    df = spark.createDataFrame([(["n", "k", "rare"], ["n", "k", "other"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.token_overlap(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    assert [r[0] for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_periods_and_classes(spark):
    df = spark.createDataFrame([("-1878", "-1843"), (None, "-100"), (None, None), ("500", "600.0"), ("x", "")], "a string, b string")
    got = [r[0] for r in df.select(X.derive_period(X.parse_year("a"), X.parse_year("b"))).collect()]
    assert got == ["Middle Kingdom", "Ptolemaic Period", "", "Undated range (500 to 600)", ""]
    pairs = spark.createDataFrame([("n.t", "n(.ꞽ).t"), ("sw nfr", "sw"), ("sw", "nswt"), ("sw", "")], "g string, p string")
    assert [r[0] for r in pairs.select(X.disagreement("g", "p")).collect()] == ["editorial_only", "ending_or_suffix", "different_lexeme", "different_lexeme"]
    features = spark.createDataFrame([(["htp", "di", "nsw", "inpw", "wsir", "t"],)], "t array<string>").select(*[c.alias(k) for k, c in X.query_features(F.col("t")).items()]).first()
    assert (features.deity, features.formula_type, features.offering_items, features.recipient) == ("inpw", "offering_formula", "bread", "anubis")


def test_csv_round_trip_and_loaders(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "x"', "NaN")], "mdc string, translation string, genre string")
    C.write_csv(df, str(tmp_path / "c"))
    row = C.load_examples(spark, str(tmp_path / "c")).first()
    assert (row.mdc, row.translation, row.genre, row.source, row.mdc_norm) == ("a\nb", 'say "x"', "", "", "a b")
    assert C.load_benchmark(spark, str(tmp_path / "no")).count() == 0
    with pytest.raises(FileNotFoundError):
        C.load_benchmark(spark, str(tmp_path / "no"), missing_ok=False)
    with pytest.raises(ValueError):
        C.load_benchmark(spark, str(tmp_path / "c"))


def test_records_and_import(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.jsonl").write_text('{"sentence": {"id": "s1", "transliteration": "n nfr"}, "tokens": [{"lemma": "1"}, {"lemma": "2"}]}\n{"text_id": "t", "sentence": {"transliteration": ""}}\n')
    (tmp_path / "b.json").write_text('{"items": [{"transliteration": "m pr", "dateNotBefore": "-2000"}]}')
    (tmp_path / "c.tsv").write_text("transcription\tgenre\nḥr rn\thymn\n")
    rows = {r.transliteration_gold: r for r in C.import_records(C.read_records(spark, str(tmp_path)), "IMP", "here").collect()}
    assert set(rows) == {"n nfr", "m pr", "ḥr rn"}
    assert rows["n nfr"].lemma_sequence == "1|2" and rows["n nfr"].source_sentence_id == "s1" and rows["m pr"].period == "Middle Kingdom" and rows["ḥr rn"].mdc == "hr rn"
    assert len({r.source_text_id for r in rows.values()}) == 3 and rows["ḥr rn"].genre == "hymn"


def test_upsert(spark):
    s = "id long, source string, source_text_id string, source_sentence_id string, mdc string"
    old = C.conform(spark.createDataFrame([(5, "a", "t", "1", "x"), (6, "a", "t", "2", "y")], s))
    new = C.conform(spark.createDataFrame([(0, "a", "t", "2", "z"), (0, "a", "t", "3", "w"), (0, "a", "t", "1", "x")], s).drop("id"))
    tally = {(r.kind, r.name): r.n for r in C.upsert_tally(C.upsert_plan(old, new)).collect()}
    assert tally == {("action", "created"): 1, ("action", "updated"): 1, ("action", "unchanged"): 1, ("field", "mdc"): 1}
    assert {(r.id, r.mdc) for r in C.upsert(old, new).collect()} == {(5, "x"), (6, "z"), (7, "w")}
    assert C.insert_absent(old, new).count() == 1
    assert C.annotation_row(1, "x", " YES ")["aesthetic_arrangement_flag"] is True


def test_seed_once(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    assert C.ensure_seeded(spark, str(tmp_path / "t"), df) == 2 == C.ensure_seeded(spark, str(tmp_path / "t"), df)


def test_latest_and_counts(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [(1, 9, "a", "edited", t(1)), (2, 9, "b", "accepted", t(3)), (3, 9, "c", "rejected", t(3)), (4, 8, None, None, None)]
    df = spark.createDataFrame(rows, "id long, example_id long, transliteration string, status string, created_at timestamp")
    assert {(r.example_id, r.id) for r in review.latest(df).collect()} == {(9, 3), (8, 4)}
    assert {r.status: r.n for r in review.status_counts(df).collect()} == {"accepted": 0, "edited": 0, "rejected": 1, "uncertain": 0}
    assert review.latest(df.limit(0)).count() == 0


def test_explore(spark):
    df = spark.createDataFrame([(i, "s", f"g{i % 2}", "50% of", None) for i in range(7)], "id long, source string, genre string, translation string, period string")
    assert {r.facet for r in explore.facet_values(df, ["source", "genre", "period"]).collect()} == {"genre"}
    assert explore.containing(df, "0% O", ["translation"]).count() == 7 and explore.containing(df, "_", ["translation"]).count() == 0
    assert [r.id for r in explore.page(df, 2, 3).collect()] == [3, 4, 5] and explore.page_count(0) == 1


def test_suggestions(spark):
    rows = [(1, 1, 0.8, "n.t", "1|a 2|b", "g"), (1, 2, 0.4, "n(.ꞽ).t", "1|a", "g"), (1, 3, 0.2, "sw", "", "h"), (1, 4, 0.1, "", "", "h")]
    ranked = spark.createDataFrame(rows, "query_id long, rank int, final_score double, transliteration_gold string, lemma_sequence string, genre string").withColumns({c: F.lit("") for c in ("source", "source_text_id", "source_sentence_id", "formula_type", "formula_slot", "normalized_reading_order", "normalized_reading_order_norm")})
    queries = spark.createDataFrame([(1, "nt", "")], "query_id long, query_mdc string, query_reading_order string")
    got = suggest.suggest(ranked, queries).orderBy("place").collect()
    assert [(r.candidate_transliteration, r.supporting_example_count) for r in got] == [("n.t", 2), ("sw", 1)]
    want = 0.24 + 0.12 * 0.6 + 0.20 + 0.16 * suggest_cosine("nt", "nt") + 0.12 + 0.05 * 0.4 + 0.03 * 0.4
    assert got[0].raw_confidence == pytest.approx(min(want, 0.99), abs=1e-9)
    assert got[0].evidence_summary == "same normalized query reading; shared lemma IDs: 1, a; shared context: genre; supported by 2 similar corpus rows"
    assert got[0].supporting_sources[0] == "unknown/no_text_id/no_sentence_id"


def suggest_cosine(a, b):
    from glyphmill.operators.retrieval import char_grams

    x, y = char_grams(a), char_grams(b)
    return sum(n * y[g] for g, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def test_rivals_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    sets = {i: sorted(set(rng.choices("abcdefghijkl", k=rng.randrange(0, 6)))) for i in range(40)}
    df = spark.createDataFrame(list(sets.items()), "id long, t array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.16}
    assert {(r.a, r.b) for r in benchmarks.rival_pairs(df, "t").collect()} == want


def test_rival_counts_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    sets = {i: sorted(set(rng.choices("abcdefghijkl", k=rng.randrange(0, 9)))) for i in range(70)}
    df = spark.createDataFrame(list(sets.items()), "id long, t array<string>")
    want = {}
    for a in sets:
        over = [x for b in sets if a != b and sets[a] and sets[b] and (x := len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})) >= 0.16]
        if over:
            want[a] = (len(over), max(over))
    for block in (16, 1000):
        assert {r.id: (r.rivals, r.best) for r in benchmarks.rival_counts(df, "t", block=block).collect()} == want
    assert benchmarks.rival_counts(df.limit(0), "t").count() == 0


def test_top_rivals_equal_all_counts(spark, monkeypatch):
    """Counting the most promising rows alone finds what counting all rows finds, with known and unknown frequencies."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, sorted({words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randrange(1, 14))}), f"g{rng.randrange(40)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t array<string>, g string")
    group = {i: g for i, _, g in rows}
    best: dict = {}
    for r in benchmarks.rival_counts(df.where("size(t) >= 2"), "t").where("best < 0.9").collect():
        best[group[r.id]] = max(best.get(group[r.id], (0, 0.0, 0)), (r.rivals, r.best, r.id))
    want = sorted(best.values(), reverse=True)
    for first, share, limit in ((8, 0.002, 5), (300, 0.05, 5), (16, 0.05, 1000)):
        monkeypatch.setattr(benchmarks, "KNOWN_SHARE", share)
        got = benchmarks.top_rivals(df, "t", F.col("g"), limit, 0.9, first=first).collect()
        assert sorted(((r.rivals, r.best, r.id) for r in got), reverse=True) == want[:limit]
    assert benchmarks.top_rivals(df.limit(0), "t", F.col("g"), 5, 0.9).count() == 0


def test_competitive_queries_count_no_hopeless_rows(spark):
    """Counting every row against every other failed by time; rows that can't come into the result aren't counted."""
    bound = benchmarks._RivalBound(np.array([1, 2]), np.array([1, 2, 3]), np.array([50, 40, 2]), 1.0)
    bound.learn(np.array([3, 1, 0]), np.array([2, 2, 3]), np.array([40, 10, 50]), 0.5)
    batch = pa.record_batch([pa.array([[1, 2], [1, 7], [3, 8, 9]], pa.list_(pa.int64()))], names=["t"])
    assert bound.of(*bound.pattern(batch)).tolist() == pytest.approx([40.01, 1.01, 2.01], abs=1e-9)


def test_competitive_benchmark_reads_every_row(spark, tmp_path):
    from glyphmill.plans.queries import QUERIES
    from glyphmill.sources.corpus import BASE_COLUMNS

    rows = [(i, f"T{i}", f"S{i}", f"lone{i} word{i}") for i in range(2000)] + [(2000 + i, f"T{i}", f"U{i}", f"nfr hr pr{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, source_text_id string, source_sentence_id string, transliteration_gold string")
    df.withColumns({c: F.lit("") for c in BASE_COLUMNS if c not in df.columns}).write.parquet(f"{tmp_path}/examples.parquet")
    got = QUERIES["competitive_benchmark"](spark, str(tmp_path)).collect()
    assert {(r.expected_source_sentence_id, r.rivals, r.best) for r in got} == {(f"U{i}", 4, 0.5) for i in range(5)}


def test_review_sheet(spark):
    rows = [("A", "sw", "nswt", 10, "sw:0.50 | nswt:0.40", "s1"), ("A", "sw", "nswt", 12, "sw:0.50 | nswt:0.40", "s2"), ("B", "n.t", "n(.ꞽ).t", 50, "n.t:0.5 | n(.ꞽ).t:0.5", "s3"), ("C", "x", "y", 4, "x:0.25 | y:0.75", "s4")]
    df = spark.createDataFrame(rows, "sign string, gold_reading string, context_prediction string, attested_count int, candidates string, sentence string")
    assert [(r["case"], r.sign, r.sentence_context) for r in benchmarks.review_sheet(df).collect()] == [("C01", "A", "s2")]


def test_metrics(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (None,)], "rank int")
    r = evaluate.hit_metrics(df).first()
    assert (r.queries, r.top1, r.topk, r.failures) == (4, 0.25, 0.5, 2) and r.mrr == pytest.approx((1 + 0.5 + 0.2) / 4)


def competitive_case(spark):
    from glyphmill.sources.corpus import conform, derive

    rows = [(1, "T1", "S1", "nfr hr", "b a", "1|x"), (2, "T2", "S2", "nfr hr pr", "x y", "2|y"), (3, "T3", "S3", "pr hr sw", "nfr hr", "3|z 4|w"), (4, "T4", "S4", "dj nswt", "", "5|v")]
    corpus = derive(conform(spark.createDataFrame([(i, t, s, x, x, o, m) for i, t, s, x, o, m in rows], "id long, source_text_id string, source_sentence_id string, mdc string, transliteration_gold string, normalized_reading_order string, lemma_sequence string"))).persist()
    bench = [(f"B{k}", "nfr hr", kind, "nfr hr", "T1", "S1", "nfr hr", "1", "0.26") for k, kind in enumerate(("normalized_reading_order", "simplified_transliteration"))]
    return corpus, spark.createDataFrame(bench, "benchmark_id string, query_input string, query_type string, expected_transliteration string, expected_source_text_id string, expected_source_sentence_id string, expected_key_tokens string, expected_lemma_ids string, acceptable_token_overlap_threshold string")


def test_reading_order_queries_search_by_their_order(spark):
    from glyphmill.operators.retrieval import retrieve

    corpus, bench = competitive_case(spark)
    queries = evaluate.competitive_queries(bench)
    assert {r.query_id: r.query_reading_order for r in queries.collect()} == {"B0": "nfr hr", "B1": ""}
    assert {(r.query_id, r.id): r.reading_order_overlap for r in retrieve(corpus, queries, 4).collect() if r.id == 3} == {("B0", 3): 1.0, ("B1", 3): 0.0}
    blank = bench.withColumn("acceptable_token_overlap_threshold", F.when(F.col("benchmark_id") == "B0", "").otherwise("0.26"))
    assert {r.benchmark_id: r.useful_family_rank for r in evaluate.evaluate_competitive(corpus, blank).collect()} == {"B0": None, "B1": 1}
    shown = evaluate.suggestions_for(corpus, queries, 4).collect()
    assert {r.query_id for r in shown if "same normalized reading order" in r.evidence_summary} == {"B0"}


def test_failures_are_held_against_every_row(spark):
    corpus, bench = competitive_case(spark)
    bench = bench.withColumns({"query_input": F.lit("dj nswt pr"), "query_type": F.lit("x"), "expected_key_tokens": F.when(F.col("benchmark_id") == "B0", "nfr hr").otherwise("zz yy"), "expected_lemma_ids": F.lit("77")})
    got = {r.benchmark_id: r for r in evaluate.failure_analysis(corpus, bench).collect()}
    rows = [r.id for r in evaluate.retrieve(corpus, evaluate.competitive_queries(bench), 9).where("query_id = 'B0'").orderBy("rank").collect()]
    assert (got["B0"].useful_parallel_count, got["B0"].first_useful_retrieval_rank, got["B0"].best_available_token_overlap) == (1, rows.index(2) + 1, 2 / 3)  # own row 1 is left out
    assert (got["B1"].useful_parallel_count, got["B1"].first_useful_retrieval_rank, got["B1"].failure_category) == (0, None, "corpus_gap")


def test_stream(spark, tmp_path):
    from glyphmill.streaming.annotations import annotation_stream, keep_latest, window_counts

    rows = [(1, 9, "a", "edited", dt.datetime(2025, 1, 1)), (2, 9, "a", "edited", dt.datetime(2025, 1, 1, 1)), (3, 9, "b", "accepted", dt.datetime(2025, 1, 2))]
    spark.createDataFrame(rows, "id long, example_id long, transliteration string, status string, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    keep_latest(annotation_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert [(r.example_id, r.id) for r in spark.read.parquet(str(tmp_path / "t/v=0")).collect()] == [(9, 3)]
    assert window_counts(annotation_stream(spark, str(tmp_path / "in"))).isStreaming


def test_core_stands_alone():
    code = "import sys; sys.modules['glyphmill.llm'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), 'p1_found' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 30 and out[1:] == ["True", "False"]


def test_suggestion_evaluations(spark):
    corpus, bench = competitive_case(spark)
    rows = corpus.where("id in (1, 2)")
    left_out, kept = ({r.id: r for r in evaluate.evaluate_suggestions(corpus, rows, include_self=s).collect()} for s in (False, True))
    assert left_out[1].rank_of_gold is None and not left_out[1].top3_hit and kept[1].rank_of_gold == 1 and kept[1].top1_hit
    assert "nfr hr" not in left_out[1].suggestion_canonicals.split(" || ") and kept[1].suggestion_canonicals.split(" || ")[0] == "nfr hr"
    assert {r.evaluation_mode for r in left_out.values()} == {"leave_one_out"} and left_out[1].confidence_scores.count(" || ") == left_out[1].suggestions.count(" || ") == 2
    twin = corpus.unionByName(corpus.where("id = 1").withColumns({"id": F.lit(9).cast("long"), "source": F.lit("other")}))
    assert evaluate.evaluate_suggestions(twin, rows.where("id = 1")).first().rank_of_gold == 1  # another source is another row
    shown = {r.benchmark_id: r for r in evaluate.evaluate_ambiguous(corpus, bench.withColumn("notes", F.lit("n"))).collect()}
    assert shown["B1"].rank_of_expected == 1 and shown["B1"].notes == "n"
    assert evaluate.evaluate_suggestions(corpus, rows.limit(0)).count() == 0
    ranks = {(r.config, r.query_id): r["rank"] for r in evaluate.suggestion_sweep(corpus, bench, evaluate.suggestion_grid()).collect()}
    plain = {r.benchmark_id: r.useful_family_rank for r in evaluate.evaluate_competitive(corpus, bench).collect()}
    assert len(ranks) == 50 and {q: ranks["suggestion base", q] for q in plain} == plain


def test_sign_evaluation(spark):
    from glyphmill.sources.corpus import conform, derive

    rows = [(1, "T1", "S1", "𓀀 𓀁 𓀂", "a b c", "1|a 2|b"), (2, "T2", "S2", "𓀀 𓀁 𓀃", "a b d", "7|a 8|b"), (3, "T3", "S3", "𓀄 𓀅", "x y", "1|a 2|b"), (4, "T4", "S4", "𓀄 𓀅", "x z", ""), (5, "T5", "S5", None, "q", "")]
    corpus = derive(conform(spark.createDataFrame(rows, "id long, source_text_id string, source_sentence_id string, hieroglyphs string, transliteration_gold string, lemma_sequence string")))
    assert {r.id for r in evaluate.sign_targets(corpus).collect()} == {1, 2, 3, 4} and {r.id for r in evaluate.sign_targets(corpus, True).collect()} == {1, 2}
    assert {r.id for r in evaluate.sign_targets(corpus, min_signs=3).collect()} == {1, 2}
    got = {r.id: r for r in evaluate.evaluate_signs(corpus, evaluate.sign_targets(corpus)).collect()}
    assert got[1].useful_rank == 1 and got[1].exact_rank is None and got[1].sign_group_count == 3 and got[1].suggestions.startswith("a b d")
    assert got[3].suggestions.startswith("x z") and got[3].useful_rank == 1
