"""Queries of the core: name -> f(spark, sf_dir), and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import benchmarks, evaluate, explore, reading_model, retrieval, review, signs
from glyphmill.operators.packed import explode_packed
from glyphmill.plans import sql as S
from glyphmill.runtime import spread, table
from glyphmill.sources import corpus as C

PACKED = [("examples", "lemma_sequence", "id", True), ("examples", "offering_items", "id", False), ("annotations", "alt_transliterations", "id", False), ("competitive_ambiguity_eval_results", "suggestions", "benchmark_id", False)]
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def examples(spark: SparkSession, d: str) -> DataFrame:
    return C.derive(C.conform(spread(table(spark, d, "examples"))))


def run_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of the searches: every logged run whose id is divisible by 50."""
    return table(spark, d, "retrieval_runs").where("id % 50 = 0").select(F.col("id").alias("query_id"), "query_mdc", "query_reading_order")


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tbl, field, key, blanks in PACKED:
        rows = explode_packed(table(spark, d, tbl), key, field, blanks).select(F.lit(tbl).alias("tbl"), F.lit(field).alias("field"), "row_key", "pos", "item")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(f"WITH {S.BASE} SELECT id, {S.derived(list(C.DERIVED))} FROM base")
def norm_corpus(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark, d).select("id", *C.DERIVED)


@query(f"WITH {S.BASE}, n AS (SELECT {S.norm_mdc('mdc')} AS m FROM base) SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({S.tokens('m')})) AS token FROM n) GROUP BY token")
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_frequencies(examples(spark, d), "mdc_norm")


@query(f"""WITH {S.BASE}, n AS (SELECT id, unnest(list_distinct({S.tokens(S.norm_mdc('mdc'))})) AS token FROM base), size AS (SELECT count(*) AS rows FROM base),
df AS (SELECT token, count(*) AS df FROM n GROUP BY token), w AS (SELECT id, token, ln((rows + 1.0) / (df + 1)) + 1 AS w FROM n JOIN df USING (token), size), total AS (SELECT id, sum(w) AS total FROM w GROUP BY id),
q AS (SELECT id AS query_id, list_distinct({S.tokens(S.norm_mdc('query_mdc'))}) AS t, len({S.tokens(S.norm_mdc('query_mdc'))}) AS k FROM retrieval_runs WHERE id % 50 = 0), qt AS (SELECT query_id, k, unnest(t) AS token FROM q),
qw AS (SELECT query_id, k, token, ln((rows + 1.0) / (coalesce(df, 0) + 1)) + 1 AS w FROM qt LEFT JOIN df USING (token), size), qtotal AS (SELECT query_id, max(k) AS k, sum(w) AS q_total FROM qw GROUP BY query_id),
hit AS (SELECT query_id, w.id, sum(w.w) AS shared FROM qt JOIN w USING (token) GROUP BY query_id, w.id),
scored AS (SELECT query_id, id, shared / (q_total + CASE WHEN k >= 3 THEN 0.3 ELSE 1.0 END * (total - shared)) AS score FROM hit JOIN total USING (id) JOIN qtotal USING (query_id))
SELECT query_id, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM scored) WHERE rn <= 10""")
def idf_overlap_top10(spark: SparkSession, d: str) -> DataFrame:
    """The idf-weighted overlap of query and row by their shared tokens alone: an equi-join on tokens, exact for scores above 0."""
    rows = examples(spark, d).select("id", "mdc_norm")
    n = rows.count()
    tokens = rows.select("id", F.explode(F.array_distinct(X.tokens("mdc_norm"))).alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    weight = F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    total = tokens.join(df, "token").groupBy("id").agg(F.sum(weight).alias("total"))
    q = run_queries(spark, d).select("query_id", X.tokens(X.norm_mdc("query_mdc")).alias("t"))
    qt = q.select("query_id", F.size("t").alias("k"), F.explode(F.array_distinct("t")).alias("token")).join(df, "token", "left").withColumn("w", weight)
    q_total = qt.groupBy("query_id").agg(F.max("k").alias("k"), F.sum("w").alias("q_total"))
    hit = tokens.join(qt, "token").groupBy("query_id", "id").agg(F.sum("w").alias("shared"))
    penalty = F.when(F.col("k") >= 3, 0.3).otherwise(1.0)
    scored = hit.join(total, "id").join(q_total, "query_id").select("query_id", "id", F.round(F.col("shared") / (F.col("q_total") + penalty * (F.col("total") - F.col("shared"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rn", rank).where("rn <= 10").drop("rn")


@query(S.ranking("SELECT id AS query_id, query_mdc, query_reading_order FROM retrieval_runs WHERE id % 50 = 0", retrieval.ScoreWeights().signals(), 10))
def retrieval_signals(spark: SparkSession, d: str) -> DataFrame:
    """The ten best rows of each query with all signals, to nine digits; ties by id."""
    found = retrieval.retrieve(examples(spark, d), run_queries(spark, d), 10)
    return found.select("query_id", "rank", "id", *[F.round(c, 9).alias(c) for c in [*retrieval.SIGNALS, "final_score"]])


@query()
def retrieve_top3(spark: SparkSession, d: str) -> DataFrame:
    corpus = examples(spark, d)
    ranked = retrieval.retrieve(corpus, run_queries(spark, d), 3)
    return corpus.select("id", "source", "transliteration_gold", "aesthetic_arrangement_flag_bool").join(F.broadcast(ranked), "id").select("query_id", "rank", "id", "source", "transliteration_gold", "final_score", retrieval.evidence().alias("evidence"))


@query()
def suggest_readings(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.suggestions_for(examples(spark, d), run_queries(spark, d), 25, 3, include_query=True)


@query()
def retrieval_log(spark: SparkSession, d: str) -> DataFrame:
    queries = run_queries(spark, d)
    return C.run_log(retrieval.retrieve(examples(spark, d), queries, 5), queries)


def benchmark_queries(rows: DataFrame) -> DataFrame:
    """The stated query set of the benchmark: every record whose number is divisible by 50."""
    rows = C.conform(rows.withColumn("acceptable_token_overlap_threshold", F.col("acceptable_token_overlap_threshold").cast("string")), C.COMPETITIVE_COLUMNS)
    return rows.select(*C.COMPETITIVE_COLUMNS).where(F.regexp_extract("benchmark_id", r"(\d+)$", 1).try_cast("long") % 50 == 0)


@query()
def competitive_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate_competitive(examples(spark, d), benchmark_queries(table(spark, d, "competitive_ambiguity_eval_results")))


def stated_targets(rows: DataFrame) -> DataFrame:
    """The stated query set of the evaluations that search with rows: every row whose id is divisible by 50."""
    return rows.where("id % 50 = 0")


@query()
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the stated set is looked for by its own text and reading order."""
    rows = examples(spark, d)
    benchmark = stated_targets(rows).select(F.format_string("BM_%d", "id").alias("benchmark_id"), F.col("mdc").alias("query_mdc"), F.col("normalized_reading_order").alias("query_normalized_reading_order"), *[F.col(k).alias(f"expected_{k}") for k in C.KEYS])
    return evaluate.evaluate_retrieval(rows, benchmark)


@query()
def suggestion_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = examples(spark, d)
    return evaluate.evaluate_suggestions(rows, stated_targets(rows))


@query()
def ambiguous_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate_ambiguous(examples(spark, d), benchmark_queries(table(spark, d, "competitive_ambiguity_eval_results")))


@query()
def sign_reading_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = examples(spark, d)
    return evaluate.evaluate_signs(rows, stated_targets(evaluate.sign_targets(rows, exclude_duplicates=True)))


@query()
def suggestion_weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates of the stated benchmark queries under the 25 suggestion weights."""
    ranks = evaluate.suggestion_sweep(examples(spark, d), benchmark_queries(table(spark, d, "competitive_ambiguity_eval_results")), evaluate.suggestion_grid())
    return evaluate.leaderboard(ranks.withColumn("split", F.when(F.regexp_extract("query_id", r"(\d+)$", 1).cast("long") % 100 == 0, "tune").otherwise("holdout")))


@query()
def failure_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The failed ones of the stated query set against every row; `failure_classes` reads the logged ranks alone."""
    failed = table(spark, d, "competitive_ambiguity_eval_results").where(~F.coalesce("top3_useful_family_hit", F.lit(False)))
    return evaluate.failure_analysis(examples(spark, d), benchmark_queries(failed))


@query()
def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How far the blends of a grid agree with the logged runs' best example, by its rank among all rows."""
    best = table(spark, d, "retrieval_runs").select(F.col("id").alias("query_id"), F.substring_index("top_example_ids", ",", 1).try_cast("long").alias("expected"))
    ranks = retrieval.expected_ranks(examples(spark, d), run_queries(spark, d).join(best, "query_id"), evaluate.weight_grid())
    ranks = ranks.withColumn("split", F.when(F.col("query_id") % 100 == 0, "tune").otherwise("holdout"))
    return evaluate.leaderboard(ranks)


@query(f"WITH {S.ALIGNED} SELECT sign, reading, count(*) AS n FROM pairs GROUP BY sign, reading")
def sign_readings(spark: SparkSession, d: str) -> DataFrame:
    return signs.attestations(signs.aligned(examples(spark, d))).select("sign", "reading", "n")


_INDEX = f"""{S.ALIGNED}, c AS (SELECT sign, reading, count(*) AS n FROM pairs GROUP BY sign, reading), l AS (SELECT sign, {S.loose('reading')} AS loose, sum(n) AS n, count(*) AS literal FROM c GROUP BY 1, 2),
idx AS (SELECT sign, sum(n)::BIGINT AS total_instances, sum(literal)::BIGINT AS literal_count, count(*) AS distinct_count, count(*) > 1 AS is_multivalent, sum(literal) > 1 AND count(*) = 1 AS editorial_only, count(*) > 1 AND count(*) FILTER (n >= 3) >= 2 AS well_attested FROM l GROUP BY sign)"""


@query(f"WITH {_INDEX} SELECT * FROM idx")
def sign_index(spark: SparkSession, d: str) -> DataFrame:
    return signs.sign_index(signs.attestations(signs.aligned(examples(spark, d)))).drop("first_ord", "first_pos")


@query(f"WITH {_INDEX} SELECT count(*) AS sign_groups, count(*) FILTER (literal_count > 1) AS literal_multi, count(*) FILTER (is_multivalent) AS genuinely_multivalent, count(*) FILTER (editorial_only) AS editorial_only, count(*) FILTER (well_attested) AS well_attested_multivalent, 3 AS min_support, coalesce(sum(total_instances) FILTER (is_multivalent), 0)::BIGINT AS ambiguous_instances, coalesce(sum(total_instances), 0)::BIGINT AS total_instances FROM idx")
def multivalence_summary(spark: SparkSession, d: str) -> DataFrame:
    return signs.multivalence(signs.sign_index(signs.attestations(signs.aligned(examples(spark, d)))))


@query(f"WITH {S.ALIGNED} SELECT sign, reading, ord, place::INT AS place FROM (SELECT sign, reading, ord, row_number() OVER (PARTITION BY sign, reading ORDER BY ord, pos) AS place FROM pairs) WHERE place <= 4")
def reading_examples(spark: SparkSession, d: str) -> DataFrame:
    return signs.reading_examples(signs.aligned(examples(spark, d)))


@query(f"""WITH {S.ALIGNED} SELECT 'bigram' AS kind, previous_reading AS a, '' AS b, reading, count(*) AS n FROM pairs GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'left', previous_sign, sign, reading, count(*) FROM pairs GROUP BY 1, 2, 3, 4 UNION ALL SELECT 'right', sign, next_sign, reading, count(*) FROM pairs GROUP BY 1, 2, 3, 4""")
def context_counts(spark: SparkSession, d: str) -> DataFrame:
    m = reading_model.fit(examples(spark, d))
    part = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"), "reading", "n")
    return part(m.bigram, "bigram", "previous_reading", F.lit("")).unionAll(part(m.left, "left", "previous_sign", F.col("sign"))).unionAll(part(m.right, "right", "sign", F.col("next_sign")))


@query(f"""WITH {S.ALIGNED}, c AS (SELECT sign, reading, count(*) AS n, min((ord, pos)) AS f FROM pairs GROUP BY sign, reading)
SELECT sign, reading, n, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY n DESC, f) AS rn, sum(n) OVER (PARTITION BY sign) AS total FROM c) WHERE rn = 1""")
def most_frequent_readings(spark: SparkSession, d: str) -> DataFrame:
    return reading_model.fit(examples(spark, d)).most_frequent()


def _trained(spark: SparkSession, d: str) -> tuple:
    """A model of the train split and the sentences of the test split."""
    rows = examples(spark, d)
    return reading_model.fit(rows.where("split = 'train'")), rows.where("split = 'test'")


@query(f"""WITH {S.ALIGNED}, tr AS (SELECT p.* FROM pairs p JOIN examples e ON p.ord = e.id WHERE e.split = 'train'), total AS (SELECT sign, count(*) AS total FROM tr GROUP BY sign),
te AS (SELECT DISTINCT unnest(s) AS sign FROM lists l JOIN examples e USING (id) WHERE e.split = 'test'), un AS (SELECT sign FROM te WHERE sign NOT IN (SELECT sign FROM total)),
ug AS (SELECT sign, unnest(list_distinct(string_split(sign, ''))) AS g FROM un), kg AS (SELECT sign AS grp, unnest(list_distinct(string_split(sign, ''))) AS g FROM total),
sh AS (SELECT sign, grp, count(*) AS common FROM ug JOIN kg USING (g) GROUP BY 1, 2),
sc AS (SELECT sh.sign, grp, common / (len(list_distinct(string_split(sh.sign, ''))) + len(list_distinct(string_split(grp, ''))) - common) AS similarity, total FROM sh JOIN total ON grp = total.sign)
SELECT sign, grp AS "group", similarity FROM (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY similarity DESC, total DESC, grp) AS rn FROM sc) WHERE rn = 1""")
def nearest_groups(spark: SparkSession, d: str) -> DataFrame:
    model, test = _trained(spark, d)
    known = model.emission.select("sign").distinct()
    unseen = test.select(F.explode(X.blank_split("hieroglyphs_norm")).alias("sign")).distinct().join(known, "sign", "left_anti")
    return reading_model.nearest_groups(model, unseen)


@query()
def decode_readings(spark: SparkSession, d: str) -> DataFrame:
    model, test = _trained(spark, d)
    return reading_model.decode(model, test, "id", "hieroglyphs_norm")


@query()
def decode_summary(spark: SparkSession, d: str) -> DataFrame:
    model, test = _trained(spark, d)
    return reading_model.decode_summary(reading_model.decode(model, test, "id", "hieroglyphs_norm"), "id")


@query()
def reading_model_eval(spark: SparkSession, d: str) -> DataFrame:
    return reading_model.evaluate(examples(spark, d))


@query()
def reading_model_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The reading model by corpus size; the sizes are the feature."""
    return reading_model.size_sweep(examples(spark, d), [500, 2000, None])


_METRICS = "count(*) AS queries, avg(CASE WHEN useful_family_rank <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top1, avg(CASE WHEN useful_family_rank <= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS topk, round(avg(coalesce(1.0::DOUBLE / useful_family_rank, 0)), 9) AS mrr, count(*) FILTER (useful_family_rank IS NULL OR useful_family_rank > 3) AS failures"


@query(f"SELECT query_type, {_METRICS} FROM competitive_ambiguity_eval_results GROUP BY query_type")
def benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hit_metrics(table(spark, d, "competitive_ambiguity_eval_results"), "useful_family_rank", by=["query_type"]).withColumn("mrr", F.round("mrr", 9))


@query(f"""WITH t AS (SELECT benchmark_id, list_distinct({S.tokens('query_input')}) AS t, useful_family_rank AS r, acceptable_token_overlap_threshold AS th,
coalesce(list_max(list_transform(list_filter(string_split(coalesce(expected_token_overlap_scores, ''), '||'), lambda x: trim(x) <> ''), lambda x: CAST(trim(x) AS DOUBLE))), 0.0) AS best
FROM competitive_ambiguity_eval_results WHERE NOT coalesce(top3_useful_family_hit, false))
SELECT benchmark_id, len(t)::INT AS query_token_count, best AS best_available_token_overlap, CASE WHEN len(t) <= 2 OR len(list_filter(t, lambda x: NOT list_contains({X.STOP_TOKENS}, x))) = 0 THEN 'query_too_short' WHEN r > 3 THEN 'ranking_issue' WHEN best >= th - 0.06 THEN 'threshold_too_strict' ELSE 'corpus_gap' END AS failure_category FROM t""")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.failure_rows(table(spark, d, "competitive_ambiguity_eval_results"))


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY created_at DESC, id DESC) AS rn FROM annotations) WHERE rn = 1)"


@query(f"WITH {_LATEST} SELECT * EXCLUDE (rn) FROM latest")
def latest_annotations(spark: SparkSession, d: str) -> DataFrame:
    return review.latest(table(spark, d, "annotations"))


@query(f"WITH {_LATEST} SELECT e.id AS example_id, source, source_text_id, source_sentence_id, {', '.join(f'e.{c} AS base_{c}' for c in review.BASE)}, source_ref, {', '.join(f'l.{c} AS latest_{c}' for c in review.LATEST)}, l.created_at AS latest_annotation_created_at FROM examples e JOIN latest l ON e.id = l.example_id")
def reviewed_export(spark: SparkSession, d: str) -> DataFrame:
    return review.reviewed_export(table(spark, d, "examples"), table(spark, d, "annotations"))


@query(f"WITH {_LATEST} SELECT e.id AS example_id FROM examples e JOIN latest l ON e.id = l.example_id WHERE trim(coalesce(l.transliteration, '')) <> trim(coalesce(e.transliteration_gold, ''))")
def changed_readings(spark: SparkSession, d: str) -> DataFrame:
    return review.changed_readings(review.reviewed_export(table(spark, d, "examples"), table(spark, d, "annotations"))).select("example_id")


@query(f"WITH {_LATEST} SELECT s.status, count(l.id) AS n FROM (VALUES ('accepted'), ('edited'), ('rejected'), ('uncertain')) s(status) LEFT JOIN latest l ON l.status = s.status GROUP BY s.status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.status_counts(table(spark, d, "annotations"))


_FIRST_LAST = "k AS (SELECT *, row_number() OVER (PARTITION BY source, source_text_id, source_sentence_id ORDER BY id) AS a, row_number() OVER (PARTITION BY source, source_text_id, source_sentence_id ORDER BY id DESC) AS b FROM examples)"
_FIELDS = [c for c in C.BASE_COLUMNS if c not in C.KEYS]


@query(f"""WITH {_FIRST_LAST}, j AS (SELECT o.id, list_filter([{', '.join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in _FIELDS)}], lambda x: x IS NOT NULL) AS changed
FROM (SELECT * FROM k WHERE a = 1) o JOIN (SELECT * FROM k WHERE b = 1) n ON {' AND '.join(f'o.{c} IS NOT DISTINCT FROM n.{c}' for c in C.KEYS)})
SELECT 'action' AS kind, CASE WHEN len(changed) > 0 THEN 'updated' ELSE 'unchanged' END AS name, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'field', f, count(*) FROM (SELECT unnest(changed) AS f FROM j) GROUP BY f""")
def upsert_tally(spark: SparkSession, d: str) -> DataFrame:
    """The first import of every key against its last one."""
    rows = table(spark, d, "examples")
    return C.upsert_tally(C.upsert_plan(C.first_of(rows, C.KEYS, "id"), C.first_of(rows.withColumn("late", -F.col("id")), C.KEYS, "late")))


@query(f"""WITH x AS (SELECT unnest([{', '.join(f"{{'facet': '{f}', 'value': coalesce({f}, '')}}" for f in explore.FACETS)}]) AS x FROM examples), c AS (SELECT x.facet AS facet, x.value AS value, count(*) AS n FROM x WHERE trim(x.value) <> '' GROUP BY 1, 2)
SELECT * FROM c WHERE facet IN (SELECT facet FROM c GROUP BY facet HAVING count(*) > 1)""")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return explore.facet_values(table(spark, d, "examples"))


SEARCH_TEXT = "Garden"


@query(f"SELECT id FROM examples WHERE source = 'NILCORP' AND ({' OR '.join(f'''contains(upper(coalesce({c}, '')), upper('{SEARCH_TEXT}'))''' for c in explore.SEARCHED)})")
def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    return explore.containing(explore.with_facets(table(spark, d, "examples"), {"source": "NILCORP"}), SEARCH_TEXT).select("id")


@query("SELECT id, source, transliteration_gold FROM examples ORDER BY id LIMIT 50 OFFSET 100")
def third_page(spark: SparkSession, d: str) -> DataFrame:
    return explore.page(table(spark, d, "examples").select("id", "source", "transliteration_gold"), 3)


@query("SELECT period, count(*) AS sentences, count(*) FILTER (id IN (SELECT example_id FROM annotations)) AS reviewed, count(*) FILTER (trim(coalesce(translation, '')) <> '') AS translated FROM examples GROUP BY period")
def period_rollup(spark: SparkSession, d: str) -> DataFrame:
    return explore.period_rollup(review.reviewed_flags(table(spark, d, "examples"), table(spark, d, "annotations")))


_FILLED = lambda c, n: f"SELECT '{n}', count(*) FILTER (trim(coalesce({c}, '')) <> '') FROM examples"


@query(f"SELECT 'sentences' AS name, count(*) AS value FROM examples UNION ALL SELECT 'sources', count(DISTINCT source) FROM examples UNION ALL SELECT 'periods', count(DISTINCT period) FROM examples UNION ALL {_FILLED('hieroglyphs', 'with_hieroglyphs')} UNION ALL {_FILLED('translation', 'with_translation')} UNION ALL {_FILLED('lemma_sequence', 'with_lemmas')} UNION ALL SELECT 'annotated_examples', count(DISTINCT example_id) FROM annotations")
def home_stats(spark: SparkSession, d: str) -> DataFrame:
    return explore.home_stats(table(spark, d, "examples"), table(spark, d, "annotations"))


@query(f"""WITH l AS (SELECT id, {S.blank_split('transliteration_gold')} AS r, {S.blank_split('hieroglyphs')} AS s, {S.blank_split('lemma_sequence')} AS m, {S.blank_split('upos')} AS u, {S.blank_split('glossing')} AS g FROM examples)
SELECT id, (p - 1)::INT AS pos, r[p] AS reading, coalesce(s[p], '') AS sign, split_part(coalesce(m[p], ''), '|', 1) AS lemma_id, CASE WHEN contains(coalesce(m[p], ''), '|') THEN substr(m[p], strpos(m[p], '|') + 1) ELSE '' END AS lemma, coalesce(u[p], '') AS upos, coalesce(g[p], '') AS gloss
FROM (SELECT *, unnest(range(1, len(r) + 1)) AS p FROM l)""")
def token_analysis(spark: SparkSession, d: str) -> DataFrame:
    return explore.token_analysis(table(spark, d, "examples"))


_YEAR = lambda n: f"CAST(TRY_CAST({S.squeeze(f'''json_extract_string(payload, '$.{n}')''')} AS DOUBLE) AS INT)"


@query(f"""WITH y AS (SELECT raw_id, {_YEAR('dateNotBefore')} AS b, {_YEAR('dateNotAfter')} AS a FROM raw_records), m AS (SELECT raw_id, coalesce(b, a) AS lo, coalesce(a, b) AS hi FROM y)
SELECT raw_id, CASE WHEN lo IS NULL THEN '' {' '.join(f"WHEN (lo + hi) / 2 >= {lo} AND (lo + hi) / 2 < {hi} THEN '{n}'" for n, lo, hi in X.PERIODS)} ELSE 'Undated range (' || lo || ' to ' || hi || ')' END AS period FROM m""")
def raw_periods(spark: SparkSession, d: str) -> DataFrame:
    fields = F.from_json("payload", "dateNotBefore string, dateNotAfter string")
    return table(spark, d, "raw_records").withColumn("j", fields).select("raw_id", X.derive_period(X.parse_year("j.dateNotBefore"), X.parse_year("j.dateNotAfter")).alias("period"))


@query()
def import_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw payloads as corpus rows."""
    fields = F.from_json("payload", "hieroglyphs string, transliteration_gold string, translation string, genre string, dateNotBefore string, dateNotAfter string")
    return C.import_records(table(spark, d, "raw_records").select("raw_id", fields.alias("j")).select("raw_id", "j.*"), "IMPORT", "raw_records", "raw_id")


@query("SELECT printf('BM_%03d', n) AS benchmark_id, mdc AS query_mdc, normalized_reading_order AS query_normalized_reading_order, source AS expected_source, source_text_id AS expected_source_text_id, source_sentence_id AS expected_source_sentence_id FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM examples) WHERE n <= 20")
def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    return benchmarks.evaluation_rows(table(spark, d, "examples"))


@query(f"""WITH {S.BASE}, w AS (SELECT *, {S.blank_split(f"regexp_replace({S.loose('transliteration_gold')}, '\\bpl\\b', '', 'g')")} AS words, row_number() OVER (ORDER BY id) AS n FROM base QUALIFY n <= 20),
d AS (SELECT *, list_transform(words, lambda x: CASE WHEN len(x) > 4 AND right(x, 1) IN ('t', 'w', 'j', 'y') THEN left(x, len(x) - 1) ELSE x END) AS cut, len(words) AS k, trim(normalized_reading_order) AS own FROM w)
SELECT printf('AMB_%03d', n) AS benchmark_id, CASE n % 3 WHEN 2 THEN array_to_string(CASE WHEN k <= 2 THEN cut[1:1] ELSE cut[1:greatest(2, least(k - 1, round_even(k * 0.65::DOUBLE, 0)::INT))] END, ' ') WHEN 0 THEN CASE WHEN own <> '' THEN own ELSE array_to_string(words, ' ') END ELSE array_to_string(cut, ' ') END AS query_input,
['simplified_transliteration', 'partial_transliteration', 'normalized_reading_order'][((n - 1) % 3 + 1)::INT] AS query_type, transliteration_gold AS expected_transliteration, source_text_id AS expected_source_text_id, source_sentence_id AS expected_source_sentence_id FROM d""")
def ambiguous_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return benchmarks.ambiguous_queries(examples(spark, d))


@query()
def competitive_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Every row is compared with every other; the builder's own option of the first 2000 rows is for parity only."""
    return benchmarks.competitive_queries(examples(spark, d), pool_size=0)


@query()
def expert_review_sheet(spark: SparkSession, d: str) -> DataFrame:
    model, test = _trained(spark, d)
    gold = signs.aligned(test).select(F.col("ord").alias("id"), "pos", F.col("reading").alias("gold_reading"))
    text = test.select("id", F.left(X.text("transliteration_gold"), F.lit(90)).alias("sentence"))
    listed = F.array_join(F.transform("candidates", lambda c: F.format_string("%s:%.2f", c["reading"], c["share"])), " | ")
    errors = reading_model.decode(model, test, "id", "hieroglyphs_norm").where("was_seen and is_ambiguous").join(gold, ["id", "pos"]).where("predicted <> gold_reading").join(text, "id")
    return benchmarks.review_sheet(errors.select("sign", "gold_reading", F.col("predicted").alias("context_prediction"), "attested_count", listed.alias("candidates"), "sentence"))
