"""Queries over the operators of this subpackage: name -> f(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import copies, distinctive, leaks, lookalike, overlap, packing, spam, splits, termcount
from glyphmill.plans import sql as S
from glyphmill.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.overlaps(table(spark, d, "examples"), table(spark, d, "competitive_ambiguity_eval_results"))
    return found.select("eval_set", "eval_key", "train_id").distinct()


def p1_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(overlap.overlaps(table(spark, d, "examples"), table(spark, d, "competitive_ambiguity_eval_results")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_texts(table(spark, d, "examples"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "examples"), table(spark, d, "split_plan"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return termcount.example_terms(table(spark, d, "examples")).where("mark is not null").select("field", "term", "mark")


def p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return termcount.example_terms(table(spark, d, "examples")).drop("term_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(table(spark, d, "annotations"), table(spark, d, "examples"))


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    examples, annotations = table(spark, d, "examples"), table(spark, d, "annotations")
    both = examples.select(F.lit("examples").alias("tbl"), "id", F.col("transliteration_gold").alias("typed")).unionAll(annotations.select(F.lit("annotations"), "id", "transliteration"))
    return lookalike.canonical_columns(both, ["typed"], lookalike.vocabulary(both, "typed")).select("tbl", "id", "typed_form")


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.all_rows([
        copies.canonical_rows(table(spark, d, "examples"), "examples", "id", "transliteration_gold", "text"),
        copies.canonical_rows(table(spark, d, "reading_suggestions"), "reading_suggestions", "suggestion_id", "candidate_transliteration", "text"),
        copies.canonical_rows(table(spark, d, "raw_records"), "raw_records", "raw_id", "payload", "payload"),
    ])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(_copies(spark, d))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_copies(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.dfr_scores(table(spark, d, "examples"), "id", only="tf >= 3").where("df <= 5")
    return scores.select("field", F.col("id").alias("example_id"), "term")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.dfr_scores(table(spark, d, "examples"), "id")


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_fill(p8_packs(spark, d), table(spark, d, "pack_sizes"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages")).where("exact_windows > 0").select("item_id", "doc_id")


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages")).where("slot_windows > 0")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_scores(table(spark, d, "documents")).where("is_spam").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_scores(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_overlap_report, p2_found, p2_splits, p3_found, p3_term_counts, p4_found, p4_consistent, p5_found, p5_collapsed, p6_found, p6_scores, p8_packs, p8_fill, p9_found, p9_reparameterised, p10_found, p10_scores)}

_RELATED = lambda c: f"regexp_replace(upper(regexp_replace({c}, '^{S.WS}+|{S.WS}+$', '', 'g')), '[-_{S.WS[1:]}+', '_', 'g')"
_ABSENT = ", ".join(f"'{x}'" for x in splits.ABSENT)
ORACLES = {
    "p2_found": f"""WITH RECURSIVE r AS (SELECT DISTINCT {_RELATED('source_text_id')} AS t, {_RELATED('source_sentence_id')} AS s FROM examples), v AS (SELECT * FROM r WHERE t NOT IN ({_ABSENT}) AND s NOT IN ({_ABSENT})),
e AS (SELECT DISTINCT x.t AS a, y.t AS b FROM v x JOIN v y USING (s) WHERE x.t <> y.t), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS text_a, b AS text_b FROM reach WHERE a < b""",
}
