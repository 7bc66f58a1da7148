"""Annotations of examples: the latest of each, exports, counts, and the state of review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as X

STATUSES = ["accepted", "edited", "rejected", "uncertain"]
LATEST = ["transliteration", "uncertainty_note", "grammar_note", "status", "display_sequence", "normalized_reading_order", "alt_transliterations", "variant_writing_note", "morphology_note", "syntax_note", "aesthetic_arrangement_flag"]
BASE = ["transliteration_gold", "translation", "hieroglyphs", "mdc", "sign_sequence", "lemma_sequence", "upos", "glossing", "grammar_notes", "display_sequence", "normalized_reading_order", "alt_transliterations", "variant_writing_note", "morphology_note", "syntax_note", "aesthetic_arrangement_flag"]
KEYS = ["source", "source_text_id", "source_sentence_id"]


def latest(annotations: DataFrame) -> DataFrame:
    """The newest annotation of each example, ties by the larger id.

    A partial aggregate carries the row, so an example with a third of all annotations costs one row a task. Nulls in
    created_at are oldest; a null example_id is a group of its own.
    """
    columns = annotations.columns
    return annotations.groupBy("example_id").agg(F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("r")).select("r.*")


def history(annotations: DataFrame, example_id: int) -> DataFrame:
    return annotations.where(F.col("example_id") == example_id).orderBy(F.desc("created_at"), F.desc("id")).select("id", "created_at", *[c for c in LATEST if c not in ("display_sequence", "normalized_reading_order", "alt_transliterations")])


def attach_ids(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows with the stored id of their key, the largest where a key is stored twice; null where it isn't."""
    ids = stored.groupBy(*KEYS).agg(F.max("id").alias("db_id"))
    return rows.join(ids, KEYS, "left")


def reviewed_export(examples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Examples with their latest annotation: keys, base_ and latest_ columns."""
    last = latest(annotations).select("example_id", *[F.col(c).alias(f"latest_{c}") for c in LATEST], F.col("created_at").alias("latest_annotation_created_at"))
    base = examples.select(F.col("id").alias("example_id"), *KEYS, *[F.col(c).alias(f"base_{c}") for c in BASE], "source_ref")
    return base.join(last, "example_id")


def reviewed_flags(examples: DataFrame, annotations: DataFrame) -> DataFrame:
    done = annotations.select(F.col("example_id").alias("id"), F.lit(True).alias("reviewed")).distinct()
    return examples.join(done, "id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def status_counts(annotations: DataFrame) -> DataFrame:
    """(status, n) of the latest annotations, also for statuses that none has."""
    every = annotations.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = latest(annotations).groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def changed_readings(export: DataFrame) -> DataFrame:
    return export.where(F.trim(X.text("latest_transliteration")) != F.trim(X.text("base_transliteration_gold")))


def with_statuses(export: DataFrame, statuses: list[str]) -> DataFrame:
    return export.where(F.col("latest_status").isin(statuses))
