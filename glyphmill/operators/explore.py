"""Browsing a corpus: facets, search, pages, roll-ups, token tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as X

FACETS = ["source", "period", "language_stage", "script_type", "genre"]
SEARCHED = ["transliteration_gold", "translation", "hieroglyphs", "mdc", "source_text_id", "source_sentence_id", "genre"]


def exact_matches(corpus: DataFrame, query: str) -> DataFrame:
    return corpus.where(F.col("mdc_norm") == X.norm_mdc(F.lit(query)))


def with_facets(corpus: DataFrame, chosen: dict[str, str]) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), chosen.items(), corpus)


def facet_values(corpus: DataFrame, facets: list[str] | None = None) -> DataFrame:
    """(facet, value, n) of each facet that has more than one value that isn't blank; one pass and one shuffle."""
    facets = facets or FACETS
    values = corpus.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), X.text(f).alias("value")) for f in facets])).alias("x")).select("x.*").where(F.trim("value") != "")
    counts = values.groupBy("facet", "value").agg(F.count("*").alias("n"))
    offered = counts.groupBy("facet").agg(F.count("*").alias("k")).where("k > 1").select("facet")
    return counts.join(F.broadcast(offered), "facet")  # a row a facet


def containing(corpus: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the query, taken literally and without case, in one of the columns."""
    return corpus.where(reduce(lambda a, b: a | b, [F.contains(F.upper(X.text(c)), F.upper(F.lit(query))) for c in columns or SEARCHED]))


def page(corpus: DataFrame, number: int, size: int = 50, order: str = "id") -> DataFrame:
    return corpus.orderBy(order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(rows: int, size: int = 50) -> int:
    return max(1, -(-rows // size))


def period_rollup(flagged: DataFrame) -> DataFrame:
    """(period, sentences, reviewed, translated); null periods are a group."""
    return flagged.groupBy("period").agg(F.count("*").alias("sentences"), F.count_if("reviewed").alias("reviewed"), F.count_if(F.trim(X.text("translation")) != "").alias("translated"))


def home_stats(corpus: DataFrame, annotations: DataFrame) -> DataFrame:
    """(name, value): sizes of corpus and review."""
    filled = lambda c: F.count_if(F.trim(X.text(c)) != "")
    one = corpus.agg(F.count("*").alias("sentences"), F.count_distinct("source").alias("sources"), F.count_distinct("period").alias("periods"), filled("hieroglyphs").alias("with_hieroglyphs"), filled("translation").alias("with_translation"), filled("lemma_sequence").alias("with_lemmas"))
    rows = one.unpivot([], one.columns, "name", "value")
    return rows.unionAll(annotations.agg(F.lit("annotated_examples").alias("name"), F.count_distinct("example_id").alias("value")))


def token_analysis(corpus: DataFrame, order: str = "id") -> DataFrame:
    """(id, pos, reading, sign, lemma_id, lemma, upos, gloss): token lists side by side, as long as the reading.

    Shorter lists are filled with "", longer ones cut; a lemma is split at its first bar.
    """
    lists = {"sign": "hieroglyphs", "lemma": "lemma_sequence", "upos": "upos", "gloss": "glossing"}
    rows = corpus.select(F.col(order).alias("id"), X.blank_split("transliteration_gold").alias("r"), *[X.blank_split(c).alias(k) for k, c in lists.items()])
    at = rows.select("id", *[c for c in lists], F.posexplode("r").alias("pos", "reading"))
    get = lambda c: F.coalesce(F.get(c, F.col("pos")), F.lit(""))
    lemma = get("lemma")
    return at.select("id", "pos", "reading", get("sign").alias("sign"), F.substring_index(lemma, "|", 1).alias("lemma_id"), F.when(F.contains(lemma, F.lit("|")), F.substring(lemma, F.instr(lemma, "|") + 1, F.length(lemma))).otherwise("").alias("lemma"), get("upos").alias("upos"), get("gloss").alias("gloss"))
