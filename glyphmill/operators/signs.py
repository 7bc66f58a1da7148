"""Sign groups and the readings they are attested with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X


def aligned(corpus: DataFrame, signs: str = "hieroglyphs_norm", readings: str = "transliteration_gold", order: str = "id", raw: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ord, pos, sign, reading, previous_sign, previous_reading, next_sign): one row a sign of each aligned sentence.

    A sentence counts only if it has signs and as many readings; null and empty ones don't. `raw` names a column that
    stands in where the signs are empty. The neighbours of the ends are `<s>`. No shuffle: neighbours come from the
    arrays of the row.
    """
    glyphs = X.blank_split(signs)
    if raw:
        glyphs = F.when(X.text(signs) == "", X.blank_split(raw)).otherwise(glyphs)
    rows = corpus.select(F.col(order).alias("ord"), *keep, glyphs.alias("s"), X.blank_split(readings).alias("r")).where("size(s) > 0 and size(s) = size(r)")
    exploded = rows.select("ord", *keep, "s", "r", F.posexplode(F.arrays_zip(F.col("s").alias("sign"), F.col("r").alias("reading"))).alias("pos", "z"))
    at = lambda a, k: F.coalesce(F.get(F.col(a), F.col("pos") + k), F.lit("<s>"))
    before = lambda a: F.when(F.col("pos") == 0, "<s>").otherwise(at(a, -1))
    return exploded.select("ord", "pos", *keep, F.col("z.sign").alias("sign"), F.col("z.reading").alias("reading"), before("s").alias("previous_sign"), before("r").alias("previous_reading"), at("s", 1).alias("next_sign"))


def attestations(pairs: DataFrame) -> DataFrame:
    """(sign, reading, n, first_ord, first_pos): counts with the first place, which orders ties."""
    return pairs.groupBy("sign", "reading").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("f")).select("sign", "reading", "n", F.col("f.ord").alias("first_ord"), F.col("f.pos").alias("first_pos"))


def sign_index(counts: DataFrame, min_support: int = 3) -> DataFrame:
    """(sign, total_instances, literal_count, distinct_count, is_multivalent, editorial_only, well_attested, first_ord, first_pos).

    distinct readings are loose forms, so variants of editing fall together.
    """
    loose = counts.groupBy("sign", X.loose_reading("reading").alias("loose")).agg(F.sum("n").alias("n"), F.count("*").alias("literal"), F.min(F.struct("first_ord", "first_pos")).alias("f"))
    out = loose.groupBy("sign").agg(F.sum("n").alias("total_instances"), F.sum("literal").alias("literal_count"), F.count("*").alias("distinct_count"), F.count_if(F.col("n") >= min_support).alias("supported"), F.min("f").alias("f"))
    multivalent = F.col("distinct_count") > 1
    return out.select("sign", "total_instances", "literal_count", "distinct_count", multivalent.alias("is_multivalent"), ((F.col("literal_count") > 1) & ~multivalent).alias("editorial_only"), (multivalent & (F.col("supported") >= 2)).alias("well_attested"), F.col("f.first_ord").alias("first_ord"), F.col("f.first_pos").alias("first_pos"))


def reading_examples(pairs: DataFrame, count: int = 4, columns: tuple[str, ...] = ()) -> DataFrame:
    """(sign, reading, place, ord, columns): the first `count` sentences of each reading in corpus order.

    The window keeps `count` rows a group before the shuffle, so a hot reading costs little.
    """
    w = Window.partitionBy("sign", "reading").orderBy("ord", "pos")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count).select("sign", "reading", "place", "ord", *columns)


def multivalence(index: DataFrame, min_support: int = 3) -> DataFrame:
    """One row of totals over the sign index."""
    one = lambda c: F.count_if(c)
    return index.agg(
        F.count("*").alias("sign_groups"), one(F.col("literal_count") > 1).alias("literal_multi"), one(F.col("is_multivalent")).alias("genuinely_multivalent"), one(F.col("editorial_only")).alias("editorial_only"),
        one(F.col("well_attested")).alias("well_attested_multivalent"), F.lit(min_support).alias("min_support"), F.coalesce(F.sum(F.when(F.col("is_multivalent"), F.col("total_instances"))), F.lit(0)).alias("ambiguous_instances"), F.coalesce(F.sum("total_instances"), F.lit(0)).alias("total_instances"),
    )


def ranked_multivalent(index: DataFrame, limit: int = 0) -> DataFrame:
    out = index.where("is_multivalent").orderBy(F.desc("total_instances"), F.desc("distinct_count"), "first_ord", "first_pos")
    return out.limit(limit) if limit else out
