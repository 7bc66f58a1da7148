"""How distinctive a term is for a record: divergence from randomness.

score = information content of the term frequency under a geometric model of the collection (Bose-Einstein limit,
mean F / N) x the Laplace after-effect gain 1 / (tfn + 1); tfn = tf * log2(1 + average length / length).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import forms
from glyphmill.operators.packed import split_packed


def reading_tokens(column: pa.Array) -> list[list[str]]:
    """Tokens of the consistent form, each in comparison form."""
    out = []
    for text in column.to_pylist():
        low = forms.lowered(forms.consistent(text)).split() if text else []
        out.append([t for t in (x.translate(forms._KEEP) for x in low) if t])
    return out


def lemma_ids(column: pa.Array) -> list[list[str]]:
    """The part before the first bar of each packed value."""
    return [[t for t in (v.partition("|")[0].strip() for v in row) if t] for row in split_packed(column, True).to_pylist()]


FIELDS = {"transliteration_gold": reading_tokens, "lemma_sequence": lemma_ids}


def term_frequencies(df: DataFrame, key: str, fields: dict) -> DataFrame:
    """(field, id, term, tf, length): one row a distinct term of a record; records without terms give none."""
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for f, name in enumerate(names):
                where, terms, tf, length = [], [], [], []
                for k, row in enumerate(fields[name](batch.column(f + 1))):
                    counts = Counter(row)
                    where += [k] * len(counts)
                    terms += counts.keys()
                    tf += counts.values()
                    length += [len(row)] * len(counts)
                yield pa.record_batch([pa.array([name] * len(terms), pa.string()), pa.array([ids[k] for k in where], pa.int64()), pa.array(terms, pa.string()), pa.array(tf, pa.int32()), pa.array(length, pa.int32())], names=["field", "id", "term", "tf", "length"])

    return df.select(F.col(key).cast("long").alias("id"), *[F.col(n).cast("string").alias(n) for n in names]).mapInArrow(run, "field string, id long, term string, tf int, length int")


def dfr_scores(df: DataFrame, key: str, fields: dict | None = None, hot_share: float = 0.002, only: str = "true") -> DataFrame:
    """(field, id, term, tf, df, score) for every distinct term of every record.

    `only`: a condition on field, id, term, tf and length for the rows wanted; the statistics cover all rows. Terms in
    more than `hot_share` of the records are few (at most the mean number of terms a record / hot_share) and their
    statistics go to every task; all others are joined by a shuffle, in which no term then holds a large part.
    Null and empty fields have no terms; an empty table gives no rows; repeated rows count each.
    """
    tokens = term_frequencies(df, key, fields or FIELDS)
    stats = tokens.groupBy("field", "term").agg(F.sum("tf").alias("F"), F.count("*").alias("df")).persist()
    sums = {r.field: r.total for r in stats.groupBy("field").agg(F.sum("F").alias("total")).collect()}
    n = max(df.count(), 1)
    average = F.create_map(*[x for f, t in sums.items() for x in (F.lit(f), F.lit(float(t) / n))]) if sums else None
    hot = stats.where(F.col("df") > hot_share * n).select("field", "term", F.col("F").alias("hot_F"), F.col("df").alias("hot_df"))
    with_hot = tokens.where(only).join(F.broadcast(hot), ["field", "term"], "left")
    cold = stats.where(F.col("df") <= hot_share * n)
    columns = ["field", "id", "term", "tf", "length", "F", "df"]
    rows = with_hot.where("hot_df is null").join(cold, ["field", "term"]).select(columns)
    rows = rows.unionAll(with_hot.where("hot_df is not null").select("field", "id", "term", "tf", "length", F.col("hot_F").alias("F"), F.col("hot_df").alias("df")))
    if average is None:
        return rows.select("field", "id", "term", "tf", "df", F.lit(None).cast("double").alias("score"))
    tfn = F.col("tf") * F.log2(1 + average[F.col("field")] / F.col("length"))
    mean = F.col("F") / F.lit(float(n))
    information = F.log2(1 + mean) + tfn * F.log2((1 + mean) / mean)
    return rows.select("field", "id", "term", "tf", "df", (information / (tfn + 1)).alias("score"))
