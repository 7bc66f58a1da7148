"""Occurrences and records of every distinct term, and marks for terms too rare or too common.

Each task encodes the terms of its rows with a local dictionary and keeps count arrays by local number; one shuffle
brings equal terms together in order, where every task numbers its terms in a range of its own (the global integer
dictionary) and sums the arrays block by block of that range. Nothing but one block is ever held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import forms

FLUSH, BLOCK = 200_000, 65_536


def _local_counts(tokenizers: dict) -> object:
    names = list(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[int, str], int] = {}
        occurrences, records = np.zeros(FLUSH * 2, np.int64), np.zeros(FLUSH * 2, np.int64)

        def out() -> pa.RecordBatch:
            n = len(numbers)
            return pa.record_batch([pa.array([names[f] for f, _ in numbers]), pa.array([t for _, t in numbers]), pa.array(occurrences[:n]), pa.array(records[:n])], names=["field", "term", "occurrences", "records"])

        for batch in batches:
            for f, name in enumerate(names):
                cut = tokenizers[name]
                for text in batch.column(f).to_pylist():
                    terms = cut(text)
                    if not terms:
                        continue
                    codes = [numbers.setdefault((f, t), len(numbers)) for t in terms]
                    if len(numbers) > len(occurrences) - 1:
                        occurrences, records = (np.concatenate([x, np.zeros(max(len(x), len(numbers)), np.int64)]) for x in (occurrences, records))
                    for c in codes:
                        occurrences[c] += 1
                    for c in set(codes):
                        records[c] += 1
                    if len(numbers) >= FLUSH:
                        yield out()
                        numbers = {}
                        occurrences[:], records[:] = 0, 0
        if numbers:
            yield out()

    return run


def _range_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task in order of (field, term): numbers them in the task's range and sums by blocks of numbers."""
    base, number, last = TaskContext.get().partitionId() << 40, -1, None
    terms: list[tuple[str, str]] = []
    sums = np.zeros((BLOCK, 2), np.int64)

    def out() -> pa.RecordBatch:
        n = len(terms)
        ids = base + number - n + 1 + np.arange(n)
        return pa.record_batch([pa.array([f for f, _ in terms], pa.string()), pa.array([t for _, t in terms], pa.string()), pa.array(ids, pa.int64()), pa.array(sums[:n, 0]), pa.array(sums[:n, 1])], names=["field", "term", "term_id", "occurrences", "records"])

    for batch in batches:
        fields, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        occ, rec = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        at = 0
        while at < len(words):
            codes = []
            k = at
            while k < len(words):
                key = (fields[k], words[k])
                if key != last:
                    if len(terms) == BLOCK:
                        break
                    terms.append(key)
                    number, last = number + 1, key
                codes.append(len(terms) - 1)
                k += 1
            np.add.at(sums[:, 0], codes, occ[at:k])
            np.add.at(sums[:, 1], codes, rec[at:k])
            at = k
            if at < len(words):
                yield out()
                terms = []
                sums[:] = 0
    if terms:
        yield out()


def term_counts(df: DataFrame, tokenizers: dict, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """(field, term, term_id, occurrences, records, mark) for each distinct term of the columns named in `tokenizers`.

    mark is `rare` in fewer than `rare_below` rows, `common` in more than `common_share` of all rows of `df` (rows
    without text count among them), else null. Null and empty fields have no terms; repeated rows count again; an
    empty table gives no rows.
    """
    total = df.count()
    fields = list(tokenizers)
    partial = df.select(*[F.col(c).cast("string").alias(c) for c in fields]).mapInArrow(_local_counts(tokenizers), "field string, term string, occurrences long, records long")
    summed = partial.repartition("field", "term").sortWithinPartitions("field", "term").mapInArrow(_range_sums, "field string, term string, term_id long, occurrences long, records long")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_share * total, "common")
    return summed.withColumn("mark", mark)


def example_terms(examples: DataFrame) -> DataFrame:
    """Counts of the sign groups and reading tokens of the examples table."""
    return term_counts(examples, {"hieroglyphs": forms.sign_terms, "transliteration_gold": forms.reading_terms})
