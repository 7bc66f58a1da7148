"""Records that differ only in layout, case, punctuation, look-alike characters or field order.

Bloom filters in two planes, bits hit once and bits hit again, are filled a task at a time from the canonical hashes
and merged segment by segment; a bit of the second plane is set where two hits meet, in a task or between tasks. A
record whose bits aren't all in the second plane has no copy and comes out as a singleton without a shuffle. Only the
others are grouped, by their whole canonical text. The planes have a bound (`max_bits`), so they may be sent to every
task however large the input is; beyond it more records are grouped, and no result changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import forms
from glyphmill.runtime import salted_lookup

HASHES, SEGMENT_BITS = 4, 1 << 19
FORMS = {"text": forms.comparison, "payload": forms.payload_form}


def canonical_rows(df: DataFrame, name: str, key: str, text: str, kind: str) -> DataFrame:
    """(tbl, id, form, hash); rows whose canonical form is empty are left out."""
    make = FORMS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(x) for x in batch.column(1).to_pylist()]
            keep = [k for k, f in enumerate(made) if f]
            kept = [made[k] for k in keep]
            hashes = np.array([xxhash.xxh3_64_intdigest(f"{name}\x1d{f}") for f in kept], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([name] * len(keep), pa.string()), batch.column(0).take(pa.array(keep, pa.int64())), pa.array(kept, pa.string()), pa.array(hashes, pa.int64())], names=["tbl", "id", "form", "hash"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null and id is not null").mapInArrow(run, "tbl string, id long, form string, hash long")


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """HASHES bit positions for each hash; size is a power of two."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(k) * b) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)], 1)


def repeat_plane(hashes: DataFrame, rows: int, max_bits: int = 1 << 26) -> tuple[bytes, int]:
    """Bits hit by two records or more, and the number of bits; at most `max_bits` / 8 bytes reach the driver."""
    size = min(max_bits, max(SEGMENT_BITS, 1 << (8 * max(rows, 1) - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            at = _bits(np.asarray(batch.column(0)), size)
            at = np.sort(at, 1)
            first = np.ones(at.shape, bool)  # a record that hits a bit twice by itself counts once
            first[:, 1:] = at[:, 1:] != at[:, :-1]
            hit, n = np.unique(at[first], return_counts=True)
            again[hit[(n > 1) | once[hit]]] = True
            once[hit] = True
        for s in range(0, size, SEGMENT_BITS):
            if (piece := once[s : s + SEGMENT_BITS]).any():
                yield pa.record_batch([pa.array([s // SEGMENT_BITS], pa.int32()), pa.array([np.packbits(piece).tobytes()], pa.binary()), pa.array([np.packbits(again[s : s + SEGMENT_BITS]).tobytes()], pa.binary())], names=["segment", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, o, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, a = np.frombuffer(o, np.uint8), np.frombuffer(a, np.uint8)
                if s in planes:
                    once, again = planes[s]
                    planes[s] = [once | o, again | a | (once & o)]
                else:
                    planes[s] = [o, a]
        if planes:
            yield pa.record_batch([pa.array(list(planes), pa.int32()), pa.array([p[1].tobytes() for p in planes.values()], pa.binary())], names=["segment", "again"])

    filled = hashes.select("hash").mapInArrow(fill, "segment int, once binary, again binary")
    plane = np.zeros(size // 8, np.uint8)
    for r in filled.repartition("segment").mapInArrow(merge, "segment int, again binary").collect():
        plane[r.segment * SEGMENT_BITS // 8 :][: SEGMENT_BITS // 8] = np.frombuffer(r.again, np.uint8)
    return plane.tobytes(), size


def flag_repeats(rows: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """Adds `maybe`, false only for records that surely have no copy."""
    plane, size = repeat_plane(rows, rows.count(), max_bits)
    held = rows.sparkSession.sparkContext.broadcast(plane)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            at = _bits(np.asarray(batch.column(3)), size)
            maybe = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe, pa.bool_())], names=[*batch.schema.names, "maybe"])

    return rows.mapInArrow(run, "tbl string, id long, form string, hash long, maybe boolean")


def all_rows(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def collapse(rows: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """(tbl, keep_id, copies): one row a distinct record, keep_id the smallest id of its copies.

    Rows: `canonical_rows` of one table or several. The same id given twice counts as two records.
    """
    flagged = flag_repeats(rows.persist(), max_bits)
    grouped = flagged.where("maybe").groupBy("tbl", "form").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    return flagged.where("not maybe").select("tbl", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies")).unionAll(grouped.select("tbl", "keep_id", "copies"))


def copy_pairs(rows: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """(tbl, keep_id, copy_id): every record but the kept one of each group of copies, with the kept one's id.

    A hot group is counted before the shuffle and its members are spread over salts in the lookup.
    """
    maybe = flag_repeats(rows.persist(), max_bits).where("maybe").select("tbl", "id", "form").persist()
    kept = maybe.groupBy("tbl", "form").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return salted_lookup(maybe, kept, ["tbl", "form"], "id").where("id <> keep_id").select("tbl", "keep_id", F.col("id").alias("copy_id"))
