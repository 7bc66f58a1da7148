"""Same or near-same records across splits: a weighted cosine join of gram vectors, then the exact edit distance.

A text is the vector of its grams of q characters; the n-th occurrence of a gram is a term of its own, so the dot
product of two texts is the size of their common multiset. k edits spoil at most q * k grams, so texts within the
edit bound have a dot product of at least `least(n)`, n being the grams of the one side; that is the threshold of the
join, a cosine of `least(n)` / n. Weights order the terms: a term is the heavier the rarer it is in the whole input.
Only the heaviest terms of a text enter the inverted lists; those left out can add no more than the residual, at most
`least(n)` - 1, even if each meets the largest weight there is, one. Two texts that reach the threshold thus meet in an
inverted list, namely in an n-th occurrence of a gram of which the edits leave n at least. Edits renumber occurrences,
so the two needn't lie at like places; but the n-th one left lies, in either text, between the n-th and the last
occurrence of the gram. Within a list, pairs whose lengths or whose ranges of such places can't be matched by the
allowed edits, or whose pair-of-characters sketches differ in more bits than the edits can change, are dropped; distinct
pairs that remain are verified by their texts. Every step before the verification only drops pairs that can't pass it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import forms
from glyphmill.runtime import checkpoint, salted_lookup

BUCKETS, BLOCK = 1 << 20, 1 << 14
GRAMS = {"reading": 5, "signs": 3}
LEAST_LENGTH = {"reading": 30, "signs": 20}
PERCENT = 15
PLACE_BITS = 21
LONGEST = (1 << PLACE_BITS) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _hash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of every gram of every text; each text has at least q characters."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - q + 1, 0)
    row = np.repeat(np.arange(len(texts)), counts)
    pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[row] + pos
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            h = _hash(h * _MIX[0] + code[at + k] + np.uint64(1))
    return row, pos, h


def _terms(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `_grams`, sorted by row and gram; the n-th occurrence of a gram in a text is a term of its own.

    The last array has the position of the gram's last occurrence in the text.
    """
    row, pos, h = _grams(texts, q)
    order = np.lexsort((pos, h, row))
    row, pos, h = row[order], pos[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    occurrence = np.arange(len(h)) - first[run] if len(h) else np.zeros(0, np.int64)
    last = pos[np.append(first[1:], len(h))[run] - 1] if len(h) else np.zeros(0, np.int64)
    again = occurrence > 0
    with np.errstate(over="ignore"):
        h[again] = _hash(h[again] + occurrence[again].astype(np.uint64) * _MIX[0])
    return row, pos, h, last


@lru_cache(maxsize=100_000)
def _least(length: int, q: int) -> int:
    return max(1, min(m - q + 1 - q * (m * PERCENT // 100) for m in range(length, length * 100 // (100 - PERCENT) + 1)))


def least(lengths: np.ndarray, q: int) -> np.ndarray:
    """The least dot product of a text of each length with a text within the bound.

    The longer text of m characters has m - q + 1 grams and the edits spoil q * 15 % of m of them at most; a text of a
    given length meets partners that are longer by the bound at most, and with shorter ones it is the longer itself.
    """
    found, back = np.unique(lengths, return_inverse=True)
    return np.array([_least(int(n), q) for n in found], np.int64)[back] if len(found) else np.zeros(0, np.int64)


def _sketch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits, one bit for each pair of neighbouring characters; an edit changes four bits at most."""
    row, _, h = _grams(texts, 2)
    bits = np.zeros((len(texts), 128), bool)
    bits[row, (h & np.uint64(127)).astype(np.int64)] = True
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return words[:, 0], words[:, 1]


def term_weights(texts: DataFrame) -> np.ndarray:
    """How many terms of the whole input fall into each of BUCKETS buckets; 4 MB whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for kind, q in GRAMS.items():
                if own := [v for k, v in zip(kinds, values, strict=True) if k == kind]:
                    total += np.bincount((_terms(own, q)[2] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        for b in range(0, BUCKETS, BLOCK):
            if (piece := total[b : b + BLOCK]).any():
                yield pa.record_batch([pa.array([b // BLOCK], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(c, np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 2**31 - 1).astype(np.int32).tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(BUCKETS, np.int32)
    for r in texts.select("kind", "text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int32)
    return out


def inverted_lists(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """(term, sid, at, s1, s2) of the terms that a text needs in the lists; at holds its length, how far the gram's last
    occurrence lies behind, and the gram's position; a text of LONGEST characters or more has no places."""
    held = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for batch in batches:
            kinds, values, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.asarray(batch.column(2))
            for kind, q in GRAMS.items():
                own = [k for k, v in enumerate(kinds) if v == kind]
                if not own:
                    continue
                texts_, sid = [values[k] for k in own], ids[own]
                length = np.array([len(t) for t in texts_], np.int64)
                row, pos, h, last = _terms(texts_, q)
                order = np.lexsort((h, common[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], row))
                row, pos, h, last = row[order], pos[order], h[order], last[order]
                count = length - q + 1
                rank = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                keep = rank < (count - least(length, q) + 1)[row]
                row, pos, h, last = row[keep], pos[keep], h[keep], last[keep]
                placed = np.where(length[row] < LONGEST, (last - pos) << PLACE_BITS | pos, 0)
                s1, s2 = _sketch(texts_)
                with np.errstate(over="ignore"):
                    h = h + np.uint64(q)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(sid[row], pa.int64()), pa.array((np.minimum(length, LONGEST)[row] << 2 * PLACE_BITS) | placed), pa.array(s1[row]), pa.array(s2[row])], names=["term", "sid", "at", "s1", "s2"])

    return texts.select("kind", "text", "sid").mapInArrow(run, "term long, sid long, at long, s1 long, s2 long")


def edit_bound(a: Column, b: Column) -> Column:
    return F.floor(F.greatest(a, b) * PERCENT / 100).cast("int")


def near_texts(texts: DataFrame) -> DataFrame:
    """(a_sid, b_sid) of texts of one kind within the edit bound, a text where `is_eval`, b one where `is_train`.

    texts: distinct (kind, text, sid, is_eval, is_train).
    """
    weights = term_weights(texts)
    lists = [inverted_lists(texts.where(side), weights) for side in ("is_eval", "is_train")]
    a, b = (x.select(*[F.col(c).alias(c if c == "term" else f"{p}_{c}") for c in x.columns]) for x, p in zip(lists, "ab", strict=True))
    low = F.lit(LONGEST).cast("long")
    length, pos, span = ({p: f(F.col(f"{p}_at")) for p in "ab"} for f in (lambda at: F.shiftright(at, 2 * PLACE_BITS), lambda at: at.bitwiseAND(low), lambda at: F.shiftright(at, PLACE_BITS).bitwiseAND(low)))
    k = edit_bound(length["a"], length["b"])
    changed = F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1"))) + F.bit_count(F.col("a_s2").bitwiseXOR(F.col("b_s2")))
    placed = (F.greatest(length["a"], length["b"]) >= LONGEST) | ((pos["a"] - k <= pos["b"] + span["b"]) & (pos["b"] - k <= pos["a"] + span["a"]))
    possible = (F.abs(length["a"] - length["b"]) <= k) & placed & (changed <= 4 * k)
    pairs = a.join(b.hint("merge"), (a.term == b.term) & possible).groupBy("a_sid", "b_sid").agg(F.count("*").alias("dot"))
    a_text, b_text = (texts.where(side).select(F.col("sid").alias(f"{p}_sid"), F.col("kind").alias(f"{p}_kind"), F.col("text").alias(f"{p}_text")) for side, p in (("is_eval", "a"), ("is_train", "b")))
    both = pairs.join(a_text, "a_sid").join(b_text, "b_sid").where("a_kind = b_kind")
    bound = "cast(floor(greatest(length(a_text), length(b_text)) * 15 / 100) as int)"
    return both.where(F.expr(f"levenshtein(a_text, b_text, {bound}) >= 0")).select("a_sid", "b_sid", F.col("a_kind").alias("kind"))


def records(examples: DataFrame, competitive: DataFrame) -> DataFrame:
    """(kind, text, sid, is_train, eval_set, key, source): texts long enough of records that belong to a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, readings = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            made = [("reading", k, forms.comparison(t)) for k, t in enumerate(readings)] + [("signs", k, forms.sign_string(t)) for k, t in enumerate(signs)]
            made = [(kind, k, t) for kind, k, t in made if len(t) >= LEAST_LENGTH[kind]]
            at = pa.array([k for _, k, _ in made], pa.int64())
            yield pa.record_batch([pa.array([m[0] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string()), *(batch.column(c).take(at) for c in (0, 1, 2))], names=["kind", "text", "eval_set", "key", "source"])

    e = examples.where("split in ('train', 'validation', 'test') and id is not null").select(F.col("split").alias("eval_set"), F.col("id").cast("string").alias("key"), "source", "hieroglyphs", "transliteration_gold")
    c = competitive.where("benchmark_id is not null").select(F.lit("competitive"), F.col("benchmark_id").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), "expected_transliteration")
    return e.unionAll(c).mapInArrow(run, "kind string, text string, eval_set string, key string, source string").withColumn("sid", F.xxhash64("kind", "text")).withColumn("is_train", F.col("eval_set") == "train")


def overlaps(examples: DataFrame, competitive: DataFrame) -> DataFrame:
    """(eval_set, eval_key, train_id, kind, source): overlaps of evaluation records with train examples, one row a kind.

    Copies share one text in the join and are put back at the end, each with its own key. Rows without a split, with
    null ids or with short, empty or null texts overlap nothing. Memory: nothing but the 4 MB of weights is held.
    """
    members = checkpoint(records(examples, competitive))
    texts = members.groupBy("kind", "text", "sid").agg(F.max(~F.col("is_train")).alias("is_eval"), F.max("is_train").alias("is_train"))
    near = checkpoint(near_texts(checkpoint(texts)))
    evals = members.where("not is_train").select(F.col("sid").alias("a_sid"), "eval_set", F.col("key").alias("eval_key"))
    train = members.where("is_train").select(F.col("sid").alias("b_sid"), F.col("key").cast("long").alias("train_id"), "source")
    # Rows that find no pair leave before the lookups, in which the members of a hot text are spread over salts.
    evals = evals.join(near.select("a_sid").distinct(), "a_sid", "left_semi")
    train = train.join(near.select("b_sid").distinct(), "b_sid", "left_semi")
    found = salted_lookup(evals, near, ["a_sid"], "eval_key")
    return salted_lookup(train, found, ["b_sid"], "train_id").select("eval_set", "eval_key", "train_id", "kind", "source")


def overlap_report(found: DataFrame) -> DataFrame:
    """(eval_set, source, kind, pairs, eval_records, train_records) from `overlaps`; source is that of the train record."""
    return found.groupBy("eval_set", "source", "kind").agg(F.count("*").alias("pairs"), F.countDistinct("eval_key").alias("eval_records"), F.countDistinct("train_id").alias("train_records"))
