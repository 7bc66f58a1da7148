"""A count model of readings in context, Viterbi decoding, and a fallback for unattested sign groups.

The model is four count tables. To decode, the readings attested in the context of every place are looked up by joins and
gathered into one row a sentence. The candidates of the sign groups to decode and the counts of steps between them go to
every task as arrays, HELD candidates and twice as many steps at most; a step between two places is made there and shuffled
nowhere. A larger model is looked up by joins alone, where the pairs of neighbouring candidates are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import text as X
from glyphmill.operators.signs import aligned, attestations
from glyphmill.runtime import salted_lookup

SMOOTHING, BOUNDARY = 0.1, "<s>"
#: Candidates that a task may hold (of steps, 12 bytes each, twice as many), bits that tell unknown steps, and known ones kept.
HELD, STEP_BITS, STEPS_KEPT = 8_000_000, 27, 4_000_000
#: Counts of steps that the driver reads at once.
STEPS_AT_ONCE = 1_000_000
#: Attested sign groups that a task compares unseen ones with at a time.
GROUP_BLOCK = 32_768
WEIGHTS = {"transition": 1.0, "emission": 0.6, "left": 0.8, "right": 0.8}


@dataclass(frozen=True)
class ReadingModel:
    emission: DataFrame  # sign, reading, n, first_ord, first_pos
    bigram: DataFrame  # previous_reading, reading, n
    left: DataFrame  # previous_sign, sign, reading, n
    right: DataFrame  # sign, next_sign, reading, n
    pairs: DataFrame  # what was counted

    def groups(self) -> DataFrame:
        """(sign, total, candidates): readings by count, ties by first place."""
        entry = F.struct((-F.col("n")).alias("k"), "first_ord", "first_pos", "reading", "n")
        listed = self.emission.groupBy("sign").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("e"))
        return listed.select("sign", "total", F.transform("e", lambda x: F.struct(x["reading"].alias("reading"), x["n"].alias("n"))).alias("candidates"))

    def ambiguous_signs(self) -> DataFrame:
        return self.emission.groupBy("sign").agg(F.count("*").alias("readings")).where("readings > 1")

    def most_frequent(self) -> DataFrame:
        """(sign, reading, n, total)."""
        return self.groups().select("sign", F.get("candidates", F.lit(0))["reading"].alias("reading"), F.get("candidates", F.lit(0))["n"].alias("n"), "total")


def fit(corpus: DataFrame, **columns: str) -> ReadingModel:
    """Counts over the aligned sentences of a corpus; unaligned, empty and null ones teach nothing."""
    pairs = aligned(corpus, **columns)
    count = lambda *keys: pairs.groupBy(*keys).agg(F.count("*").alias("n"))
    return ReadingModel(attestations(pairs).persist(), count("previous_reading", "reading"), count("previous_sign", "sign", "reading"), count("sign", "next_sign", "reading"), pairs)


def _smoothed(n: Column, total: Column, size: Column) -> Column:
    return F.log((F.coalesce(n, F.lit(0)) + SMOOTHING) / (total + SMOOTHING * F.greatest(size, F.lit(1))))


def _context(table: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Log probabilities of readings in a context, and the value of a reading never seen in it."""
    sums = table.groupBy(*keys).agg(F.sum("n").alias("_t"), F.count("*").alias("_v"))
    unseen = sums.select(*keys, _smoothed(F.lit(0), F.col("_t"), F.col("_v")).alias(f"{name}_unseen"))
    known = table.join(sums, keys).select(*keys, "reading", _smoothed(F.col("n"), F.col("_t"), F.col("_v")).alias(name))
    return known, unseen


def nearest_groups(model: ReadingModel, unseen: DataFrame, block: int = GROUP_BLOCK) -> DataFrame:
    """(sign, group, similarity): for sign groups never attested the attested one with the largest glyph overlap.

    Ties go to the better attested group, then to the smaller one. Groups that share no glyph with any get no row. Many
    groups share a glyph, so no pair is put out: every block of unseen groups meets every block of attested ones in a task.
    """
    glyphs = F.array_distinct(F.filter(F.split("sign", ""), lambda x: x != ""))
    right_rows = model.emission.groupBy("sign").agg(F.sum("n").alias("total")).select("sign", "total", glyphs.alias("g"))
    right = max(1, -(-right_rows.count() // block))
    left = max(1, -(-2 * unseen.sparkSession.sparkContext.defaultParallelism // right))
    part = lambda n: F.pmod(F.xxhash64("sign"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = unseen.select("sign").distinct().select("sign", glyphs.alias("g")).withColumn("i", part(left)).withColumn("j", every(right))
    b = right_rows.withColumn("j", part(right)).withColumn("i", every(left))
    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_block_nearest, "sign string, group string, similarity double, total long")
    best = found.groupBy("sign").agg(F.min(F.struct((-F.col("similarity")).alias("s"), (-F.col("total")).alias("t"), "group")).alias("b"))
    return best.select("sign", F.col("b.group").alias("group"), (-F.col("b.s")).alias("similarity"))


def _block_nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best of the right groups for each of the left ones that shares a glyph with any; both have sign and glyphs g."""
    made: list[tuple] = []
    if left.num_rows and right.num_rows:
        rows = sorted(zip(*(right.column(c).to_pylist() for c in ("sign", "total", "g")), strict=True), key=lambda x: (-x[1], x[0]))
        postings: dict[str, list[int]] = {}
        for k, (_, _, glyphs) in enumerate(rows):
            for glyph in glyphs:
                postings.setdefault(glyph, []).append(k)
        listed, size = {g: np.array(at) for g, at in postings.items()}, np.array([len(g) for _, _, g in rows])
        for sign, glyphs in zip(left.column("sign").to_pylist(), left.column("g").to_pylist(), strict=True):
            if met := [listed[g] for g in glyphs if g in listed]:
                common = np.bincount(np.concatenate(met), minlength=len(rows))
                similarity = common / (len(glyphs) + size - common)
                at = int(similarity.argmax())  # the first of equals
                made.append((sign, rows[at][0], float(similarity[at]), rows[at][1]))
    columns = [list(c) for c in zip(*made, strict=True)] or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["sign", "group", "similarity", "total"])


def decode(model: ReadingModel, sentences: DataFrame, key: str, signs: str, transition: float = 1.0, emission: float = 0.6, left: float = 0.8, right: float = 0.8, use_fallback: bool = True, threshold: float = 0.5, held: int = HELD) -> DataFrame:
    """(key, pos, sign, predicted, candidates, attested_count, is_ambiguous, was_seen, fallback_from, fallback_similarity, confidence).

    The best path through the candidates of every position by the weighted sum of log terms. The next sign is the one
    written, the previous one the group it was resolved to; ties keep the first candidate. A group without candidates
    reads "". Sentences without signs give no rows; keys must be unique. `held`: candidates that a task may hold.
    """
    return decode_all(model, sentences, key, signs, {"predicted": {"transition": transition, "emission": emission, "left": left, "right": right}}, use_fallback, threshold, held)


def decode_all(model: ReadingModel, sentences: DataFrame, key: str, signs: str, weights: dict[str, dict[str, float]], use_fallback: bool = True, threshold: float = 0.5, held: int = HELD) -> DataFrame:
    """`decode` under several weights at once: a column of predictions for each of them, by name."""
    rows = sentences.select(F.col(key).alias("key"), X.blank_split(signs).alias("s")).where("size(s) > 0")
    per_sign = _per_sign(model, rows, use_fallback, threshold).persist()
    steps = model.bigram.select(F.xxhash64("previous_reading").alias("p"), F.xxhash64("reading").alias("r"), "n").persist()
    every = [WEIGHTS | w for w in weights.values()]
    kept = _Held(per_sign) if (per_sign.agg(F.sum(F.size("candidates"))).first()[0] or 0) <= held else None
    fits = kept is not None and kept.learn(steps, 2 * held)
    steps.unpersist()
    if not fits:
        return _decode_by_joins(model, rows, key, per_sign, dict(zip(weights, every, strict=True)))
    model_held = rows.sparkSession.sparkContext.broadcast(kept)
    kind, names = sentences.schema[key].dataType.simpleString(), list(weights)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model_held.value
        for batch in batches:
            made: list[tuple] = []
            for k, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = BOUNDARY
                for i, sign in enumerate(s):
                    if group := known.groups[known.row[sign]]:
                        made += [(k, 2 * i, before, group), (k, 2 * i + 1, group, s[i + 1] if i + 1 < len(s) else BOUNDARY)]
                    before = group or sign
            if made:
                k, place, a, b = zip(*made, strict=True)
                yield pa.record_batch([pa.array(k, batch.schema.field(0).type), pa.array(place, pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["key", "place", "a", "b"])

    # Both contexts of a place are looked up at once; a context is told by the hash of its side and its two signs.
    asked = rows.mapInArrow(ask, f"key {kind}, place int, a string, b string").select("key", "place", F.xxhash64(F.col("place") % 2, "a", "b").alias("h"))
    context = lambda side, a, b: F.xxhash64(F.lit(side), a, b)
    counted = model.pairs.select(F.xxhash64("reading").alias("r"), F.explode(F.array(context(0, "previous_sign", "sign"), context(1, "sign", "next_sign"))).alias("h")).groupBy("h", "r").agg(F.count("*").cast("int").alias("n"))
    contexts = counted.groupBy("h").agg(F.collect_list("r").alias("r"), F.collect_list("n").alias("n"))
    found = asked.join(contexts, "h").groupBy("key").agg(F.collect_list(F.struct("place", "r", "n")).alias("x"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model_held.value
        for batch in batches:
            keys, pos, at, words = [], [], [], [[] for _ in names]
            for k, s, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [known.row[sign] for sign in s]
                for out, path in zip(words, known.paths(own, {e["place"]: (e["r"], e["n"]) for e in x or []}, every), strict=True):
                    out += path
                keys += [k] * len(s)
                pos += range(len(s))
                at += own
            if keys:
                shown = known.shown.take(pa.array(at, pa.int64())).combine_chunks()
                columns = [pa.array(keys, batch.schema.field(0).type), pa.array(pos, pa.int32()), *[pa.array(w, pa.string()) for w in words], *[c.combine_chunks() for c in shown.columns]]
                yield from pa.table(columns, names=["key", "pos", *names, *shown.column_names]).to_batches()

    predicted = ", ".join(f"`{n}` string" for n in names)
    out = rows.join(found, "key", "left").select("key", "s", "x").mapInArrow(read, f"key {kind}, pos int, {predicted}, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in _shown(per_sign).schema)}")
    return out.select(F.col("key").alias(key), "pos", "sign", *names, "candidates", "attested_count", "is_ambiguous", "was_seen", "fallback_from", "fallback_similarity", "confidence")


def _per_sign(model: ReadingModel, rows: DataFrame, use_fallback: bool, threshold: float) -> DataFrame:
    """(sign, group, fallback_from, similarity, was_seen, total, candidates): a row for each sign group to decode."""
    groups = model.groups().persist()
    known = groups.select("sign", F.col("sign").alias("group"))
    resolved = rows.select(F.explode("s").alias("sign")).distinct().join(known, "sign", "left").persist()
    if use_fallback:
        near = nearest_groups(model, resolved.where("group is null").select("sign")).where(F.col("similarity") >= threshold).select("sign", F.col("group").alias("near"), F.col("similarity").alias("near_similarity"))
        resolved = resolved.join(near, "sign", "left").select("sign", F.coalesce("group", "near", F.lit("")).alias("group"), F.when(F.col("group").isNull(), F.coalesce("near", F.lit(""))).otherwise("").alias("fallback_from"), F.when(F.col("group").isNull(), F.coalesce("near_similarity", F.lit(0.0))).otherwise(0.0).alias("similarity"), F.col("group").isNotNull().alias("was_seen"))
    else:
        resolved = resolved.select("sign", F.coalesce("group", F.lit("")).alias("group"), F.lit("").alias("fallback_from"), F.lit(0.0).alias("similarity"), F.col("group").isNotNull().alias("was_seen"))
    return resolved.join(groups.withColumnRenamed("sign", "group"), "group", "left").select("sign", "group", "fallback_from", "similarity", "was_seen", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("candidates", F.array(F.struct(F.lit("").alias("reading"), F.lit(0).cast("long").alias("n")))).alias("candidates"))


def _shown(per_sign: DataFrame) -> DataFrame:
    """What is told of a sign group besides the prediction."""
    shares = F.transform(F.slice(F.filter("candidates", lambda x: x["n"] > 0), 1, 5), lambda x: F.struct(x["reading"].alias("reading"), (x["n"] / F.greatest(F.col("total"), F.lit(1))).alias("share")))
    return per_sign.select("sign", shares.alias("candidates"), F.col("total").alias("attested_count"), (F.size(F.filter("candidates", lambda x: x["n"] > 0)) > 1).alias("is_ambiguous"), "was_seen", "fallback_from", X.python_round(F.col("similarity"), 3).alias("fallback_similarity"), confidence(shares).alias("confidence"))


def _places(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted values stand in ascending hashes; -1 where they don't."""
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, at, -1)


class _Held:
    """Candidates of the sign groups to decode and the counts of steps between their readings, as arrays."""

    def __init__(self, per_sign: DataFrame) -> None:
        listed = per_sign.select("sign", "group", "total", F.col("candidates.reading").alias("reading"), F.transform("candidates", lambda x: F.xxhash64(x["reading"])).alias("h"), F.col("candidates.n").alias("n")).toArrow().combine_chunks()
        self.shown = _shown(per_sign).toArrow().combine_chunks()
        flat = lambda c: listed.column(c).combine_chunks().flatten()
        signs, sizes = listed.column("sign").to_pylist(), np.diff([0, *np.cumsum([len(x) for x in listed.column("n").to_pylist()])])
        self.row, self.groups = {s: k for k, s in enumerate(signs)}, listed.column("group").to_pylist()
        place = {s: k for k, s in enumerate(self.shown.column("sign").to_pylist())}
        self.shown = self.shown.take(pa.array([place[s] for s in signs], pa.int64()))
        self.ends, total = np.append(0, np.cumsum(sizes)).astype(np.int64), np.repeat(np.asarray(listed.column("total")), sizes)
        edge = np.array([per_sign.sparkSession.range(1).select(F.xxhash64(F.lit(BOUNDARY))).first()[0]])
        hashes, n = np.asarray(flat("h")), np.asarray(flat("n"))
        self.hashes, first = np.unique(np.append(hashes, edge), return_index=True)
        strings = [*flat("reading").to_pylist(), BOUNDARY]
        self.readings = [strings[k] for k in first]
        self.codes, self.edge = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, edge)
        self.emission = np.where(total > 0, np.log((n + SMOOTHING) / (total + SMOOTHING * np.maximum(np.repeat(sizes, sizes), 1))), 0.0)
        self.kept: dict = {}
        self.room = STEPS_KEPT

    def learn(self, steps: DataFrame, most: int) -> bool:
        """Takes the counts of steps between the candidates; False where they are more than `most`.

        steps: p and r, the hashes of two readings, and n. Only steps between two candidates are kept. They come in the
        order of their keys, a part at a time, so the driver holds the arrays and one part.
        """
        hashes = self.hashes
        shared = steps.sparkSession.sparkContext.broadcast(hashes)

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p, r = (_places(shared.value, np.asarray(batch.column(k))) for k in range(2))
                both = (p >= 0) & (r >= 0)
                yield pa.record_batch([pa.array(p[both]), pa.array(r[both]), pa.array(np.asarray(batch.column(2))[both].astype(np.int32))], names=["p", "r", "n"])

        coded = steps.select("p", "r", "n").mapInArrow(between, "p long, r long, n int").persist()
        count = coded.count()
        if count > most:
            coded.unpersist()
            return False
        sums = steps.groupBy("p").agg(F.sum("n").alias("t"), F.count("*").alias("v")).toArrow()  # a row a reading
        at = _places(hashes, np.asarray(sums.column("p")))
        own, t, v = at >= 0, np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        t[at[own]], v[at[own]] = (np.asarray(sums.column(c))[own] for c in "tv")
        self.size = t + SMOOTHING * np.maximum(v, 1)
        self.unseen = np.where(v > 0, np.log(SMOOTHING / self.size), np.log(SMOOTHING))
        self.keys, self.counts = np.empty(count, np.int64), np.empty(count, np.int32)
        self.bits = np.zeros(1 << (STEP_BITS - 3), np.uint8)
        parts, end = max(1, -(-count // STEPS_AT_ONCE)), 0
        edges = [len(hashes) * k // parts for k in range(parts + 1)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            table = coded.where((F.col("p") >= lo) & (F.col("p") < hi)).select((F.col("p") * len(hashes) + F.col("r")).alias("k"), "n").toArrow()
            keys = np.asarray(table.column("k"))
            order, span = np.argsort(keys), slice(end, end := end + len(keys))
            self.keys[span], self.counts[span] = keys[order], np.asarray(table.column("n"))[order]
            bit = np.sort(self._bit(keys))
            np.bitwise_or.at(self.bits, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        coded.unpersist()
        return True

    @staticmethod
    def _bit(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - STEP_BITS)).astype(np.int64)

    def _known(self, before: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in a matrix of codes x before, log terms) of the steps that were counted."""
        keys = (before[None, :] * len(self.hashes) + codes[:, None]).ravel()
        bit = self._bit(keys)
        maybe = np.flatnonzero((self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == keys[maybe] if len(self.keys) else np.zeros(0, bool)
        where, at = maybe[hit], at[hit]
        return where, np.log((self.counts[at] + SMOOTHING) / self.size[before[where % len(before)]])

    def _steps(self, before: int, row: int, b_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        entry = self.kept.get((before, row))
        if entry is None:
            entry = self._known(b_codes, codes)
            if self.room < 0:
                self.kept, self.room = {}, STEPS_KEPT
            self.kept[before, row] = entry
            self.room -= len(entry[0]) + 16
        out = np.empty((len(codes), len(b_codes)))
        out[:] = self.unseen[b_codes]
        out.ravel()[entry[0]] = entry[1]
        return out

    def _local(self, found: tuple | None, codes: np.ndarray) -> np.ndarray:
        """Log terms of the candidates in a context."""
        if found is None:
            return np.full(len(codes), np.log(SMOOTHING))
        n = np.array(found[1], float)
        size = n.sum() + SMOOTHING * len(n)
        out = np.full(len(codes), np.log(SMOOTHING / size))
        for code, term in zip(np.searchsorted(self.hashes, found[0]), np.log((n + SMOOTHING) / size), strict=True):
            out[codes == code] = term
        return out

    def paths(self, rows: list[int], found: dict, weights: list[dict[str, float]]) -> list[list[str]]:
        """The readings of the best path through the candidates of the rows, for each of the weights."""
        scores, back = [np.zeros(1) for _ in weights], [[] for _ in weights]
        before, b_codes = -1, self.edge
        for i, row in enumerate(rows):
            span = slice(self.ends[row], self.ends[row + 1])
            codes, left, right = self.codes[span], self._local(found.get(2 * i), self.codes[span]), self._local(found.get(2 * i + 1), self.codes[span])
            steps, every = self._steps(before, row, b_codes, codes), np.arange(len(codes))
            for k, w in enumerate(weights):
                local = w["emission"] * self.emission[span] + w["right"] * right + w["left"] * left
                s = scores[k][None, :] + local[:, None] + w["transition"] * steps
                best = s.argmax(1)
                scores[k] = s[every, best]
                back[k].append(best)
            before, b_codes = row, codes
        out = []
        for score, came in zip(scores, back, strict=True):
            at, words = int(score.argmax()), []
            for row, best in zip(reversed(rows), reversed(came), strict=True):
                words.append(self.readings[self.codes[self.ends[row] + at]])
                at = int(best[at])
            out.append(words[::-1])
        return out


def _decode_by_joins(model: ReadingModel, rows: DataFrame, key: str, per_sign: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """`decode_all` without a part of the model in the tasks; rows: key and the signs s."""
    at = rows.select("key", F.posexplode("s").alias("pos", "sign"), F.col("s"))
    at = at.select("key", "pos", "sign", F.coalesce(F.get("s", F.col("pos") + 1), F.lit(BOUNDARY)).alias("next_sign"))
    places = salted_lookup(at, per_sign, ["sign"], "key").persist()
    before = places.select("key", (F.col("pos") + 1).alias("pos"), F.when(F.col("group") != "", F.col("group")).otherwise(F.col("sign")).alias("previous_sign"), F.col("candidates").alias("previous"))
    steps = places.join(before, ["key", "pos"], "left").withColumns({"previous_sign": F.coalesce("previous_sign", F.lit(BOUNDARY)), "previous": F.coalesce("previous", F.array(F.struct(F.lit(BOUNDARY).alias("reading"), F.lit(0).cast("long").alias("n"))))})
    size = F.size("candidates")
    options = steps.select("key", "pos", "group", "next_sign", "previous_sign", "previous", "total", size.alias("v"), F.posexplode("candidates").alias("c", "o")).select("*", F.col("o.reading").alias("reading"), F.col("o.n").alias("n"))
    l_known, l_unseen = _context(model.left, ["previous_sign", "sign"], "l")
    r_known, r_unseen = _context(model.right, ["sign", "next_sign"], "r")
    b_known, b_unseen = _context(model.bigram, ["previous_reading"], "b")
    as_group = lambda df: df.withColumnRenamed("sign", "group")
    local = options.join(as_group(l_known), ["previous_sign", "group", "reading"], "left").join(as_group(l_unseen), ["previous_sign", "group"], "left")
    local = local.join(as_group(r_known), ["group", "next_sign", "reading"], "left").join(as_group(r_unseen), ["group", "next_sign"], "left")
    floor = F.lit(SMOOTHING)
    e = F.when(F.col("total") > 0, _smoothed(F.col("n"), F.col("total"), F.col("v"))).otherwise(0.0)
    terms, out = local, places.select("key", "pos", "sign", "candidates")
    for name, w in weights.items():
        score = w["emission"] * e + w["right"] * F.coalesce("r", "r_unseen", F.log(floor)) + w["left"] * F.coalesce("l", "l_unseen", F.log(floor))
        local = terms.withColumn("local", score)
        moves = local.select("key", "pos", "c", "reading", "local", F.posexplode("previous").alias("p", "before")).withColumn("previous_reading", F.col("before.reading"))
        moves = moves.join(b_known, ["previous_reading", "reading"], "left").join(b_unseen, ["previous_reading"], "left").withColumn("b", w["transition"] * F.coalesce("b", "b_unseen", F.log(floor)))
        column = moves.groupBy("key", "pos", "c").agg(F.first("local").alias("local"), F.transform(F.array_sort(F.collect_list(F.struct("p", "b"))), lambda x: x["b"]).alias("moves"))
        lattice = column.groupBy("key", "pos").agg(F.array_sort(F.collect_list(F.struct("c", "local", "moves"))).alias("column")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "column"))).alias("lattice"))
        chosen = lattice.select("key", F.posexplode(_best_path(F.to_json("lattice"))).alias("pos", "choice"))
        out = out.join(chosen, ["key", "pos"]).withColumn(name, F.get("candidates", F.col("choice"))["reading"]).drop("choice")
    out = salted_lookup(out.select(F.col("key").alias(key), "pos", "sign", *weights), _shown(per_sign), ["sign"], key)
    return out.select(key, "pos", "sign", *weights, "candidates", "attested_count", "is_ambiguous", "was_seen", "fallback_from", "fallback_similarity", "confidence")


def confidence(shares: Column) -> Column:
    """Share of the first candidate among those shown; 0 without candidates."""
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x["share"])
    return F.when(total > 0, F.get(shares, F.lit(0))["share"] / total).otherwise(0.0)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _best_path(lattice: pd.Series) -> pd.Series:
    import json

    def path(text: str) -> list[int]:
        columns = [c["column"] for c in json.loads(text)]
        scores, back = [], []
        for k, column in enumerate(columns):
            now, came = [], []
            for option in column:
                best, best_at = float("-inf"), 0
                for p, b in enumerate(option["moves"]):
                    s = (scores[p] if k else 0.0) + option["local"] + b
                    if s > best:
                        best, best_at = s, p
                now.append(best)
                came.append(best_at)
            scores = now
            back.append(came)
        at = max(range(len(scores)), key=lambda i: scores[i])
        out = []
        for came in reversed(back):
            out.append(at)
            at = came[at]
        return out[::-1]

    return lattice.map(path)


def decode_summary(predictions: DataFrame, key: str) -> DataFrame:
    """(key, reading, ambiguous, fallbacks, unreadable): the chosen sentence and what is unsure in it."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "predicted"))), lambda x: x["predicted"])
    return predictions.groupBy(key).agg(F.array_join(F.filter(words, lambda x: x != ""), " ").alias("reading"), F.count_if("is_ambiguous").alias("ambiguous"), F.count_if(F.col("fallback_from") != "").alias("fallbacks"), F.count_if(F.col("predicted") == "").alias("unreadable"))


def evaluate(corpus: DataFrame, key: str = "id", every: int = 5, exclude_duplicates: bool = False, **options: float) -> DataFrame:
    """One row of accuracy figures: every fifth aligned sentence is held out, by the hash of its key.

    A deterministic hash split stands in for the position in the file, which Spark doesn't keep.
    """
    sentences = corpus.select(F.col(key).alias("key"), X.squeeze("hieroglyphs_norm").alias("s"), X.squeeze("transliteration_gold").alias("t")).where(F.size(X.blank_split("s")) == F.size(X.blank_split("t"))).where("s <> ''").persist()
    held_out = F.pmod(F.xxhash64("key"), F.lit(every)) == 0
    train, test = sentences.where(~held_out), sentences.where(held_out)
    known = train.select("s").distinct()
    leaked = test.join(known, "s", "left_semi")
    if exclude_duplicates:
        test = test.join(known, "s", "left_anti")
    names = {"signs": "s", "readings": "t", "order": "key"}
    model = fit(train, **names)
    gold = test.select("key", F.posexplode(X.blank_split("t")).alias("pos", "gold"))
    own = {k: v for k, v in options.items() if k in WEIGHTS}
    both = decode_all(model, test, "key", "s", {"predicted": own, "left_only": own | {"right": 0.0}}, **{k: v for k, v in options.items() if k not in WEIGHTS})
    base = model.most_frequent().select("sign", F.col("reading").alias("base"))
    rows = both.join(gold, ["key", "pos"]).join(base, "sign", "left")
    seen, amb, fallback = F.col("was_seen"), F.col("was_seen") & F.col("is_ambiguous"), ~F.col("was_seen") & (F.col("fallback_from") != "")
    right = lambda c: F.coalesce(F.col(c), F.lit("")) == F.col("gold")
    rate = lambda hit, of: F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    everything = F.lit(True)
    out = rows.agg(
        F.count("*").alias("test_sign_instances"), F.count_if(~seen).alias("unseen_signs"), rate(~seen, everything).alias("unseen_share"), F.count_if(amb).alias("ambiguous_instances"), rate(amb, seen).alias("ambiguous_share_of_seen"),
        rate(right("base"), seen).alias("acc_all_most_frequent"), rate(right("predicted"), seen).alias("acc_all_context"), rate(right("base"), amb).alias("acc_ambiguous_most_frequent"), rate(right("left_only"), amb).alias("acc_ambiguous_left_only"), rate(right("predicted"), amb).alias("acc_ambiguous_context"),
        F.count_if(fallback).alias("fallback_predictions"), rate(fallback, ~seen).alias("fallback_share_of_unseen"), rate(right("predicted"), fallback).alias("acc_fallback"), rate(seen, everything).alias("coverage_before_fallback"), rate(seen | fallback, everything).alias("coverage_with_fallback"),
    )
    sizes = sentences.agg(F.count("*").alias("corpus_sentences"), F.count_if(~held_out).alias("train_sentences"), F.count_if(held_out).alias("held_out_sentences")).first().asDict()
    counts = sizes | {"ambiguous_sign_types": model.ambiguous_signs().count(), "duplicate_test_sentences": leaked.count()}
    gains = {"ambiguous_gain": "acc_ambiguous_most_frequent", "right_context_gain": "acc_ambiguous_left_only"}
    return out.select(*[F.lit(v).alias(k) for k, v in counts.items()], "*", *[(F.col("acc_ambiguous_context") - F.col(c)).alias(k) for k, c in gains.items()])


def size_sweep(corpus: DataFrame, sizes: list[int | None], key: str = "id", **options: object) -> DataFrame:
    """`evaluate` on the first `n` sentences by key for each size, None for all; each size is a query of its own.

    Each is run before the next one is planned, so the driver holds one model and one plan at a time.
    """
    rows, schema = [], None
    for n in sizes:
        part = evaluate(corpus if n is None else corpus.orderBy(key).limit(n), key, **options)
        rows += part.collect()  # a row a size
        schema = part.schema
    return corpus.sparkSession.createDataFrame(rows, schema)
