"""Filling packs of fixed capacity with texts measured in tokens of a public tokenizer.

Texts are counted once, without a shuffle. The counts are dealt to shards by the hash of the id; in a shard a
bounded-space online best fit fills the packs of every capacity: a fixed number of packs is open, their free spaces
are the bits of one integer, a text goes into the open pack with the least space that holds it, and where none does
the fullest pack closes for a new one. A text is cut only if it alone exceeds the capacity: into whole packs and a
rest that is packed as any text. What stays unused at the end of a shard is at most the open packs.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.runtime import checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN_PACKS, TEXTS_A_SHARD = 256, 20_000
PIECE = 100_000
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, once a process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a whole text, 0 for None. A run without white space of over PIECE characters is counted in pieces."""
    if not text:
        return 0
    enc = encoder(path)
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text) and (blank := text.rfind(" ", at + 1, end)) > at:
            end = blank
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(docs: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([count_tokens(t, path) for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "n_tokens"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long")


class BestFit:
    """Open packs of one capacity; `place` gives the number of the pack that takes a size."""

    def __init__(self, capacity: int, most: int = OPEN_PACKS) -> None:
        self.capacity, self.most = capacity, most
        self.free = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = self.packs = 0

    def _take(self, space: int) -> int:
        packs = self.by_free[space]
        pack = packs.pop()
        if not packs:
            self.free &= ~(1 << space)
        self.open -= 1
        return pack

    def _keep(self, pack: int, space: int) -> None:
        if space:
            self.by_free.setdefault(space, []).append(pack)
            self.free |= 1 << space
            self.open += 1

    def place(self, size: int) -> int:
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            pack = self._take(space)
        else:
            if self.open >= self.most:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
            pack, space = self.packs, self.capacity
            self.packs += 1
        self._keep(pack, space - size)
        return pack


def pack_texts(counts: DataFrame, sizes: list[tuple[str, int]], open_packs: int = OPEN_PACKS, texts_a_shard: int = TEXTS_A_SHARD) -> DataFrame:
    """(pack_name, pack_id, id, piece, start_token, n_tokens): every piece of every text for every capacity.

    pack_id is unique within pack_name. Texts without tokens (null or empty) get one row with a null pack_id, as do all
    texts for a capacity below 1; a row given twice is packed twice; an empty table gives no rows.
    """
    shards = max(1, -(-counts.count() // texts_a_shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        fits = [(name, capacity, BestFit(capacity, open_packs) if capacity > 0 else None) for name, capacity in sizes]
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, capacity, fit in fits:
                pack, who, piece, start, size = [], [], [], [], []
                for i, n in zip(ids, lengths, strict=True):
                    if not n or fit is None:
                        pack.append(None), who.append(i), piece.append(0), start.append(0), size.append(n or 0)
                        continue
                    for k in range(-(-n // capacity)):
                        part = min(capacity, n - k * capacity)
                        pack.append(base + fit.place(part)), who.append(i), piece.append(k), start.append(k * capacity), size.append(part)
                yield pa.record_batch([pa.array([name] * len(who), pa.string()), pa.array(pack, pa.int64()), pa.array(who, pa.int64()), pa.array(piece, pa.int32()), pa.array(np.array(start, np.int64)), pa.array(np.array(size, np.int64))], names=["pack_name", "pack_id", "id", "piece", "start_token", "n_tokens"])

    dealt = counts.repartition(shards, F.xxhash64("id")).sortWithinPartitions("id", "n_tokens")
    return dealt.mapInArrow(run, "pack_name string, pack_id long, id long, piece int, start_token long, n_tokens long")


def pack_documents(docs: DataFrame, pack_sizes: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Packs of the documents table for each row of pack_sizes, a few rows by definition."""
    sizes = [(r.pack_name, int(r.capacity)) for r in pack_sizes.select("pack_name", "capacity").where("capacity is not null").orderBy("pack_name").collect()]
    packed = pack_texts(checkpoint(token_counts(docs, "doc_id", "text", path)), sizes)
    return packed.withColumnRenamed("id", "doc_id")


def pack_fill(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(pack_name, capacity, packs, tokens, fill): how full the packs of each capacity are."""
    used = packed.where("pack_id is not null").groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("n"))
    total = used.groupBy("pack_name").agg(F.count("*").alias("packs"), F.sum("n").alias("tokens"))
    return total.join(pack_sizes.select("pack_name", F.col("capacity").cast("long").alias("capacity")), "pack_name").select("pack_name", "capacity", "packs", "tokens", (F.col("tokens") / (F.col("packs") * F.col("capacity"))).alias("fill"))
