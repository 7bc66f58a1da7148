"""One spelling for what looks the same.

A vocabulary of canonical spellings is held as a trie. A token is read by an automaton that walks the trie: an edit
that can't be seen (a look-alike, a compatibility form, a mark written apart, a code point that shows nothing) weighs
nothing, any other edit weighs one, and only walks of weight nothing are kept. A token that ends on a spelling gets
it; any other is normalised by the table. The vocabulary is bounded (`VOCABULARY` most frequent spellings, a documented
parameter) and thus small enough to send to every task; the table covers all the rest, so the bound loses nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import forms

VOCABULARY = 20_000
_BLANK = re.compile(r"(\s+)")


class SpellingTrie:
    def __init__(self, spellings: list[str]) -> None:
        self.root: dict = {}
        for word in spellings:
            node = self.root
            for ch in unicodedata.normalize("NFD", word):
                node = node.setdefault(ch, {})
            node[""] = word
        self.steps: dict[str, tuple[str, ...]] = {}

    def _step(self, ch: str) -> str:
        """What a code point shows, with marks apart."""
        if (out := self.steps.get(ch)) is None:
            self.steps[ch] = out = unicodedata.normalize("NFD", forms.folded(ch))
        return out

    def spelling(self, token: str) -> str | None:
        """The canonical spelling that looks like the token, or None.

        A state is a node and, after an i, the node before it: a mark that turns i into yod leads on from there.
        """
        node, before, capital = self.root, None, False
        for ch in token:
            if ch in forms.YOD_MARKS and before is not None:
                node, before = before.get("Ꞽ" if capital else "ꞽ"), None
                if node is None:
                    return None
                continue
            for shown in self._step(ch):
                before, capital = (node, shown == "I") if shown in "iI" else (None, False)
                node = node.get(shown)
                if node is None and before is None:
                    return None
                if node is None:
                    node = {}
        return node.get("")


def vocabulary(texts: DataFrame, column: str, size: int = VOCABULARY) -> list[str]:
    """The most frequent tokens already in consistent form, `size` at most, in order of spelling.

    Tokens are cut by frequency band (an eighth of a power of two), and only bands that fit as a whole are taken, so
    the driver gets a row a band and the vocabulary itself, however many tasks there are.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for token in (text or "").split():
                    seen[token] = seen.get(token, 0) + 1
            kept = [t for t in seen if len(t) <= 200 and forms.consistent(t) == t]
            yield pa.record_batch([pa.array(kept, pa.string()), pa.array([seen[t] for t in kept], pa.int64())], names=["token", "n"])

    counted = texts.select(F.col(column).cast("string")).mapInArrow(clean, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    banded = counted.withColumn("band", F.floor(F.log2("n") * 8).cast("int")).persist()
    least, left = None, size
    for r in sorted(banded.groupBy("band").count().collect(), key=lambda r: -r.band):  # at most 512 bands
        left -= r["count"]
        if left < 0:
            break
        least = r.band
    return [] if least is None else sorted(r.token for r in banded.where(F.col("band") >= least).select("token").collect())


def canonical_text(text: str | None, trie: SpellingTrie, known: dict[str, str]) -> str | None:
    """Every token of a text in its canonical spelling, blanks as the table has them."""
    if text is None or forms._CLEAN.match(text):
        return text
    out = []
    for piece in _BLANK.split(text):
        if not piece or piece.isspace():
            out.append(forms.consistent(piece))
            continue
        if (form := known.get(piece)) is None:
            if len(known) > 200_000:
                known.clear()
            form = trie.spelling(piece) or forms.consistent(piece)
            known[piece] = form
        out.append(form)
    return "".join(out)


def canonical_columns(df: DataFrame, columns: list[str], spellings: list[str]) -> DataFrame:
    """Adds <column>_form, the consistent form of each named column; null stays null, "" stays "".

    No shuffle. The frame may have any other columns but those being added.
    """
    held = df.sparkSession.sparkContext.broadcast(spellings)
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    schema = df.select("*", *[t.alias(f"{c}_form") for c, t in zip(columns, texts, strict=True)]).schema
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = SpellingTrie(held.value), {}
        for batch in batches:
            made = [pa.array([canonical_text(x, trie, known) for x in batch.column(k).to_pylist()], pa.string()) for k in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def same_looking(annotations: DataFrame, examples: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(example_id, annotation_id): annotations written with other characters than their example, yet looking the same.

    Null or blank transliterations, and annotations without an example, give no row; an annotation sent twice has two
    ids and gives two. A hot example is split by the adaptive skew join, whose other side has one row an id.
    """
    spellings = vocabulary(examples.select(F.col("transliteration_gold").alias("t")).unionAll(annotations.select("transliteration")), "t", size)
    a = annotations.select(F.col("example_id"), F.col("id").alias("annotation_id"), F.col("transliteration").alias("typed")).where(F.col("typed").rlike(r"(?U)\S"))
    e = examples.select(F.col("id").alias("example_id"), F.col("transliteration_gold").alias("gold")).where(F.col("gold").isNotNull())
    pairs = a.join(e, "example_id").where(F.col("typed") != F.col("gold"))
    return canonical_columns(pairs, ["typed", "gold"], spellings).where(F.col("typed_form") == F.col("gold_form")).select("example_id", "annotation_id")
