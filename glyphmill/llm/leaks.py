"""Held-out test items in a training corpus, whole or in part, also with other numbers, names or units.

Words become templates in two ways. In a plain template numbers and units are typed placeholders; the type depends on
the word alone, so equal passages have equal plain templates however they are written. In a name template words with a
capital are placeholders too. Each window of 13 words of a template is hashed. Documents are read once a block of items:
windows without a foreign word are hashed and looked up among the items' windows. For each window found, equal words
mean a leak; else the words that are no slots must be equal, and the slots must map one to one from the item's values to
the document's to count as re-parameterised. Slots are the item's numbers, units and names; which capitals are names is
told from all items: a name never stands in small letters, nor, in German, which writes nouns with capitals, behind a
determiner. What comes out for an item and a document depends on nothing else.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Words of the items that go to every task at a time (about 100 bytes a word); more items are more blocks. Items beyond
#: PIECE words are cut into pieces that overlap by a window.
BLOCK_WORDS, PIECE = 500_000, 50_000
# Units of measure in the languages of the corpus.
UNITS = {"mm", "cm", "m", "km", "g", "kg", "mg", "t", "l", "ml", "cubit", "cubits", "palm", "palms", "jar", "jars", "krüge", "krügen", "elle", "ellen", "cruche", "cruches", "jarres", "coudée", "coudées", "deben", "hekat", "percent", "prozent", "years", "year", "jahr", "jahre", "jahren", "an", "ans", "année", "années"}
# German determiners, contracted prepositions among them, behind which a capital marks a noun.
DETERMINERS = set("der die das dem den des ein eine einen einem einer eines kein keine keinen keinem keiner keines dieser diese dieses diesem diesen jeder jede jedes jedem jeden mein meine meines meinem meinen meiner sein seine seines seinem seinen seiner ihr ihre ihres ihrem ihren ihrer unser unsere unseres unserem unseren am im zum zur vom beim ans ins".split())
NUMBER, UNIT, NAME, FOREIGN = 1, 2, 3, 0
_TAG = re.compile(r"<[^<>]{0,500}>")
_WORD = re.compile(r"[^\W_]+")
_NOTHING = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_B = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words as written, composed; markup, punctuation, line breaks and invisible characters don't count."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _NOTHING.sub("", text))
    return _WORD.findall(text)


def plain(word: str) -> str:
    low = word.lower()
    return low if low.isascii() else unicodedata.normalize("NFC", low)


def typed(word: str, low: str, number: int) -> tuple[int, int, int]:
    """(the word's number, its place in a plain template, its place in a name template)."""
    kind = NUMBER if any(c.isdigit() for c in low) else UNIT if low in UNITS else number
    return number, kind, NAME if kind == number and word[0].isupper() else kind


def letter_cases(text: str | None, lang: str | None) -> tuple[set[str], set[str]]:
    """(words with a capital inside a sentence, words that are no names) of an item."""
    capital, other, before, two = set(), set(), "", ("", "")
    clean = unicodedata.normalize("NFC", _NOTHING.sub("", html.unescape(_TAG.sub(" ", text or ""))))
    for m in _WORD.finditer(clean):
        word, low = m[0], plain(m[0])
        if word[0].islower():
            other.add(low)
        elif word[0].isupper() and before and before not in ".!?\n":
            capital.add(low)
            if (lang or "").strip().lower()[:2] == "de" and (two[1] in DETERMINERS or (two[0] in DETERMINERS and two[1].islower())):
                other.add(low)
        before, two = clean[m.end() : m.end() + 1], (two[1], word)
    return capital, other


def item_names(items: DataFrame) -> DataFrame:
    """(word): the names of all items, a row a word; partial sets are made a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capital, other = set(), set()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c, o = letter_cases(text, lang)
                capital |= c
                other |= o
            words = sorted(capital | other)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([w in other for w in words], pa.bool_())], names=["word", "other"])

    seen = items.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, other boolean")
    return seen.groupBy("word").agg(F.max("other").alias("other")).where("not other").select("word")


def item_pieces(items: DataFrame, piece: int = PIECE) -> DataFrame:
    """(item_id, words) of the items in pieces of `piece` words and a window's overlap; no window is lost or twice there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                cuts = [words[k : k + piece + WINDOW - 1] for k in range(0, len(words) - WINDOW + 1, piece)]
                if cuts:
                    yield pa.record_batch([pa.array([i] * len(cuts), pa.int64()), pa.array(cuts, pa.list_(pa.string()))], names=["item_id", "words"])

    return items.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, words array<string>")


class Templates:
    """A block of items: their words by number, and the hashes of their windows in both kinds of template, in order."""

    def __init__(self, pieces: list[tuple[int, list[str]]], names: set[str]) -> None:
        self.number: dict[str, int] = {}
        codes, owner = [], []
        for item, words in pieces:
            for word in words:
                low = plain(word)
                codes.append(typed(word, low, self.number.setdefault(low, len(self.number) + 4)))
                owner.append(item)
            codes.append((FOREIGN,) * 3)
            owner.append(item)
        self.codes, self.owner = np.array(codes, np.int64).reshape(-1, 3), np.array(owner, np.int64)
        self.words = {n: w for w, n in self.number.items()}
        named = np.zeros(len(self.number) + 4, bool)
        named[[n for w, n in self.number.items() if w in names]] = True
        self.slot = (self.codes[:, 1] <= UNIT) | named[self.codes[:, 0]]
        self.windows = []
        for kind in (1, 2):
            at, hashes = window_hashes(self.codes[:, kind])
            order = np.argsort(hashes, kind="stable")
            self.windows.append((hashes[order], at[order]))

    def code(self, word: str) -> tuple[int, int, int]:
        """As `typed`, for a word as a document has it."""
        low = plain(word)
        return typed(word, low, self.number.get(low, FOREIGN))


def window_hashes(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window of WINDOW words none of which is foreign."""
    n = len(kinds) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    foreign = np.concatenate([[0], np.cumsum(kinds == FOREIGN)])
    at = np.flatnonzero(foreign[WINDOW:] == foreign[:n])
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = (h ^ (kinds[at + k].astype(np.uint64) + np.uint64(1))) * _B
            h ^= h >> np.uint64(29)
    return at, h


def consistent_slots(item: list[str], document: list[str]) -> bool:
    """Values of the slots map one to one from item to document."""
    there, back = {}, {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(item, document, strict=True))


def template_hits(docs: DataFrame, templates: Templates) -> DataFrame:
    """(item_id, doc_id, exact_windows, slot_windows): windows that a document shares with an item, with equal words, or
    with other values in consistently filled slots."""
    held = docs.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        known, made = {"": 0}, [(FOREIGN,) * 3]  # words met by number, and what they are
        span = np.arange(WINDOW)
        for batch in batches:
            if len(known) > 500_000:
                known, made = {"": 0}, made[:1]
            ids, numbers, texts, starts = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                starts.append(len(numbers))
                for w in words:
                    if (c := known.get(w)) is None:
                        known[w] = c = len(made)
                        made.append(t.code(w))
                    numbers.append(c)
                numbers.append(0)
                texts.append(words)
            code, start = np.array(made, np.int64)[np.array(numbers, np.int64)], np.array(starts, np.int64)
            found: dict[tuple[int, int], list[int]] = {}
            for kind, (hashes, places) in zip((1, 2), t.windows, strict=True):
                at, h = window_hashes(code[:, kind])
                low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                some = np.flatnonzero(high > low)
                count = (high - low)[some]
                ends = np.cumsum(count)
                total = int(ends[-1]) if len(ends) else 0
                for a in range(0, total, 100_000):
                    k = np.arange(a, min(a + 100_000, total))
                    own = np.searchsorted(ends, k, "right")
                    d, e = at[some[own]], places[low[some[own]] + k - ends[own] + count[own]]
                    dc, ec = code[d[:, None] + span], t.codes[e[:, None] + span]
                    slot = t.slot[e[:, None] + span]
                    equal = dc[:, :, 0] == ec[:, :, 0]
                    exact = (equal & (dc[:, :, 0] != FOREIGN)).all(1)
                    other = (dc[:, :, kind] == ec[:, :, kind]).all(1) & (equal | slot).all(1) & ~exact & (slot.sum(1) <= WINDOW - WINDOW // 2)
                    if kind == 2:  # what plain templates find isn't counted again
                        exact[:] = False
                        other &= (dc[:, :, 1] != ec[:, :, 1]).any(1)
                    doc, item = np.searchsorted(start, d, "right") - 1, t.owner[e]
                    for j in np.flatnonzero(exact):
                        found.setdefault((int(item[j]), int(doc[j])), [0, 0])[0] += 1
                    for j in np.flatnonzero(other):
                        words, offset, slots = texts[doc[j]], int(d[j] - start[doc[j]]), np.flatnonzero(slot[j])
                        if consistent_slots([t.words[int(ec[j, s, 0])] for s in slots], [plain(words[offset + s]) for s in slots]):
                            found.setdefault((int(item[j]), int(doc[j])), [0, 0])[1] += 1
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([ids[k] for _, k in found], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["item_id", "doc_id", "exact_windows", "slot_windows"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").mapInArrow(run, "item_id long, doc_id long, exact_windows long, slot_windows long")


def leaked_items(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS, piece: int = PIECE) -> DataFrame:
    """(item_id, doc_id, exact_windows, slot_windows) for documents that share a window with an item.

    Null and empty texts share nothing; items of fewer than 13 words can't be found; the windows of a document given
    twice are summed. Items beyond `block_words` words go through the documents in blocks, each a scan of its own, with the same
    result: windows are counted apart and summed, names are told from all items.
    """
    pieces = item_pieces(items, piece).persist()
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    names = item_names(items)
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    out = None
    for b in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item_id", F.size("words"), "words"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.words) for r in own.orderBy("item_id").collect()]
        spoken = docs.sparkSession.createDataFrame([(w,) for w in sorted({plain(w) for _, words in rows for w in words})], "word string")
        known = names.join(F.broadcast(spoken), "word", "left_semi").collect()  # words of one block
        hits = template_hits(docs, Templates(rows, {r.word for r in known}))
        out = hits if out is None else out.unionAll(hits)
    pieces.unpersist()
    return out.groupBy("item_id", "doc_id").agg(F.sum("exact_windows").alias("exact_windows"), F.sum("slot_windows").alias("slot_windows"))
