"""Pages that are mostly repeated keywords, links or product tags instead of sentences.

A page is cut into chunks (lines, long lines into runs of words). Each chunk is measured: share of link text, share of
tags, share of function words of the page's language, share of words and of word pairs that the page repeats, density
of separators; each page besides: top-word share, duplicate-line share. Function-word thresholds are calibrated per
language from the distribution over all pages. A chunk is spam by its links, by its tags, or if it lacks function words
while it is made of words that the page repeats; a page is a case if its spam chunks hold most of its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = {
    "en": "the a an of in on at by to for from with and or but is are was were be been it its this that these those which who what as if than then so not no he she they we i you his her their our my has have had do does did will would can could may one near while although because since after before under over beside still".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird werden in im an am auf aus bei mit nach von vom zu zum zur für über unter neben vor es er sie wir ich ihr sein seine nicht kein keine als wie wenn da dass daß so auch noch nur hat haben ob weil während obwohl einmal".split(),
    "fr": "le la les l un une des du de d et ou mais est sont était été dans en sur sous au aux par pour avec sans ce cette ces qui que qu il elle ils nous je vous son sa ses leur ne pas plus à se s on si comme où y bien car tout toute lorsque parce chaque fut".split(),
}
_FW = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_URL = re.compile(r"(?:https?://|www\.)[^\s<>)\"']+")
_MARKDOWN = re.compile(r"\[([^\[\]\n]{0,200})\]\(([^()\s]{0,500})\)")
_ANCHOR = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.S | re.I)
_LABELLED = re.compile(r"[^\n]{0,80}?(?:->|=>|:|–|-|\|)\s*(?:https?://|www\.)\S+")
_TAG = re.compile(r"<[^<>]{0,500}>")
_HASH = re.compile(r"#[^\W_]\w*")
_CODE = re.compile(r"\b[A-Z]{2,5}-\d{3,}\b|\b\d+[.,]\d\d\b")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_SENTENCE_END = re.compile(r"[.!?:;]")
_PLAIN = re.compile(r"[a-zäöüßàâçéèêëîïôûùüÿœæ'’]+\Z")
SEPARATORS = "|,;•·*>:/#-–"
CHUNK_WORDS = 30
#: Pages of fewer words repeat a word or pair if they have it twice, longer ones if three times; their keyword chunks
#: must be plain words but for this share.
SHORT_PAGE, SHORT_PLAIN_SHARE = 150, 0.85
#: A function word between two pairs that make up this share of a page, in a chunk without a sentence end, belongs to a keyword.
HEAVY_PAIR = 0.03
# Thresholds: of chunks, as shares.
LINK_SHARE, TAG_SHARE, CODE_SHARE, PLAIN_SHARE, REPEATED_SHARE, SPAM_SHARE = 0.5, 0.4, 0.12, 0.6, 0.6, 0.5
#: A chunk lacks function words below this part of the median share of its language's pages; below the second part
#: where both its words and its pairs of words repeat, as some keywords hold a function word.
LACKING, LACKING_PAIRS = 0.4, 0.8
#: Separators a word, and the least repetition, by which a chunk without function words is a list of keywords.
SEPARATED, LISTED_SHARE = 0.15, 0.2


def language_of(n: Counter, given: str | None) -> str:
    """The language with the most function words among a page's word counts; the given one on a tie or without any."""
    given = (given or "").strip().lower()[:2]
    hits = {k: sum(map(n.__getitem__, n.keys() & fw)) for k, fw in _FW.items()}
    best = max(hits.values())
    return given if given in hits and hits[given] == best else max(hits, key=lambda k: hits[k]) if best else (given if given in hits else "en")


class _Plain(dict):
    """Whether a word is plain, by word."""

    def __missing__(self, word: str) -> bool:
        self[word] = known = _PLAIN.match(word) is not None
        return known


_plain_words = _Plain()
# What a word of a page is, as a byte: a function word, plain or not; plain and often on the page, or not so often.
_FUNCTION, _PLAIN_FUNCTION, _SELDOM, _OFTEN = 1, 2, 3, 4


def _link_share(chunk: str, flat: str) -> float:
    """Part of a chunk's characters in links, their anchors and the labels before them."""
    marked = sum(len(t) for t in chunk.split(" ") if t.startswith("\x02"))
    if "://" in flat or "www." in flat:
        if _URL.search(flat):
            marked = max(marked, sum(m.end() - m.start() for m in _LABELLED.finditer(flat)), sum(m.end() - m.start() for m in _URL.finditer(flat)))
    return min(marked / max(len(flat.strip()), 1), 1.0)


def page_measures(text: str | None, given: str | None = None) -> tuple[str, dict, list[tuple]]:
    """(language, measures of the page, chunks); a chunk is (characters, link share, tag share, code share,
    separators a word (where function words lack), function-word share, plain-word share, share of repeated words, share of repeated pairs, words)."""
    raw = text or ""
    if "&" in raw:
        raw = html.unescape(raw)
    links = "://" in raw or "www." in raw
    marked = raw
    if "<" in raw:
        marked = _ANCHOR.sub(lambda m: " \x02" + re.sub(r"\s+", "\x03", m[1]) + " ", marked)
        marked = _TAG.sub(" ", marked)
    if "](" in raw:
        marked = _MARKDOWN.sub(lambda m: " \x02" + re.sub(r"\s+", "\x03", m[1] + " " + m[2]) + " ", marked)
    parts, lines = [], []
    for line in marked.split("\n"):
        if not line or line.isspace():
            continue
        lines.append(line.strip())
        tokens = line.split(" ")
        step = -(-len(tokens) // max(1, round(len(tokens) / CHUNK_WORDS)))
        parts += [c for k in range(0, len(tokens), step) if (c := " ".join(tokens[k : k + step])) and not c.isspace()]
    words: list[str] = []
    spans = []
    for c in parts:
        flat = c.replace("\x02", " ").replace("\x03", " ") if "\x02" in c else c
        own = _WORD.findall((_URL.sub(" ", flat) if links else flat).lower())
        spans.append((c, flat, len(words), len(words) + len(own)))
        words += own
    count, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    lang = language_of(count, given)
    fw, n = _FW[lang], len(words)
    few = 2 if n < SHORT_PAGE else 3
    least = max(few, 0.006 * n)
    often = {w for w, c in count.items() if c >= least and w not in fw}
    if len(_plain_words) > 500_000:
        _plain_words.clear()
    known = _plain_words
    kind = {w: (_PLAIN_FUNCTION if known[w] else _FUNCTION) if w in fw else (_OFTEN if w in often else _SELDOM) if known[w] else 0 for w in count}
    kinds = bytes(map(kind.__getitem__, words))
    again = {p for p, c in pairs.items() if c >= few}
    repeats = bytes(map(again.__contains__, zip(words, words[1:], strict=False)))
    most = max(3, HEAVY_PAIR * n)
    heavy = {p for p in again if pairs[p] >= most}
    page = {
        "words": n,
        "function_words": (kinds.count(_FUNCTION) + kinds.count(_PLAIN_FUNCTION)) / max(n, 1),
        "top_word": max((count[w] for w in often), default=0) / max(n, 1),
        "top_pair": max(pairs.values(), default=0) / max(n, 1),
        "duplicate_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "separators": sum(raw.count(ch) for ch in SEPARATORS) / max(n, 1),
    }
    codes = _CODE.search(raw) is not None
    chunks = []
    for c, flat, a, b in spans:
        k = max(b - a, 1)
        own = kinds[a:b]
        plain_functions, seldom, frequent = own.count(_PLAIN_FUNCTION), own.count(_SELDOM), own.count(_OFTEN)
        functions = own.count(_FUNCTION) + plain_functions
        if heavy and functions and not _SENTENCE_END.search(_URL.sub(" ", flat) if links else flat):
            functions -= sum(1 for i in range(max(a, 1), min(b, n - 1)) if kinds[i] in (_FUNCTION, _PLAIN_FUNCTION) and (words[i - 1], words[i]) in heavy and (words[i], words[i + 1]) in heavy)
        tokens = flat.count(" ") + 1
        chunks.append((
            len(flat.strip()), _link_share(c, flat) if links or "\x02" in c else 0.0, len(_HASH.findall(flat)) / tokens if "#" in flat else 0.0, len(_CODE.findall(flat)) / tokens if codes else 0.0,
            sum(map(flat.count, SEPARATORS)) / k if functions < LACKING * k else 0.0,
            functions / k, (plain_functions + seldom + frequent) / k, frequent / max(seldom + frequent, 1), repeats[a : max(b - 1, a)].count(1) / max(k - 1, 1), float(b - a),
        ))
    return lang, page, chunks


def spam_shares(chunks: list[tuple], usual: float) -> tuple[float, float, float]:
    """Shares of the page's text in link chunks, tag chunks and keyword chunks; usual: the language's function-word share."""
    total = sum(c[0] for c in chunks) or 1
    least_plain = SHORT_PLAIN_SHARE if sum(c[9] for c in chunks) < SHORT_PAGE else PLAIN_SHARE
    links = tags = words = 0
    for size, link, tag, code, separators, fw, plain, repeated, pair, _ in chunks:
        if link >= LINK_SHARE:
            links += size
        elif tag >= TAG_SHARE or (code >= CODE_SHARE and fw < LACKING * 1.5 * usual):
            tags += size
        elif plain >= least_plain and fw < LACKING_PAIRS * usual:
            lacking = fw < LACKING * usual
            listed = lacking and separators >= SEPARATED and min(repeated, pair) >= LISTED_SHARE
            words += size * (listed or (max if lacking else min)(repeated, pair) >= REPEATED_SHARE)
    return links / total, tags / total, words / total


CHUNK_MEASURES = 10
PAGE = "top_word top_pair duplicate_lines separators".split()


def page_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, function_words, the PAGE measures, chunks) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page_measures(t, g) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            chunks = pa.array([[x for c in m[2] for x in c] for m in made], pa.list_(pa.float32()))
            yield pa.record_batch([batch.column(0), pa.array([m[0] for m in made], pa.string()), *(pa.array([m[1][k] for m in made], pa.float64()) for k in ["function_words", *PAGE]), chunks], names=["doc_id", "lang", "function_words", *PAGE, "chunks"])

    columns = "".join(f", {k} double" for k in PAGE)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, f"doc_id long, lang string, function_words double{columns}, chunks array<float>")


def page_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, link_share, tag_share, keyword_share, the PAGE measures, is_spam) for every page.

    The languages' median function-word shares (a row a language) are computed over all pages first. Null and empty
    texts have all shares 0 and are no cases. A page given twice comes out twice; an empty table gives no rows.
    """
    rows = page_rows(docs).persist()
    usual = {r.lang: r.m for r in rows.where("size(chunks) > 0").groupBy("lang").agg(F.percentile_approx("function_words", 0.5, 1000).alias("m")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for lang, flat in zip(batch.column("lang").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                shares.append(spam_shares([tuple(flat[k : k + CHUNK_MEASURES]) for k in range(0, len(flat), CHUNK_MEASURES)], usual.get(lang, 0.0)))
            kept = [batch.column(k) for k in ["doc_id", "lang"]]
            made = [pa.array([s[k] for s in shares], pa.float64()) for k in range(3)]
            spam = pa.array([sum(s) > SPAM_SHARE for s in shares], pa.bool_())
            yield pa.RecordBatch.from_arrays([*kept, *made, *(batch.column(k) for k in PAGE), spam], names=["doc_id", "lang", "link_share", "tag_share", "keyword_share", *PAGE, "is_spam"])

    columns = "".join(f", {k} double" for k in ["link_share", "tag_share", "keyword_share", *PAGE])
    return rows.mapInArrow(run, f"doc_id long, lang string{columns}, is_spam boolean")
