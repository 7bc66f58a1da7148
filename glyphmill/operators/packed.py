"""Several values packed in one string field: one row a value, with its position.

The scan works on the UTF-8 buffer of a whole Arrow batch: running quote parity and depth, delimiter masks outside
quotes, child offsets from the masks, a list array a row, flattened with parent ordinals. Rows whose quotes don't fit
that grammar (a quote inside a value, or one that is never closed) are read again by `split_scalar`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Separators of values, line breaks that always separate, blanks that separate only where asked.
SEPARATORS = ["|", ";", ",", "/", "·", "•", "；", "，", "、", "｜", "／"]
LINE_BREAKS = ["\t", "\n", "\r", "\v", "\f", "\u0085", " ", " "]
BLANKS = [" ", " ", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", "　"]
STRAIGHT, OPEN, CLOSE = '"', "\u201c", "\u201d"


def _marks(blank_separates: bool) -> list[str]:
    """Where blanks separate (id|lemma lists) the bar belongs to the value."""
    kept = [s for s in SEPARATORS if not (blank_separates and s in "|\uff5c")]
    return kept + LINE_BREAKS + (BLANKS if blank_separates else [])


def split_scalar(text: str | None, blank_separates: bool = False) -> list[str]:
    """The values of one string; the plain form of the grammar.

    A quote opens only at the start of a value and closes before a separator or the end; any other quote is an
    ordinary character. None and blank strings have no values.
    """
    s = (text or "").strip()
    if _is_list(s):
        s = s[1:-1]
    marks, out, i = set(_marks(blank_separates)), [], 0
    while i < len(s):
        if s[i] in marks or s[i].isspace():
            i += 1
            continue
        value = None
        if s[i] in (STRAIGHT, OPEN):
            end, found = (STRAIGHT if s[i] == STRAIGHT else CLOSE), i + 1
            while (found := s.find(end, found)) >= 0:
                if end == STRAIGHT and s[found + 1 : found + 2] == STRAIGHT:
                    found += 2
                    continue
                break
            if found >= 0:
                after = s[found + 1 :]
                rest = after if blank_separates else after.lstrip("".join(BLANKS))
                if not rest or rest[0] in marks:
                    value, i = s[i + 1 : found], found + 1
                    if end == STRAIGHT:
                        value = value.replace('""', '"')
        if value is None:
            j = i
            while j < len(s) and s[j] not in marks:
                j += 1
            value, i = s[i:j], j
        if value := value.strip():
            out.append(value)
    return out


def _is_list(s: str) -> bool:
    """Square brackets around the whole, the first closed by the last."""
    if len(s) < 2 or s[0] != "[" or s[-1] != "]":
        return False
    depth, quoted = 0, False
    for k, ch in enumerate(s):
        if ch == STRAIGHT:
            quoted = not quoted
        elif not quoted and ch in "[]":
            depth += 1 if ch == "[" else -1
            if depth == 0 and k < len(s) - 1:
                return False
    return depth == 0


def _find(data: np.ndarray, at: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    """Byte positions of each text's occurrences; `at`: ascending positions of all bytes that may begin one."""
    out, first = [], data[at]
    for t in texts:
        b = t.encode()
        hit = at[first == b[0]]
        if len(b) > 1:
            hit = hit[hit + len(b) <= len(data)]
            for k in range(1, len(b)):
                hit = hit[data[hit + k] == b[k]]
        out.append(hit)
    return out


def split_packed(column: pa.Array, blank_separates: bool = False) -> pa.ListArray:
    """A list of values for each string of an Arrow array; nulls and blank strings give empty lists."""
    column = pc.fill_null(column.cast(pa.string()), "")
    rows = len(column)
    if not rows:
        return pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.string()))
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    marks = _marks(blank_separates)
    begins = np.zeros(256, bool)
    begins[[t.encode()[0] for t in [*marks, STRAIGHT, OPEN]]] = True
    at = np.flatnonzero(begins[data])

    def row_of(pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, pos, "right") - 1

    def since_start(marks_at: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How many marks lie in a position's row before it."""
        return np.searchsorted(marks_at, pos) - np.searchsorted(marks_at, offsets[row_of(pos)])

    straight, opened, closed = _find(data, at, [STRAIGHT, OPEN, CLOSE])
    opened, closed = (x[since_start(straight, x) % 2 == 0] for x in (opened, closed))
    depth = lambda pos: since_start(opened, pos) - since_start(closed, pos)
    odd_rows: set[int] = set()
    for bad in (straight[depth(straight) > 0], opened[depth(opened) != 0], closed[depth(closed) != 1]):
        odd_rows |= set(row_of(bad).tolist())
    per_row = lambda pos: np.diff(np.searchsorted(pos, offsets))
    odd_rows |= set(np.flatnonzero((per_row(straight) % 2 == 1) | (per_row(opened) != per_row(closed))).tolist())

    gone = []
    trimmed = pc.utf8_trim_whitespace(column)
    for r in np.flatnonzero(np.asarray(pc.and_(pc.starts_with(trimmed, "["), pc.ends_with(trimmed, "]")))):
        if _is_list(trimmed[r].as_py()):
            piece = data[offsets[r] : offsets[r + 1]]
            ends = np.flatnonzero((piece == ord("[")) | (piece == ord("]")))[[0, -1]]
            gone.append(offsets[r] + ends)

    ends_at = []
    for text, hit in zip(marks, _find(data, at, marks), strict=True):
        hit = hit[since_start(straight, hit) % 2 == 0]
        if len(opened):
            hit = hit[depth(hit) <= 0]
        ends_at += [hit + k for k in range(len(text.encode()))]
    at = np.sort(np.concatenate(ends_at))
    gone_at = np.sort(np.concatenate([at, *gone]))
    keep = np.ones(len(data), bool)
    keep[gone_at] = False
    start = np.concatenate([offsets[:-1], at + 1])
    parent = np.concatenate([np.arange(rows), row_of(at)])
    order = np.lexsort((start, parent))
    parent, start = parent[order], start[order]
    child_offsets = np.concatenate([start - np.searchsorted(gone_at, start), [keep.sum()]]).astype(np.int32)
    children = pa.Array.from_buffers(pa.string(), len(parent), [None, pa.py_buffer(child_offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    some = np.flatnonzero(np.diff(child_offsets) > 0)
    parent, children = parent[some], pc.utf8_trim_whitespace(children.take(pa.array(some)))
    some = np.flatnonzero(np.asarray(pc.binary_length(children)) > 0)
    parent, children = parent[some], children.take(pa.array(some))

    if len(children) and (len(straight) or len(opened)):
        has = np.flatnonzero(np.asarray(pc.match_substring_regex(children, '["\u201c\u201d]')))
        quoted = children.take(pa.array(has))
        values = quoted.to_pylist()
        for k, v in zip(has, values, strict=True):
            inner = v[1:-1]
            regular = len(v) > 1 and ((v[0] == v[-1] == STRAIGHT and STRAIGHT not in inner.replace('""', "")) or (v[0] == OPEN and v[-1] == CLOSE and not set(inner) & {OPEN, CLOSE, STRAIGHT}))
            if not regular:
                odd_rows.add(parent[k])
        unquoted = [(v[1:-1].replace('""', '"') if v[0] == STRAIGHT and '""' in v else v[1:-1]).strip() if len(v) > 1 else v for v in values]
        mask = np.zeros(len(children), bool)
        mask[has] = True
        children = pc.replace_with_mask(children, pa.array(mask), pa.array(unquoted, pa.string()))
        some = np.flatnonzero(np.asarray(pc.binary_length(children)) > 0)
        parent, children = parent[some], children.take(pa.array(some))

    if odd_rows:
        again = {int(r): split_scalar(column[int(r)].as_py(), blank_separates) for r in odd_rows}
        stay = ~np.isin(parent, list(again))
        parents = np.concatenate([parent[stay], np.repeat(list(again), [len(v) for v in again.values()])]).astype(np.int64)
        values = pa.concat_arrays([children.filter(pa.array(stay)), pa.array([x for v in again.values() for x in v], pa.string())])
        order = np.argsort(parents, kind="stable")
        parent, children = parents[order], values.take(pa.array(order))
    counts = np.bincount(parent, minlength=rows) if len(parent) else np.zeros(rows, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), children)


def explode_packed(df: DataFrame, key: str, field: str, blank_separates: bool = False) -> DataFrame:
    """(row_key, pos, item): every value of `field`, pos counting the values of a row from 1.

    Reads two columns, shuffles nothing and holds one Arrow batch. Null or blank fields give no rows; a null key
    stays null; repeated rows give their values again; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_packed(batch.column(1), blank_separates)
            parents = pc.list_parent_indices(lists)
            p = np.asarray(parents)
            first = np.asarray(lists.offsets)[:-1]
            pos = np.arange(len(p), dtype=np.int64) - first[p] + 1
            yield pa.record_batch([batch.column(0).take(parents), pa.array(pos, pa.int64()), pc.list_flatten(lists)], names=["row_key", "pos", "item"])

    return df.select(df[key].cast("string").alias("row_key"), df[field].cast("string").alias("item")).mapInArrow(run, "row_key string, pos long, item string")
