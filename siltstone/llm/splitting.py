"""Oversized texts cut into pieces under a limit, at natural boundaries, with an overlap.

Method: balanced targets.  The fewest pieces that can hold the text give equally
long pieces; each cut's target is then snapped to the strongest boundary near it
(heading, blank line, line end, end of a sentence, clause, word; inside code fences
line ends only).  If a cut has no boundary of at least a sentence in reach, or some
limit fails, the split is tried again with one more piece, and the best of these
tries is kept.  Where a text never pauses, the cut falls on the target, but never
inside a character with its combining marks or a line end.

Scale: texts within the limit never leave the JVM; the others are split alone, in the
task that scans them, without a shuffle.

Defined results for odd input: null texts have no pieces and are not oversized;
repeated rows are each split; an empty table gives no rows.  Lengths are code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 256

HEADING, BLANK, LINE, SENTENCE, CLAUSE, WORD = 6, 5, 4, 3, 2, 1

_FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
_LINE_END = re.compile(r"\r\n|\r|\n| | |\x85")
_HEADING = re.compile(r"#{1,6}[ \t]")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？｡][」』”’）]*\s*")
_CLAUSE = re.compile(r"[,;:]\s*|[、，；：·|/]\s*|\s[-–—]\s")
_WORD = re.compile(r"\s+")


def body(text: Column, frontmatter: bool) -> Column:
    """The text without blank space at its ends, and without a frontmatter block at its top."""
    edge = r"[\s\p{Z}\x{85}\x{FEFF}]+"
    out = text
    if frontmatter:
        out = F.regexp_replace(out, r"(?s)\A[\s\p{Z}\x{FEFF}]*---[ \t]*\r?\n(?:.*?\r?\n)?---[ \t]*(?:\r?\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(out, rf"\A{edge}", ""), rf"{edge}\z", "")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where the text may be cut, in order, and the strength of each."""
    strength: dict[int, int] = {}

    def put(at: int, value: int) -> None:
        if strength.get(at, 0) < value:
            strength[at] = value

    fences, opened = [], None
    for m in _FENCE.finditer(text):
        if opened is None:
            opened = m.start()
        else:
            fences.append((opened, m.end()))
            opened = None
    if opened is not None:
        fences.append((opened, len(text)))
    for pattern, value in ((_WORD, WORD), (_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE)):
        for m in pattern.finditer(text):
            put(m.end(), value)
    before = 0
    for m in _LINE_END.finditer(text):
        blank = not text[before : m.start()].strip()
        value = HEADING if _HEADING.match(text, m.end()) else BLANK if blank else LINE
        put(m.end(), value)
        before = m.end()
    at = np.array(sorted(strength), np.int64)
    value = np.array([strength[p] for p in at.tolist()], np.int64)
    for a, b in fences:
        inside = (at > a) & (at < b)
        value[inside] = np.where(value[inside] >= LINE, CLAUSE, 0)
    keep = (value > 0) & (at > 0) & (at < len(text))
    return at[keep], value[keep]


def _whole_character(text: str, at: int, least: int) -> int:
    """The nearest place at or before ``at`` that is not inside a character or line end."""
    p = at
    while p > least and (unicodedata.combining(text[p]) or text[p] in "‍︎️" or text[p - 1] == "‍" or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > least else at


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces; piece k + 1 starts ``overlap`` characters before the end of piece k."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    size, step = len(text), limit - overlap
    if size <= limit:
        return [size]
    at, value = boundaries(text)
    fewest = 1 + -(-(size - limit) // step)
    best: tuple[int, list[int]] | None = None
    n = fewest
    while best is None or (best[0] < SENTENCE and n < fewest + 3):  # more pieces until one try fits, then two more for stronger boundaries
        found = _snap(text, n, at, value, limit, overlap)
        if found is not None and (best is None or found[0] > best[0]):
            best = found
        n += 1
    return best[1]


def _snap(text: str, n: int, at: np.ndarray, value: np.ndarray, limit: int, overlap: int) -> tuple[int, list[int]] | None:
    size, step = len(text), limit - overlap
    length = (size + (n - 1) * overlap) / n
    near = max(200.0, 0.2 * length)
    ends: list[int] = []
    weakest, before = HEADING, 0
    for i in range(1, n):
        target = length + (i - 1) * (length - overlap)
        lo = max(before + 1, overlap + 1, size - (n - i) * step)
        hi = min(limit if i == 1 else before - overlap + limit, size - 1)
        if lo > hi:
            return None
        target = min(max(target, lo), hi)
        a, b = np.searchsorted(at, [lo, hi + 1])
        p, v = at[a:b], value[a:b]
        if len(p):
            far = np.abs(p - target)
            close = far <= near
            if not (close & (v >= SENTENCE)).any():
                close[:] = True  # nothing strong nearby: look over all that is in reach
            top = v[close].max()
            pick = np.flatnonzero(close & (v == top))
            k = pick[far[pick].argmin()]
            end, strength = int(p[k]), int(v[k])
        else:
            end, strength = _whole_character(text, int(round(target)), lo - 1), 0
        weakest = min(weakest, strength)
        ends.append(end)
        before = end
    return weakest, [*ends, size]


_SCHEMA = "source_table string, row_id bigint, piece_no int, n_pieces int, char_start bigint, piece string"


def oversized(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source_table, row_id, body) of the rows whose body exceeds the limit."""
    return texts.where(F.length("body") > limit)


def pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every oversized body: number, place and text.  Needs source_table, row_id, body."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for table, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ends = cuts(text, limit, overlap)
                start = 0
                for k, end in enumerate(ends):
                    out.append((table, row, k, len(ends), start, text[start:end]))
                    start = end - overlap
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source_table", "row_id", "piece_no", "n_pieces", "char_start", "piece"])

    return oversized(texts, limit).select("source_table", "row_id", "body").mapInArrow(split, _SCHEMA)
