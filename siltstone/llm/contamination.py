"""Evaluation passages that leaked into training text.

Method: an FM-index per training shard.  A shard's words are mapped to the ids of the
words that occur in any passage; stretches of fewer than ``least`` such words cannot
hold a passage's ``least`` consecutive words and are left out (exact: every word of a
match is a passage word), each kept stretch is closed by a separator.  The rest is
sorted into a suffix array, its Burrows-Wheeler transform goes into a wavelet matrix,
and all distinct phrases of ``least`` words are searched backwards at once through
its ranks.  Occurrences are located by walking back to sampled suffix positions and
overlapping ones merge into the spans to remove.

Scale: shards are built inside the tasks that scan the corpus, so the corpus is read
once and never shuffled; a shard holds at most ``SHARD_WORDS`` kept words and texts of
``SHARD_CHARS`` characters (or one longer text), so memory does not depend on the corpus
or on how often one passage was copied.  The passages are a stated query set: they are
searched in blocks of at most ``BLOCK_WORDS`` words (or one longer passage), one pass over
the corpus for each block.  A full block is searched, its spans written to the shared
folder and its broadcast let go before the next passage is read, so neither the driver
nor a task ever holds more than one block, however many passages there are.

Defined results for odd input: null and empty texts and passages match nothing;
passages under ``least`` words cannot match; repeated documents are each reported;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.words import word_spans, words
from siltstone.session import materialize

LEAST_WORDS = 12
SHARD_WORDS = 2_000_000
SHARD_CHARS = 32_000_000
BLOCK_WORDS = 500_000
SAMPLE_EVERY = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers by prefix doubling; only unresolved suffixes are sorted again."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    ordered = text[sa]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(n), 0))
    k = 1
    while True:
        heads = rank[sa]
        same = np.r_[heads[1:] == heads[:-1], False]
        open_at = np.flatnonzero(same | np.r_[False, same[:-1]])
        if not len(open_at):
            return sa
        s = sa[open_at]
        tail = np.where(s + k < n, rank[np.minimum(s + k, n - 1)], -1)
        order = np.lexsort((tail, heads[open_at]))
        s, tail, head = s[order], tail[order], heads[open_at][order]
        sa[open_at] = s
        new = np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]
        rank[s] = np.maximum.accumulate(np.where(new, open_at, 0))
        k *= 2


class FmIndex:
    """Backward search and location over a sequence of ids >= 1; 0 is the separator."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = SAMPLE_EVERY) -> None:
        t = np.append(text.astype(np.int64) + 1, 0)  # 0 ends the text, 1 separates
        self.n, self.every = len(t), every
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma + 2))])
        self.bits, self.zeros = [], []
        level = bwt
        for b in range(int(sigma + 1).bit_length() - 1, -1, -1):
            bit = (level >> b) & 1
            self.bits.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        kept = sa % every == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.samples = kept, sa[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs in the first i symbols of the transform, for arrays of c and i."""
        lo, hi = np.zeros_like(i), i
        top = len(self.bits) - 1
        for d, (ones, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            bit = (c >> (top - d)) & 1
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(bit == 1, zeros + lo1, lo - lo1), np.where(bit == 1, zeros + hi1, hi - hi1)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi) of each phrase (a row of ids) that occurs."""
        alive = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k].astype(np.int64) + 1
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            found = lo < hi
            alive, lo, hi = alive[found], lo[found], hi[found]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array, by walking back to sampled ones."""
        out, steps, at, open_at = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(open_at):
            done = self.kept[at]
            out[open_at[done]] = self.samples[self.kept_rank[at[done]]] + steps
            at, open_at = at[~done], open_at[~done]
            c = self.bwt[at]
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


class _Phrases:
    """The distinct phrases of a block of passages, and the items each belongs to."""

    def __init__(self, passages: list[tuple[int, list[str]]], least: int) -> None:
        self.least = least
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in passages for w in ws}))}
        grams, owners = [], []
        for item, ws in passages:
            v = np.array([self.ids[w] for w in ws], np.int32)
            if len(v) >= least:
                g = np.lib.stride_tricks.sliding_window_view(v, least)
                grams.append(g)
                owners.append(np.full(len(g), item, np.int64))
        flat = np.concatenate(grams) if grams else np.empty((0, least), np.int32)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        self.phrases, inverse = np.unique(flat, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.reshape(-1), owner], 1), axis=0) if len(owner) else np.empty((0, 2), np.int64)
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(self.phrases) + 1))
        self.items = pairs[:, 1]


def _runs(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``least`` non-zero ids."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


def _search_shard(known: _Phrases | SimpleNamespace, shard: list[tuple[int, str, list[np.ndarray], np.ndarray]]) -> list[tuple]:
    """shard: (doc_id, text, the ids of its stretches, their first words); gives (doc_id, item_id, first word, words, char start, char end)."""
    pieces, doc_of, start_of, begin_of, at = [], [], [], [], 0
    for d, (_, _, stretches, starts) in enumerate(shard):
        for ids, s in zip(stretches, starts.tolist(), strict=True):
            pieces += [ids, np.zeros(1, ids.dtype)]
            doc_of.append(d), start_of.append(s), begin_of.append(at)
            at += len(ids) + 1
    index = FmIndex(np.concatenate(pieces), len(known.ids))
    phrase, lo, hi = index.search(known.phrases)
    count = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    position, phrase = index.locate(rows), np.repeat(phrase, count)
    run = np.searchsorted(np.array(begin_of), position, side="right") - 1
    doc, word = np.array(doc_of, np.int64)[run], position - np.array(begin_of)[run] + np.array(start_of)[run]
    n_items = known.start[phrase + 1] - known.start[phrase]
    item = known.items[np.repeat(known.start[phrase] - np.concatenate([[0], np.cumsum(n_items)[:-1]]), n_items) + np.arange(n_items.sum())]
    doc, word = np.repeat(doc, n_items), np.repeat(word, n_items)
    if not len(doc):
        return []
    order = np.lexsort((word, item, doc))
    doc, item, word = doc[order], item[order], word[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + known.least)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    out, spans, held = [], None, -1
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        doc_id, text, *_ = shard[doc[f]]
        if held != doc[f]:
            spans, held = word_spans(text), doc[f]
        s, n = int(word[f]), int(word[e] - word[f]) + known.least
        out.append((doc_id, int(item[f]), s, n, spans[s][0], spans[s + n - 1][1]))
    return out


_SCHEMA = "doc_id bigint, item_id bigint, first_word int, n_words int, char_start int, char_end int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())])


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The merged spans of each document that hold at least ``least`` consecutive words of a passage.

    ``documents``: doc_id, text; ``items``: item_id, passage; further columns are ignored.
    One row per (document, item, span): word and code-point positions in the text.
    """
    spark = documents.sparkSession

    def one_block(passages: list[tuple[int, list[str]]], last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(vars(_Phrases(passages, least)))  # bounded by block_words

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = SimpleNamespace(**shared.value)
            get = known.ids.get
            shard, kept, chars = [], 0, 0
            flush = lambda s: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if (rows := _search_shard(known, s)) else None
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ws = words(text)
                    if len(ws) < least:
                        continue
                    ids = np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))
                    a, b = _runs(ids, least)
                    if len(a):  # only the stretches are kept of the ids
                        shard.append((doc_id, text, [ids[s:e].copy() for s, e in zip(a.tolist(), b.tolist(), strict=True)], a))
                        kept += int((b - a).sum())
                        chars += len(text)
                        if kept >= shard_words or chars >= shard_chars:
                            if out := flush(shard):
                                yield out
                            shard, kept, chars = [], 0, 0
            if shard and (out := flush(shard)):
                yield out

        found = documents.select("doc_id", "text").where("text is not null").mapInArrow(scan, _SCHEMA)
        if not last:
            found = materialize(found)
            shared.destroy()
        return found

    results: list[DataFrame] = []
    held: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.select("item_id", "passage").where("passage is not null").toLocalIterator():
        ws = words(row["passage"])
        if len(ws) < least:
            continue
        if held and size + len(ws) > block_words:
            results.append(one_block(held, False))
            held, size = [], 0
        held.append((row["item_id"], ws))
        size += len(ws)
    return reduce(DataFrame.unionByName, [*results, one_block(held, True)])


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(item_id, doc_id) of every document that holds at least ``least`` consecutive words of the item's passage."""
    return leaked_spans(documents, items, least).select("item_id", "doc_id").distinct()
