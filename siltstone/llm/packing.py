"""Texts packed into containers of a fixed number of tokens.

Method: Martello-Toth dominance reduction, then best fit.  Token counts are whole
numbers up to the capacity, so the whole instance is a *histogram*: how many items
there are of each size.  The reduction works on it in bulk.  Taking the largest open
size, it fixes a small set for good when no other set with that item could do better:

* no other open item fits beside it: it stays alone;
* one item fills it exactly, no two others fit beside it, or at most two do and no pair
  outweighs the largest single partner: with that partner;
* at most two fit, and no two items above the smaller of a pair with the largest
  partner fit together: with that pair.

A fixed set is applied as often as its sizes allow.  When nothing dominates any more,
the largest size is placed by best fit, again in bulk, and the rest is reduced
further.  Dominance speaks of a container of the item's own, so an item that a begun
container still takes is placed by best fit and never reduced.  As best fit is no
exact method, the reduced plan could still need more containers than best fit on the
whole instance would; both are made and the smaller one is used.

Scale: the driver sees the histogram only, at most ``capacity`` + 1 rows whatever the
corpus holds, and the plan it makes has few patterns, each with the number of
containers that repeat it; the plan is bounded by the sizes and goes to every task.
Documents are ranked among those of their size in two steps over (size, salt): each
group is numbered alone and the groups' starts are running sums kept as a table.  The
number of salts follows the number of documents, so a size that holds a third of them
falls into groups of about ``GROUP`` rows.

Defined results for odd input: a null text or size counts as empty; empty texts have size 0
and go to a container of their own kind, number -1, taking no room; a text above the
capacity is cut into full containers and one remainder, which is packed as an item;
ties are broken by a hash of the id and the id; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose count is remembered by a task before it starts over; has no effect on results.
REMEMBERED = 400_000
#: Rows of one size that are numbered together, about.
GROUP = 250_000


# --- sizes in tokens -----------------------------------------------------------------------


class TokenCounter:
    """Tokens of a text under a byte-pair vocabulary, each different word encoded once.

    The vocabulary's pattern never joins what stands before a single space to what
    follows it when that is no white space, so a text may be cut there.
    """

    def __init__(self, vocabulary: str | bytes) -> None:
        import tiktoken

        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as file:
                vocabulary = file.read()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
        # fixed value: the pattern that belongs to this vocabulary
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        known, total = self.known, 0
        held = first  # what may still be joined to the next piece
        for piece in rest:
            if not piece or piece[0].isspace():
                held += " " + piece
                continue
            n = known.get(held)
            total += self._learn(held) if n is None else n
            held = " " + piece
        return total + (known.get(held) or self._learn(held))

    def _learn(self, piece: str) -> int:
        n = len(self.encode(piece)) if piece else 0
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = n
        return n


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens); null texts count 0.  The vocabulary is read here and goes to the tasks, whose machines need no copy."""
    with open(vocabulary, "rb") as lines:
        shared = documents.sparkSession.sparkContext.broadcast(lines.read())  # bounded: the vocabulary file

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_tokens bigint")


# --- the plan, on the histogram ------------------------------------------------------------


class _Open:
    """The sizes still to be placed, in order, with their counts."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def put(self, size: int) -> None:
        """Gives one item back."""
        if size not in self.count:
            self.count[size] = 0
            bisect.insort(self.sizes, size)
        self.count[size] += 1

    def at_most(self, limit: int) -> int | None:
        """The largest open size not above the limit."""
        i = bisect.bisect_right(self.sizes, limit)
        return self.sizes[i - 1] if i else None


def _dominating(open_: _Open, size: int, room: int) -> tuple[int, ...] | None:
    """The partners of one item of ``size`` in a set that dominates all others with it, if there is one.

    ``room`` is what the item leaves; the item itself is already taken out of ``open_``.
    """
    if not open_.sizes or open_.sizes[0] > room:
        return ()
    best = open_.at_most(room)
    least = [x for x in open_.sizes[:3] for _ in range(min(3, open_.count[x]))][:3]  # the smallest open items
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return (best,)
    if len(least) == 3 and sum(least) <= room:
        return None
    # at most two others fit: the largest single partner wins if it is no smaller than any pair
    fitting = open_.sizes[: bisect.bisect_right(open_.sizes, room - least[0])]
    lo, hi, most = 0, len(fitting) - 1, 0
    while lo <= hi:
        total = fitting[lo] + fitting[hi]
        if total > room or (lo == hi and open_.count[fitting[lo]] < 2):
            hi -= 1
        else:
            most = max(most, total)
            lo += 1
    if best >= most:
        return (best,)
    # a pair with it wins if no two items above the pair's smaller one fit together
    open_.count[best] -= 1
    mate = open_.at_most(room - best)
    while mate is not None and not open_.count[mate]:
        mate = open_.at_most(mate - 1)
    open_.count[best] += 1
    if mate is None:
        return None
    i = bisect.bisect_right(open_.sizes, mate)
    above = [x for x in open_.sizes[i : i + 2] for _ in range(min(2, open_.count[x]))][:2]
    return (best, mate) if len(above) < 2 or sum(above) > room else None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(sizes of one container, number of such containers)] for items of 1..capacity tokens."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes must be from 1 to the capacity")
    return min((_fill(histogram, capacity, reduce) for reduce in (True, False)), key=lambda p: sum(n for _, n in p))


def _fill(histogram: dict[int, int], capacity: int, reduce: bool) -> list[tuple[tuple[int, ...], int]]:
    """The plan by best fit of decreasing sizes, with or without the reduction in front of each new container."""
    open_ = _Open(histogram)
    done: list[tuple[tuple[int, ...], int]] = []
    begun: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left -> containers
    rooms: list[int] = []

    def begin(sizes: tuple[int, ...], n: int) -> None:
        room = capacity - sum(sizes)
        if not room:
            done.append((sizes, n))
        elif room in begun:
            begun[room].append((sizes, n))
        else:
            begun[room] = [(sizes, n)]
            bisect.insort(rooms, room)

    while open_.sizes:
        size = open_.sizes[-1]
        n = open_.count[size]
        i = bisect.bisect_left(rooms, size)
        if i < len(rooms):  # the begun container with the least room that still takes the size
            room = rooms[i]
            sizes, m = begun[room].pop()
            if not begun[room]:
                del begun[room]
                rooms.pop(i)
            # while the size fits, the container that just took it stays the one with the least room
            per = min(room // size, n)
            k = min(m, n // per)
            if m > k:
                begin(sizes, m - k)
            open_.take(size, k * per)
            begin((*sizes, *(size,) * per), k)
            continue
        if reduce:
            open_.take(size, 1)
            partners = _dominating(open_, size, capacity - size)
            if partners is not None:
                # the same set stays dominating while its sizes last and nothing larger opens
                need: dict[int, int] = {}
                for p in partners:
                    need[p] = need.get(p, 0) + 1
                times = n
                for p, k in need.items():
                    times = min(times, n // (k + 1)) if p == size else min(times, open_.count[p] // k)
                times = max(1, times)
                if times > 1:
                    open_.take(size, times - 1)
                for p, k in need.items():
                    open_.take(p, k * times)
                done.append(((size, *partners), times))
                continue
            open_.put(size)
        # as many of the size as one container takes, so equal items fill up together
        per = min(capacity // size, n)
        k = n // per
        open_.take(size, k * per)
        begin((size,) * per, k)
    return done + [x for v in begun.values() for x in v]


# --- containers of documents ---------------------------------------------------------------


_PLACED = "doc_id bigint, piece_no int, first_token bigint, n_tokens bigint, container_id bigint"


def pack(sizes: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, container_id) of every piece of every document.

    ``sizes``: doc_id, n_tokens.  A document up to the capacity is one piece and stays
    whole; a larger one has full pieces in containers of their own before its remainder.
    """
    spark = sizes.sparkSession
    items = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    items = items.withColumn("full", F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity))
    items = items.select("doc_id", "full", (F.col("n_tokens") - F.col("full") * capacity).cast("int").alias("item"))
    items = materialize(items)  # counted once, read for the histogram and for the containers
    # at most capacity + 1 rows, whatever the corpus holds
    counts = items.groupBy("item").agg(F.count("*").alias("n"), F.sum("full").alias("n_full")).orderBy("item").collect()
    histogram, full_starts, full_start = {}, {}, 0
    for r in counts:
        histogram[r["item"]], full_starts[r["item"]] = r["n"], full_start
        full_start += r["n_full"]
    salts = 1 + sum(histogram.values()) // group
    histogram.pop(0, None)
    used: dict[int, int] = {}
    slots, container = [], full_start  # full pieces take the first containers
    for pattern, times in plan(histogram, capacity):
        for s, k in Counter(pattern).items():
            slots.append((s, used.get(s, 0), k, container))
            used[s] = used.get(s, 0) + k * times
        container += times
    shared = spark.sparkContext.broadcast((np.array(sorted(slots), np.int64).reshape(-1, 4), full_starts))  # bounded by the sizes
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("item").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("item", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    starts = starts.select("item", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("full_start"))
    within = Window.partitionBy("item", "salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    ranked = salted.select("doc_id", "full", "item", "salt", (F.row_number().over(within) - 1).alias("rank"), F.coalesce(F.sum("full").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_at"))
    ranked = ranked.join(starts, ["item", "salt"]).select("doc_id", F.col("full").cast("bigint"), F.col("item").cast("bigint"), (F.col("rank") + F.col("start")).cast("bigint"), (F.col("full_at") + F.col("full_start")).cast("bigint"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, full_starts = shared.value
        first_full = np.zeros(capacity + 1, np.int64)
        first_full[list(full_starts)] = list(full_starts.values())
        keys = (slots[:, 0] << 44) + slots[:, 1]
        for batch in batches:
            full, item, rank, full_at = (c.to_numpy() for c in batch.columns[1:])
            at = np.maximum(np.searchsorted(keys, (item << 44) + rank, side="right") - 1, 0)
            _, lo, per, first = slots[at].T if len(slots) else np.ones((4, len(item)), np.int64)
            last = np.where(item == 0, -1, first + (rank - lo) // per)
            # the full pieces of each document, then what remains of it
            n = full + 1
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            whole = piece < full[row]
            columns = [
                batch.column(0).take(pa.array(row)),
                pa.array(piece.astype(np.int32)),
                pa.array(piece * capacity),
                pa.array(np.where(whole, capacity, item[row])),
                pa.array(np.where(whole, first_full[item[row]] + full_at[row] + piece, last[row])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece_no", "first_token", "n_tokens", "container_id"])

    return ranked.mapInArrow(place, _PLACED)
