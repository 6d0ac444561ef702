"""Texts that share most of their word sequences, grouped.

Method: signature trees.  Each text is the set of its sequences of ``width`` words.
Nodes of a tree hold the OR of the token bitmaps below them and the range of their
sizes (and, because tokens are hashed into the bitmap, also the AND: a bit that every
text of one node has and no text of the other can be shared by none).  Two trees are
traversed together from their roots and a pair of nodes is dropped as soon as the
largest overlap that its sizes and bitmaps allow is below what the threshold asks.
Surviving pairs of texts are checked exactly.

Scale: one tree over everything would put OR-ed bitmaps near the root that prune
nothing, so trees are built per *prefix token*: sequences are ordered by rarity, and
two texts above the threshold must share one of the rarest few of each (sequences
found in one text only are skipped, they match nothing).  Each node also knows how
many sequences its texts have from the token on: if it is the first that two texts
share they can share no more than that, and if it is not they met before.  This
bound alone ends the traversal at the root for a token that very many texts hold but
that few of them could be alike by.  Small trees, which are nearly all, are traversed
together, array by array.  Texts with equal sets are one class, so a group of copies
is a single member whatever its size.  Groups above ``BLOCK`` are cut into blocks by
size, by what is left from the token on and by min-hash; the blocks' own bitmaps and
ranges are traversed first, and only pairs of blocks that survive meet, each in a task
of its own.

Defined results for odd input: null texts and texts under ``width`` words have no
sequences and resemble nothing; repeated rows of one key collapse; ties do not arise
(similarity is exact); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.components import connected_components
from siltstone.session import materialize

WIDTH, THRESHOLD = 3, 0.5
#: Bits of a text's bitmap; they travel as whole numbers of 64 bits.
BITS = 512
WORDS = BITS // 64
LEAF, FANOUT, BLOCK = 32, 8, 4096
#: Groups up to this size are trees of one leaf level and are traversed together.
SMALL = 64
#: Node pairs looked at in one step of a traversal.
STEP = 100_000

_WORD = re.compile(r"[^\W_]+")
_known: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word; words are lower-cased runs of letters and digits."""
    if len(_known) > 400_000:  # words are remembered; forgetting them changes no result
        _known.clear()
    out = []
    for w in _WORD.findall(text.lower()):
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, np.uint64)


def sequences(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words."""
    words = word_hashes(text or "")
    n = max(len(words) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def text_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, id, number, grams) of each text with a sequence: the name of its set, a short form of it, and the set.

    ``texts``: key, text.  128 bits of hash and the size name a set.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, numbers, sets = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                grams = sequences(text, width)
                if len(grams):
                    digest = xxhash.xxh3_128(grams.tobytes())
                    at.append(i), sets.append(grams)
                    names.append(f"{digest.hexdigest()}-{len(grams)}")
                    numbers.append(int.from_bytes(digest.digest()[:8], "big", signed=True))
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["key", "id", "number", "grams"],
            )

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(scan, f"key {kind}, id string, number bigint, grams array<bigint>")


# --- trees ---------------------------------------------------------------------------------


class _Level:
    """Nodes of one level: OR and AND of the bitmaps, least size, most tokens shared with any text and most from the group's token on."""

    def __init__(self, any_: np.ndarray, all_: np.ndarray, lo: np.ndarray, shared: np.ndarray, rest: np.ndarray) -> None:
        self.any, self.all, self.lo, self.shared, self.rest = any_, all_, lo, shared, rest

    def above(self, fanout: int) -> _Level:
        cut = np.arange(0, len(self.lo), fanout)
        most = np.maximum.reduceat
        return _Level(np.bitwise_or.reduceat(self.any, cut), np.bitwise_and.reduceat(self.all, cut), np.minimum.reduceat(self.lo, cut), most(self.shared, cut), most(self.rest, cut))

    def possible(self, a: np.ndarray, other: _Level, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether some text below a and some text below b may reach the threshold and meet first in this group."""
        need = threshold / (1 + threshold) * (self.lo[a] + other.lo[b]) - 1e-9
        # no text is alike to one of another size by more than the smaller
        keep = np.flatnonzero(np.minimum(np.minimum(self.rest[a], other.rest[b]), np.minimum(self.shared[a], other.shared[b])) >= need)
        x, y = a[keep], b[keep]
        most = np.minimum(
            self.shared[x] - np.bitwise_count(self.all[x] & ~other.any[y]).sum(1, dtype=np.int64),
            other.shared[y] - np.bitwise_count(other.all[y] & ~self.any[x]).sum(1, dtype=np.int64),
        )
        out = np.zeros(len(a), bool)
        out[keep[most >= need[keep]]] = True
        return out


def _tree(texts: _Level) -> list[_Level]:
    """Levels from the texts up to the root; a parent's children are consecutive."""
    levels = [texts]
    fanout = LEAF
    while len(levels[-1].lo) > 1:
        levels.append(levels[-1].above(fanout))
        fanout = FANOUT
    return levels


def dual_traversal(one: list[_Level], two: list[_Level], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts (positions) that the two trees cannot rule out; ``same``: one tree with itself, a < b."""
    height = max(len(one), len(two))
    one = one + [one[-1]] * (height - len(one))  # roots repeat, so both trees are equally high
    two = two + [two[-1]] * (height - len(two))
    todo = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > STEP:
            todo += [(level, a[i : i + STEP], b[i : i + STEP]) for i in range(0, len(a), STEP)]
            continue
        if same:
            keep = (a <= b) if level else (a < b)
            a, b = a[keep], b[keep]
        keep = one[level].possible(a, two[level], b, threshold)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            left.append(a), right.append(b)
            continue
        children = lambda levels, x: _children(levels, level, x)
        (fa, na), (fb, nb) = children(one, a), children(two, b)
        count = na * nb
        pair = np.repeat(np.arange(len(a)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        todo.append((level - 1, fa[pair] + k // nb[pair], fb[pair] + k % nb[pair]))
    return np.concatenate(left), np.concatenate(right)


def _children(levels: list[_Level], level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of each node."""
    if levels[level] is levels[level - 1]:
        return nodes, np.ones_like(nodes)
    fanout = LEAF if level == 1 else FANOUT
    return nodes * fanout, np.minimum(fanout, len(levels[level - 1].lo) - nodes * fanout)


# --- rows for the trees --------------------------------------------------------------------

_MAPS = [f"b{k}" for k in range(WORDS)]
_PREFIX = "token bigint, id bigint, n int, shared int, rest int, short boolean, least bigint, freq bigint, " + ", ".join(f"{b} bigint" for b in _MAPS)


def _prefix_rows(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's prefix tokens with what the trees hold of the text, and whether the token is in the shorter prefix.

    In: id, n, and the (freq, gram) of the tokens that other texts have too; those that no
    other has come first in the order and are only counted.  The shorter prefix is enough
    for the smaller text of a pair.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            flat = lists.flatten()
            freq, gram = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            shared = np.asarray(lists.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(n)), shared)
            order = np.lexsort((gram, freq, row))
            freq, gram = freq[order], gram[order]
            rest = np.repeat(np.cumsum(shared), shared) - np.arange(len(row))  # tokens from this one on
            place = n[row] - rest
            h = gram.view(np.uint64)
            bit = (h >> np.uint64(20)) % np.uint64(BITS)
            maps = np.zeros((len(n), WORDS), np.uint64)
            np.bitwise_or.at(maps, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            least = np.zeros(len(n), np.uint64)
            some = np.flatnonzero(shared)
            if len(some):
                least[some] = np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), (np.cumsum(shared) - shared)[some])
            whole = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            short = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
            keep = np.flatnonzero(place < whole[row])
            r = row[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram[keep]), pa.array(ids[r]), pa.array(n[r].astype(np.int32)), pa.array(shared[r].astype(np.int32)), pa.array(rest[keep].astype(np.int32)),
                    pa.array(place[keep] < short[r]), pa.array(least[r].view(np.int64)), pa.array(freq[keep]), *[pa.array(maps[r, k].view(np.int64)) for k in range(WORDS)],
                ],
                names=["token", "id", "n", "shared", "rest", "short", "least", "freq", *_MAPS],
            )

    return rows


class _Rows:
    """Rows of groups, column by column: token, one, two, side, id, n, shared, rest, short, then the bitmap's words."""

    def __init__(self, columns: list[np.ndarray]) -> None:
        self.columns = columns

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Rows:
        return _Rows([c.to_numpy(zero_copy_only=False) for c in batch.columns])

    def __len__(self) -> int:
        return len(self.columns[0])

    def at(self, where: np.ndarray | slice) -> _Rows:
        return _Rows([c[where] for c in self.columns])

    def after(self, other: _Rows) -> _Rows:
        return _Rows([np.concatenate(c) for c in zip(other.columns, self.columns, strict=True)]) if len(other) else self

    def group_starts(self, keys: int) -> np.ndarray:
        new = np.zeros(len(self), bool)
        new[:1] = True
        for c in self.columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def level(self) -> _Level:
        n, shared, rest = (c.astype(np.int64) for c in self.columns[5:8])
        maps = np.stack(self.columns[9:], 1).view(np.uint64)
        return _Level(maps, maps, n, shared, rest)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[_Rows]:
    """The rows of clustered batches in parts that end where a group ends."""
    held: _Rows | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _Rows.of(batch)
        rows = rows if held is None else rows.after(held)
        last = int(rows.group_starts(keys)[-1])
        if last:
            yield rows.at(slice(0, last))
        held = rows.at(slice(last, None))
    if held is not None and len(held):
        yield held


def _group_pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of each group (token, block pair); rows come clustered by group."""

    def settle(rows: _Rows, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the smaller text has to be met in its shorter prefix
        ids, n, short = rows.columns[4], rows.columns[5], rows.columns[8]
        ok = np.where(n[a] < n[b], short[a], np.where(n[a] > n[b], short[b], short[a] & short[b]))
        one, two = ids[a[ok]], ids[b[ok]]
        return np.minimum(one, two), np.maximum(one, two)

    def small(rows: _Rows, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of one leaf level, all pairs of leaves at once."""
        level = rows.level()
        first = np.concatenate([np.arange(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]) if len(starts) else np.empty(0, np.int64)
        many = np.repeat(ends, ends - starts) - first - 1
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + 1, STEP * 4))
        for lo, hi in zip(cuts, [*cuts[1:], len(first)], strict=True):
            f, m = first[lo:hi], many[lo:hi]
            a = np.repeat(f, m)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            ok = level.possible(a, level, b, threshold)
            yield settle(rows, a[ok], b[ok])

    def large(rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """One group by its tree, or two blocks by theirs."""
        side, n = rows.columns[3], rows.columns[5]
        same = bool((side == 2).all())  # the block meets itself
        order = np.lexsort((rows.columns[9], n))
        parts = [order] if same else [order[side[order] == 0], order[side[order] == 1]]
        if not all(map(len, parts)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        trees = [_tree(rows.at(p).level()) for p in parts]
        a, b = dual_traversal(trees[0], trees[-1], threshold, same)
        return settle(rows, parts[0][a], parts[-1][b])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 3):
            starts = rows.group_starts(3)
            ends = np.append(starts[1:], len(rows))
            single = (ends - starts <= SMALL) & (rows.columns[3][starts] == 2)
            found = list(small(rows, starts[single], ends[single]))
            found += [large(rows.at(slice(s, e))) for s, e in zip(starts[~single].tolist(), ends[~single].tolist(), strict=True)]
            for one, two in found:
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["id_a", "id_b"])

    return pairs


def _block_pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(token, one, two) of the blocks that may hold a pair; one row per block comes in, clustered by token.

    In: token, block, least n, most shared, most rest, the words of the OR, the words of the AND.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 1):
            starts = rows.group_starts(1)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                c = rows.at(slice(s, e)).columns
                order = np.argsort(c[1], kind="stable")
                c = [x[order] for x in c]
                words = lambda k, c=c: np.stack(c[k : k + WORDS], 1).view(np.uint64)
                tree = _tree(_Level(words(5), words(5 + WORDS), *(x.astype(np.int64) for x in c[2:5])))
                # a block may hold pairs of its own: it meets itself besides the later ones
                a, b = dual_traversal(tree, tree, threshold, True)
                alone = np.flatnonzero(tree[0].possible(np.arange(len(order)), tree[0], np.arange(len(order)), threshold))
                one, two = c[1][np.append(a, alone)], c[1][np.append(b, alone)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), c[0][0])), pa.array(one), pa.array(two)], names=["token", "one", "two"])

    return pairs


def candidates(sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs that the trees cannot rule out; holds every pair above the threshold.

    ``sets``: id bigint (unique), grams array<bigint> of distinct hashes.
    """
    each = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    freq = each.groupBy("gram").agg(F.count("*").alias("f")).where("f > 1")
    weighed = each.join(freq, "gram").groupBy("id", "n").agg(F.collect_list(F.struct("f", "gram")).alias("grams"))
    rows = materialize(weighed.select("id", "n", "grams").mapInArrow(_prefix_rows(threshold), _PREFIX))
    one = F.lit(0).cast("bigint")
    cols = ["token", "one", "two", "side", "id", "n", "shared", "rest", "short", *_MAPS]
    small = rows.where(F.col("freq") <= block).withColumns({"one": one, "two": one, "side": F.lit(2)})
    # groups above a block: cut by size, rest and min-hash, meet only where the blocks' summaries allow it
    part = F.pmod(F.col("least"), F.ceil(F.col("freq") / block))
    octave = lambda c: F.floor(F.log2(c) * 4).cast("bigint")
    hot = rows.where(F.col("freq") > block).withColumn("block", (octave("n") * 256 + octave("rest")) * (1 << 40) + part)
    summary = hot.groupBy("token", "block").agg(
        F.min("n").alias("lo"), F.max("shared").alias("shared"), F.max("rest").alias("rest"), *[F.bit_or(b).alias(f"o{b}") for b in _MAPS], *[F.bit_and(b).alias(f"a{b}") for b in _MAPS]
    )
    meet = materialize(summary.repartition("token").sortWithinPartitions("token").mapInArrow(_block_pairs(threshold), "token bigint, one bigint, two bigint"))
    other = hot.withColumnRenamed("token", "t")

    def side(number: int, mine: str, which: str) -> DataFrame:
        return other.join(meet.where(which), (F.col("t") == F.col("token")) & (F.col("block") == F.col(mine))).withColumn("side", F.lit(number))

    grouped = small.select(cols)
    for part_ in (side(2, "one", "one = two"), side(0, "one", "one <> two"), side(1, "two", "one <> two")):
        grouped = grouped.unionByName(part_.select(cols))
    grouped = grouped.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two")
    return grouped.mapInArrow(_group_pairs(threshold), "id_a bigint, id_b bigint").distinct()


def similar_classes(texts: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(members, links): (key, id) of every text with a class, and (id_a, id_b, similarity) of the classes alike.

    ``texts``: key, text.  A class holds the keys whose sets of sequences are equal.
    """
    named = materialize(text_sets(texts, width))
    members = named.select("key", "id").distinct()
    # the candidate search moves 8-byte numbers of the classes instead of their names
    sets = materialize(named.groupBy("id", "number").agg(F.first("grams").alias("grams")))
    pairs = candidates(sets.select(F.col("number").alias("id"), "grams"), threshold)
    a = sets.select(F.col("number").alias("number_a"), F.col("id").alias("id_a"), F.col("grams").alias("grams_a"))
    b = sets.select(F.col("number").alias("number_b"), F.col("id").alias("id_b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    similarity = both / (F.size("grams_a") + F.size("grams_b") - both)
    links = pairs.toDF("number_a", "number_b").join(a, "number_a").join(b, "number_b").select("id_a", "id_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return members, links


def similar_pairs(texts: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of keys with texts alike, copies written out."""
    members, links = similar_classes(texts, threshold, width)
    one, two = members.select(F.col("key").alias("key_1"), F.col("id").alias("id_a")), members.select(F.col("key").alias("key_2"), F.col("id").alias("id_b"))
    across = links.join(one, "id_a").join(two, "id_b").where("key_1 <> key_2")
    within = one.join(two, F.col("id_a") == F.col("id_b")).where("key_1 < key_2")
    both = across.select("key_1", "key_2").unionByName(within.select("key_1", "key_2"))
    return both.select(F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b")).distinct()


def similar_groups(texts: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(key, class_id, n_links, group_id) of every key whose text is alike to another's.

    ``n_links`` counts the other classes alike to the key's; copies are not written out
    as pairs.  ``group_id`` is the least class of those connected.
    """
    members, links = similar_classes(texts, threshold, width)
    links = materialize(links)
    groups = connected_components(links.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    ends = links.select(F.col("id_a").alias("id")).unionByName(links.select(F.col("id_b").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("id").agg(F.count("*").alias("n_keys"))
    out = members.join(copies, "id").join(degree, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    out = out.where("n_keys > 1 or n_links > 0")
    return out.select("key", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("group_id"))
