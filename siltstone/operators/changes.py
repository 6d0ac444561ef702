"""Change detection between two states of a keyed table, and gates on retries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Branches of a block, and those of one side that are compared at once.
BLOCK, ROWS = 1024, 256


def classify_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, changed, same or removed, by one full outer join on the key.

    Both sides have one row per key; a null digest differs from everything but null.
    """
    o, n = old.select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_was")), new.select(F.col(key), F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return both.select(key, change.alias("change"))


def partition_sources(sources: DataFrame, done: DataFrame, failures: DataFrame, key: str, digest: str, attempts: int = 3) -> DataFrame:
    """(key, state): done when ingested with the same digest, exhausted after ``attempts`` failures of it, else selected."""
    d = done.select(key, F.col(digest).alias("_done"))
    f = failures.select(key, F.col(digest).alias("_failed"), F.col("attempts").alias("_attempts"))
    joined = sources.join(d, key, "left").join(f, key, "left")
    state = F.when(F.col(digest) == F.col("_done"), "done").when((F.col(digest) == F.col("_failed")) & (F.col("_attempts") >= attempts), "exhausted").otherwise("selected")
    return joined.select(key, state.alias("state"))


def failure_counts(attempts: DataFrame, key: str, digest: str, order: str, failed: str) -> DataFrame:
    """(key, digest, attempts) of every key's last content: how often it has failed since it last changed or was done.

    ``attempts``: one row per attempt, ``order`` unique within its key.  A changed digest and
    a success both start the count anew.  Aggregates only: no key's history is gathered.
    """
    rows = attempts.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), F.col(order).alias("_o"), F.coalesce(F.col(failed), F.lit(False)).alias("_f"))
    last = rows.groupBy("_k").agg(F.max_by("_d", "_o").alias("_last"))
    known = rows.join(last, "_k")
    reset = known.groupBy("_k").agg(F.first("_last").alias("_last"), F.max(F.when(~F.col("_d").eqNullSafe(F.col("_last")) | ~F.col("_f"), F.col("_o"))).alias("_reset"))
    open_ = rows.join(reset, "_k").where(F.col("_reset").isNull() | (F.col("_o") > F.col("_reset")))
    counted = open_.groupBy("_k").agg(F.count("*").alias("attempts"))
    return reset.join(counted, "_k", "left").select(F.col("_k").alias(key), F.col("_last").alias(digest), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def retry_gate(sources: DataFrame, failures: DataFrame, key: str, digest: str, most: int = 3) -> DataFrame:
    """``sources`` without those whose content is unchanged since it failed ``most`` times; a changed one goes on."""
    gone = failures.where(F.col("attempts") >= most).select(key, digest)
    return sources.join(gone, [key, digest], "left_anti")


def independent_tips(touched: DataFrame, ancestry: DataFrame) -> DataFrame:
    """(branch, path) without the branches that are an ancestor of another branch on the same path.

    ``ancestry``: ancestor, branch.
    """
    t = touched.select("branch", "path").distinct()
    below = t.join(ancestry.select("ancestor", "branch"), "branch").select(F.col("ancestor").alias("branch"), "path").distinct()
    return t.join(below, ["branch", "path"], "left_anti")


def conflicts(touched: DataFrame, ancestry: DataFrame) -> DataFrame:
    """(path, branches): paths that at least two independent tips touch."""
    return independent_tips(touched, ancestry).groupBy("path").agg(F.count("*").alias("branches")).where("branches >= 2")


def _incidence(left: pa.ListArray, right: pa.ListArray, rows: slice) -> np.ndarray:
    """How many values each list of ``left[rows]`` shares with each list of ``right``; a list holds a value once."""
    some, whole = left.slice(rows.start, rows.stop - rows.start), len(right)
    values = pa.concat_arrays([some.flatten(), right.flatten()]).dictionary_encode()
    codes, at = values.indices.to_numpy(), np.concatenate([np.asarray(some.value_parent_indices()), len(some) + np.asarray(right.value_parent_indices())])
    out = np.zeros((len(some), whole), np.float32)
    if not len(codes):
        return out
    order = np.lexsort((at, codes))
    codes, at = codes[order], at[order]
    firsts = np.flatnonzero(np.diff(codes, prepend=-1))
    middles, lasts = np.searchsorted(codes * (len(some) + whole) + at, codes[firsts].astype(np.int64) * (len(some) + whole) + len(some)), np.append(firsts[1:], len(codes))
    n, m = middles - firsts, lasts - middles
    # values that many lists hold meet in one product, the others list by list
    many = np.flatnonzero(n * m * 64 > len(some) * whole)
    for k in range(0, len(many), 1024):
        x, y = np.zeros((len(many[k : k + 1024]), len(some)), np.float32), np.zeros((len(many[k : k + 1024]), whole), np.float32)
        for row, v in enumerate(many[k : k + 1024]):
            x[row, at[firsts[v] : middles[v]]] = 1
            y[row, at[middles[v] : lasts[v]] - len(some)] = 1
        out += x.T @ y
    for v in np.flatnonzero((n > 0) & (m > 0) & (n * m * 64 <= len(some) * whole)):
        out[np.ix_(at[firsts[v] : middles[v]], at[middles[v] : lasts[v]] - len(some))] += 1
    return out


def sharing_pairs(member: DataFrame, unrelated: DataFrame | None = None) -> DataFrame:
    """(a, b, shared): pairs of branches with the number of communities that both have, a < b.

    ``member``: branch, community and, if it matters, ``alone``: what a branch has of the community
    if it is but one thing; a community that both have by the same one thing does not count.
    ``unrelated``: a, b of pairs to leave out.  A branch is one row with its communities; blocks
    of branches meet pairwise, so every pair is made once, complete, and no pair is shuffled.
    """
    known = member.where("branch is not null and community is not null")
    alone = F.col("alone") if "alone" in member.columns else F.lit(None).cast("string")
    rows = materialize(known.groupBy("branch").agg(F.collect_set(F.col("community").cast("string")).alias("has"), F.collect_set(F.when(alone.isNotNull(), F.to_json(F.struct(F.col("community").cast("string").alias("c"), alone.alias("o"))))).alias("one")))
    blocks = max(1, -(-rows.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    kind = rows.schema["branch"].dataType
    own = rows.withColumn("k", block("branch"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = own.withColumn("o", other).select(F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).alias("right"), "branch", "has", "one", F.lit(None).cast(kind).alias("not"))
    if unrelated is not None:
        gone = unrelated.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a is not null and b is not null").distinct()
        met = met.unionByName(gone.select(F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), F.lit(None).cast("boolean").alias("right"), F.col("a").alias("branch"), F.col("b").alias("not")), allowMissingColumns=True)

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        right = table["right"]
        sides = [table.filter(pa.compute.equal(right, side)) for side in (False, True)]
        if key[0].as_py() == key[1].as_py():
            sides[1] = sides[0]
        lists = [[pa.concat_arrays(side[c].chunks) if side.num_rows else pa.array([], pa.list_(pa.string())) for c in ("has", "one")] for side in sides]
        left_ids, right_ids = (side["branch"].to_pylist() for side in sides)
        ordered = sorted({*left_ids, *right_ids})
        place = {v: n for n, v in enumerate(ordered)}
        l, r = (np.array([place[v] for v in ids], np.int64) for ids in (left_ids, right_ids))  # noqa: E741
        related = table.filter(pa.compute.is_null(right))
        apart = np.array([sorted((place[x], place[y])) for x, y in zip(related["branch"].to_pylist(), related["not"].to_pylist(), strict=True) if x in place and y in place], np.int64).reshape(-1, 2)
        at, names, found = {v: n for n, v in enumerate(r.tolist())}, pa.array(ordered, table.schema.field("branch").type), []
        cut = {}
        for x, y in apart.tolist():
            cut.setdefault(x, []).append(y)
            cut.setdefault(y, []).append(x)
        for start in range(0, len(l), ROWS):
            part = slice(start, min(start + ROWS, len(l)))
            shared = _incidence(lists[0][0], lists[1][0], part)
            if len(lists[0][1].flatten()) and len(lists[1][1].flatten()):
                shared -= _incidence(lists[0][1], lists[1][1], part)
            for n, v in enumerate(l[part].tolist()):
                if v in cut:
                    shared[n, [at[x] for x in cut[v] if x in at]] = 0
            if sides[0] is sides[1]:
                shared[l[part][:, None] >= r[None, :]] = 0
            x, y = np.nonzero(shared)
            n, x, y = shared[x, y].astype(np.int64), l[part][x], r[y]
            found.append(pa.Table.from_arrays([names.take(pa.array(np.minimum(x, y))), names.take(pa.array(np.maximum(x, y))), pa.array(n)], names=["a", "b", "shared"]))
        return pa.concat_tables(found) if found else pa.Table.from_arrays([names.slice(0, 0), names.slice(0, 0), pa.array([], pa.int64())], names=["a", "b", "shared"])

    name = kind.simpleString()
    return met.groupBy("i", "j").applyInArrow(pairs, f"a {name}, b {name}, shared bigint")


def branch_pairs(touched: DataFrame, member: DataFrame, ancestry: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of branches, none an ancestor of the other, with the communities that both touch.

    ``member``: path, community.  Pairs that share one community by one and the same path
    only are direct conflicts, not risks, and are left out.
    """
    t = touched.select("branch", "path").distinct().join(member.select("path", "community"), "path")
    b = t.groupBy("branch", "community").agg(F.when(F.count("*") == 1, F.min("path").cast("string")).alias("alone"))
    related = ancestry.select(F.least("ancestor", "branch").alias("a"), F.greatest("ancestor", "branch").alias("b"))
    return sharing_pairs(b, related)
