"""Lexical, vector and fused ranking, for many queries at once.

Every ranking carries an explicit unique tie key.  Queries are a stated set; a corpus
of any size is scanned once and meets the queries through an equi-join on tokens or,
for dense vectors, in blocks of at most ``QUERY_BLOCK`` queries.

Null and empty texts have no tokens and rank nowhere; a query without tokens has no
hits; vectors of zero length or null have similarity 0 and no rank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.text import tokens
from siltstone.session import broadcast_if_small, materialize

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
QUERY_BLOCK = 4096


def term_counts(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, token, tf, norm): the distinct tokens of every text, counted in the row, with how many the text has and the length of their vector.

    Nothing is shuffled; what joins the result meets rows that are counted already.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().dictionary_encode()
            lengths = np.asarray(batch.column(1).value_lengths().fill_null(0)).astype(np.int64)
            row, size = np.repeat(np.arange(batch.num_rows), lengths), max(len(flat.dictionary), 1)
            each, tf = np.unique(row * size + flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            row, word = each // size, each % size
            norm = np.sqrt(np.bincount(row, tf * tf, minlength=batch.num_rows))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(lengths[row]), flat.dictionary.take(pa.array(word)), pa.array(tf.astype(np.int64)), pa.array(norm)], names=["key", "dl", "token", "tf", "norm"])

    kind = corpus.schema[key].dataType.simpleString()
    return corpus.select(key, tokens(F.col(text)).alias("t")).mapInArrow(count, f"`{key}` {kind}, dl bigint, token string, tf bigint, norm double")


def query_terms(queries: DataFrame, query: str, query_text: str) -> DataFrame:
    """(query, token, qtf)."""
    return queries.select(query, F.explode(tokens(F.col(query_text))).alias("token")).groupBy(query, "token").agg(F.count("*").alias("qtf"))


def corpus_statistics(corpus: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(per token: df, idf) and one row (n, avgdl) over the whole corpus.

    A negative idf is floored at EPSILON times the mean idf over the whole vocabulary.
    """
    t = corpus.select(tokens(F.col(text)).alias("t"))
    # the texts are counted as one more token, the empty one, so a single pass gives both
    whole = F.filter(F.array(F.struct(F.lit("").alias("token"), F.size("t").cast("bigint").alias("dl"))), lambda x: x["dl"] > 0)
    each = F.concat(whole, F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("token"), F.lit(0).cast("bigint").alias("dl"))))
    counted = t.select(F.explode(each).alias("e")).groupBy("e.token").agg(F.count("*").alias("df"), F.sum("e.dl").alias("dl"))
    counted = materialize(counted)  # the vocabulary is used four times below, the texts are read for it once
    total = counted.where("token = ''").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    df = counted.where("token <> ''").select("token", "df")
    raw = df.join(F.broadcast(total)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.join(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")))  # one row
    return idf.select("token", "df", "idf"), total


def top(scored: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best per query with their rank; ties by key."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int | None) -> DataFrame:
    """(query, key, score[, rank]) by Okapi BM25; a hit needs a shared token, not a positive score.

    Repeated query tokens count repeatedly.  ``k`` None gives all hits, so that filters
    may follow that must not change the corpus statistics.
    """
    idf, total = corpus_statistics(corpus, text)
    q = query_terms(queries, query, query_text)
    # the texts' tokens are counted in the row and cut to the queries' tokens before anything is shuffled with them
    hits = term_counts(corpus, key, text).join(broadcast_if_small(q.join(idf, "token")), "token").join(F.broadcast(total))  # one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score"))
    return scored if k is None else top(scored, query, key, k)


def bag_cosine(corpus: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int | None) -> DataFrame:
    """(query, key, score, rank) by the cosine of token counts: a sparse vector leg made from text alone.

    With ``k`` the texts are weighed where they are scanned, as one window each; without
    it every hit comes out, unranked, by a join on tokens.
    """
    if k is not None:
        return best_windows(corpus, key, text, queries, query, query_text, 1 << 40, 0, k)
    q = broadcast_if_small(query_terms(queries, query, query_text))
    qnorms = q.groupBy(query).agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    met = term_counts(corpus, key, text).join(q, "token")
    dots = met.groupBy(query, key).agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"), F.max("norm").alias("norm"))
    return dots.join(qnorms, query).select(query, key, F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_HUMP, _OTHER = re.compile("([a-z0-9])([A-Z])"), re.compile("[^a-z0-9]+")


class _Ids:
    """The tokens of words as whole numbers; the queries' tokens come first."""

    def __init__(self, known: list[str]) -> None:
        self.known = {w: i for i, w in enumerate(known)}
        self.words: dict[str, list[int]] = {}

    def of(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            tokens = [t for t in _OTHER.split(_HUMP.sub(r"\1 \2", word).lower()) if len(t) >= 2]
            found = self.words[word] = [self.known.setdefault(t, len(self.known)) for t in tokens]
        return found


def best_windows(corpus: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, size: int, overlap: int, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, score, rank): texts by the cosine of token counts of their best window of ``size`` words, k per query.

    Every window of every text meets every query, in the task that scans the text; only each
    batch's k best texts per query leave it.  Queries go to the tasks in blocks of at most
    ``block``.  A hit needs a shared token; the windows are those of ``chunking.word_windows``.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    asked_type = to_arrow_type(queries.schema[query].dataType)
    kinds = tuple(df.schema[c].dataType.simpleString() for df, c in ((queries, query), (corpus, key)))

    def search(part: list[tuple[object, list[str]]]) -> DataFrame:
        asked = [q for q, _ in part]
        vocabulary = sorted({t for _, ts in part for t in ts})
        place = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros((len(part), len(vocabulary)))
        for row, (_, ts) in zip(weights, part, strict=True):
            for t in ts:
                row[place[t]] += 1
        weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-10)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = _Ids(vocabulary)
            for batch in batches:
                if len(ids.words) > 200_000:  # forgetting words changes no result
                    ids = _Ids(vocabulary)
                scores = np.zeros((len(part), batch.num_rows))
                for j, t in enumerate(batch.column(1).to_pylist()):
                    words = [ids.of(w) for w in _SPACE.split(t) if w]
                    ends = np.cumsum([0, *map(len, words)])
                    flat = np.fromiter((i for w in words for i in w), np.int64, ends[-1])
                    at = 0
                    while words:
                        each, tf = np.unique(flat[ends[at] : ends[min(at + size, len(words))]], return_counts=True)
                        shared = np.searchsorted(each, len(vocabulary))  # the queries' tokens are the least
                        if shared:
                            dots = weights[:, each[:shared]] @ tf[:shared]
                            np.maximum(scores[:, j], dots / np.sqrt((tf * tf).sum()), out=scores[:, j])
                        if at + size >= len(words):
                            break
                        at += size - overlap
                near = np.round(scores, 6)
                row, col = np.nonzero(scores > 0)
                keys = batch.column(0).take(pa.array(col))
                order = np.lexsort((keys.to_numpy(zero_copy_only=False), -near[row, col], row))
                first = np.searchsorted(row[order], np.arange(len(part)))
                keep = order[np.arange(len(row)) - first[row[order]] < k]
                yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in row[keep].tolist()], asked_type), keys.take(pa.array(keep)), pa.array(near[row[keep], col[keep]])], names=["query", "key", "score"])

        return corpus.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInArrow(scan, f"`{query}` {kinds[0]}, `{key}` {kinds[1]}, score double")

    results, held = [], []
    for r in queries.select(query, tokens(F.col(query_text))).where(F.col(query_text).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:  # a full block is searched and let go before the next is read
            results.append(materialize(search(held)))
            held = []
    if held or not results:
        results.append(search(held))
    return top(reduce(DataFrame.unionByName, results), query, key, k)


def fuse(streams: DataFrame, query: str, key: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query, stream, key, rank): one vote per stream, at the best rank.

    Ties go to the id seen first: the least stream, then the best rank in it, then the key.
    """
    best = streams.groupBy(query, "stream", key).agg(F.min("rank").alias("rank"))
    fused = best.groupBy(query, key).agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 8).alias("rrf_score"), F.min(F.struct("stream", "rank")).alias("_seen"), F.count("*").alias("votes")
    )
    w = Window.partitionBy(query).orderBy(F.desc("rrf_score"), "_seen", key)
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_seen")


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-10)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1))


def _nearest(cosine: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, of equal scores (6 digits) the least keys."""
    n = min(k, cosine.shape[1])
    near = np.round(cosine, 6)
    row, col = np.nonzero(near >= -np.partition(-near, n - 1, axis=1)[:, n - 1 : n])
    order = np.lexsort((keys[col], -near[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(cosine)))[row] < n
    return row[keep], col[keep]


def _by_query_blocks(queries: DataFrame, key: str, vector: str, block: int, search: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    """The hits of all queries, ``block`` of them at a time, each full block searched and let go before the next is read."""

    def one(part: list[tuple[int, list[float]]]) -> DataFrame:
        return search(np.array([i for i, _ in part], np.int64), _unit(np.array([v for _, v in part], np.float64).reshape(len(part), -1)))

    results, held = [], []
    for r in queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            results.append(materialize(one(held)))
            held = []
    if held or not results:
        results.append(one(held))
    return reduce(DataFrame.unionByName, results).withColumn("cosine", F.round("cosine", 6))


_HITS = "query_key bigint, key bigint, cosine double"


def _hits(query: np.ndarray, key: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    ok = score > -1.5  # a row is not its own hit
    return pa.RecordBatch.from_arrays([pa.array(query[ok]), pa.array(key[ok]), pa.array(score[ok])], names=["query_key", "key", "cosine"])


def vector_search(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int | None = None, threshold: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_key, key, cosine) exactly: the k nearest or all at ``threshold`` and above; a row is not its own hit.

    Queries go to the tasks in blocks of bounded size; each task multiplies matrices and
    keeps only its own k best per query before the final choice.
    """

    def search(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(keys) or not len(ids):
                    continue
                cosine = matrix @ _matrix(batch.column(1), len(keys)).T
                cosine[ids[:, None] == keys[None, :]] = -2.0
                row, col = _nearest(cosine, keys, k) if k is not None else np.nonzero(cosine >= threshold - 1e-9)
                yield _hits(ids[row], keys[col], cosine[row, col])

        return rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(scan, _HITS)

    found = _by_query_blocks(queries, key, vector, block, search)
    return found if k is None else top(found, "query_key", "key", k, "cosine")


def fit_cells(rows: DataFrame, key: str, vector: str, cells: int, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centroids of a coarse index, fitted on ``sample`` rows chosen by a hash of their key."""
    picked = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    x = np.array([r[0] for r in picked], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    centroids = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(1)
        for c in range(len(centroids)):
            if (nearest == c).any():
                mean = x[nearest == c].mean(0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-10)
    return centroids


def cell_search(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, centroids: np.ndarray, probes: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_key, key, cosine, rank): the k nearest within the ``probes`` cells nearest to each query.

    Every row is indexed, in its nearest cell; queries look into several cells.  Rows are
    not moved: a task puts the rows of a batch into their cells and multiplies each cell
    with the queries that probe it, so a cell that holds a third of the rows is spread over all tasks.
    """

    def search(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        near = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probes] if len(ids) else np.empty((0, 1), np.int64)
        probed = np.zeros((len(ids), len(centroids)), bool)
        probed[np.arange(len(ids))[:, None], near] = True

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(keys) or not len(ids):
                    continue
                values = _matrix(batch.column(1), len(keys))
                cell = (values @ centroids.T).argmax(1)
                for c in np.unique(cell).tolist():
                    here, asking = np.flatnonzero(cell == c), np.flatnonzero(probed[:, c])
                    if len(asking):
                        cosine = matrix[asking] @ values[here].T
                        cosine[ids[asking][:, None] == keys[here][None, :]] = -2.0
                        row, col = _nearest(cosine, keys[here], k)
                        yield _hits(ids[asking[row]], keys[here[col]], cosine[row, col])

        return rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(scan, _HITS)

    return top(_by_query_blocks(queries, key, vector, block, search), "query_key", "key", k, "cosine")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays, guarded against zero norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - dot / F.greatest(norm(a) * norm(b), F.lit(1e-10))
