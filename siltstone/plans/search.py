"""Search over the corpus: lexical, vector, fused, filtered, linked, literal; and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import evaluation, ranking
from siltstone.plans.text import SQL_TOKENS, docs
from siltstone.session import table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark_items").select("item_id", "question", "question_type", "passage")


def q01_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark question."""
    hits = ranking.bm25(docs(spark, sf_dir), "doc_id", "text", _questions(spark, sf_dir), "item_id", "question", 10)
    return hits.select("item_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def q01_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with filters after the corpus statistics and before the limit: English, of one kind of page."""
    d = docs(spark, sf_dir)
    hits = ranking.bm25(d, "doc_id", "text", _questions(spark, sf_dir), "item_id", "question", None)
    kept = hits.join(d.where("lang = 'en' and slug like 'concepts/%'").select("doc_id"), "doc_id", "left_semi")
    return ranking.top(kept, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def q02_text_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.bag_cosine(docs(spark, sf_dir), "doc_id", "text", _questions(spark, sf_dir), "item_id", "question", 10)
    return hits.select("item_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def q03_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs at three times the limit, fused."""
    d, q = docs(spark, sf_dir), _questions(spark, sf_dir)
    one = ranking.bag_cosine(d, "doc_id", "text", q, "item_id", "question", 30).select("item_id", F.lit(1).alias("stream"), "doc_id", "rank")
    two = ranking.bm25(d, "doc_id", "text", q, "item_id", "question", 30).select("item_id", F.lit(2).alias("stream"), "doc_id", "rank")
    fused = ranking.fuse(one.unionByName(two), "item_id", "doc_id", 10)
    return fused.select("item_id", "doc_id", "rrf_score", "votes", F.col("place").cast("bigint").alias("place"))


def q04_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-out over projects: the best hits of each source, ids prefixed so they never merge, fused by rank."""
    d = docs(spark, sf_dir)
    hits = ranking.bm25(d, "doc_id", "text", _questions(spark, sf_dir), "item_id", "question", None).join(d.select("doc_id", "source"), "doc_id")
    w = Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    streams = ranked.select("item_id", F.col("source").alias("stream"), F.concat_ws("/", "source", "doc_id").alias("hit"), "rank")
    return ranking.fuse(streams, "item_id", "hit", 10).select("item_id", "hit", "rrf_score", F.col("place").cast("bigint").alias("place"))


def q05_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-log chunks of a date range for every benchmark question; an unparsable bound is ignored."""
    low, high = F.try_to_date(F.lit("2025-01-01")), F.try_to_date(F.lit("not a date"))
    d = table(spark, sf_dir, "daily_chunks").where(F.coalesce(F.col("log_date") >= low, low.isNull()) & F.coalesce(F.col("log_date") <= high, F.lit(True)))
    hits = ranking.bag_cosine(d, "chunk_no", "text", _questions(spark, sf_dir), "item_id", "question", 5)
    return hits.select("item_id", "chunk_no", "score", F.col("rank").cast("bigint").alias("rank"))


def q06_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold a literal, case-sensitive, newest first."""
    d = table(spark, sf_dir, "daily_chunks").where(F.col("text").contains("retry queue"))
    return d.select("chunk_no", "id", F.col("date_int").cast("bigint").alias("date_int")).orderBy(F.col("date_int").desc_nulls_last(), "chunk_no").limit(50)


def q07_exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal hits first, then ranked ones, one row per chunk id, with the context of the literal."""
    d = table(spark, sf_dir, "daily_chunks").where("id is not null")
    asked = spark.createDataFrame([(1, "stale retry queue")], "qid int, q string")
    exact = d.where(F.col("text").contains("retry queue")).select("id", F.lit(0).alias("stream"), F.col("chunk_no").alias("rank"))
    ranked = ranking.bm25(d, "chunk_no", "text", asked, "qid", "q", 30).join(d.select("chunk_no", "id"), "chunk_no").select("id", F.lit(1).alias("stream"), F.col("rank").cast("bigint").alias("rank"))
    first = exact.unionByName(ranked).groupBy("id").agg(F.min(F.struct("stream", "rank")).alias("s"))
    return first.select("id", F.col("s.stream").cast("bigint").alias("stream"), F.col("s.rank").alias("rank")).orderBy("stream", "rank", "id").limit(40)


def q10_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several queries over two channels: fused per channel, then merged by (score, key) descending."""
    asked = spark.createDataFrame([(1, "lock file retry queue"), (2, "transcript archive"), (3, "budget selector cost report")], "qid int, q string")
    parts = []
    for channel, df, key in (("daily", table(spark, sf_dir, "daily_chunks"), "chunk_no"), ("docs", docs(spark, sf_dir), "doc_id")):
        hits = ranking.bm25(df, key, "text", asked, "qid", "q", 10)
        streams = hits.select(F.lit(channel).alias("channel"), F.col("qid").alias("stream"), F.concat(F.lit(channel + ":"), F.col(key).cast("string")).alias("hit"), "rank")
        parts.append(ranking.fuse(streams, "channel", "hit", 30).select("channel", "hit", "rrf_score"))
    return parts[0].unionByName(parts[1]).orderBy(F.desc("rrf_score"), F.desc("hit")).limit(12)


def l02_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    hits = ranking.vector_search(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), k=5)
    return hits.select("query_key", "key", "cosine", F.col("rank").cast("bigint").alias("rank"))


def l02_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a coarse index: 16 cells fitted on a bounded sample, 12 of them probed."""
    e = table(spark, sf_dir, "embeddings")
    cells = ranking.fit_cells(e, "vec_id", "embedding", 16)
    return ranking.cell_search(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), 5, cells, 12).select("query_key", "key", "cosine", F.col("rank").cast("bigint").alias("rank"))


def j10_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors at a cosine of 0.35 and above to those whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return ranking.vector_search(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), threshold=0.35)


def w12_best_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best zone per article for each question, then the five best articles."""
    z = table(spark, sf_dir, "article_zones")
    each = z.select("slug", F.explode(F.array("observed", "synthesized")).alias("body"), "zone_id").where("body is not null").groupBy("slug", "body").agg(F.min("zone_id").alias("zid"))
    keyed = each.withColumn("key", F.concat_ws("#", "slug", F.md5("body")))
    hits = ranking.bm25(keyed, "key", "body", _questions(spark, sf_dir), "item_id", "question", None)
    best = hits.withColumn("slug", F.substring_index("key", "#", 1)).groupBy("item_id", "slug").agg(F.max("score").alias("score"))
    return ranking.top(best, "item_id", "slug", 5).select("item_id", "slug", "score", F.col("rank").cast("bigint").alias("rank"))


def w11_best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their best window of 150 words, ten per question."""
    best = ranking.best_windows(docs(spark, sf_dir), "doc_id", "text", _questions(spark, sf_dir), "item_id", "question", 150, 30, 10)
    return best.select("item_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id): the document holds a whole sentence of the item's passage."""
    cut = lambda c: F.explode(F.transform(F.split(c, r"\. "), lambda s: F.trim(F.regexp_replace(s, r"\.+$", ""))))
    items = _questions(spark, sf_dir).select("item_id", cut(F.col("passage")).alias("s")).where("length(s) >= 40")
    corpus = docs(spark, sf_dir).select("doc_id", cut(F.col("text")).alias("s")).where("length(s) >= 40")
    return corpus.join(items, "s").select("item_id", "doc_id").distinct()


def q13_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and NDCG of every question with gold, at 10."""
    q = _questions(spark, sf_dir)
    hits = ranking.bm25(docs(spark, sf_dir), "doc_id", "text", q, "item_id", "question", 10)
    return evaluation.per_question(hits, _gold(spark, sf_dir), "item_id", "doc_id", 10)


def a19_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = q13_benchmark(spark, sf_dir).join(_questions(spark, sf_dir).select("item_id", "question_type"), "item_id")
    return evaluation.summary(scores, "question_type")


def q11_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys looked up in a batch; a missing one gives an error row instead of failing."""
    asked = table(spark, sf_dir, "duplicate_pairs").select(F.col("slug_a").alias("slug")).unionByName(table(spark, sf_dir, "duplicate_pairs").select(F.col("slug_b").alias("slug"))).distinct()
    newest = Window.partitionBy("slug").orderBy(F.desc("article_id"))
    known = table(spark, sf_dir, "articles").withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("slug", "title", F.lit(True).alias("here"))
    return asked.join(known, "slug", "left").select("slug", "title", F.when(F.col("here").isNull(), "not_found").alias("error"))


QUERIES = {f.__name__: f for f in (q01_bm25, q01_bm25_filtered, q02_text_cosine, q03_hybrid, q04_linked, q05_daily, q06_exact, q07_exact_first, q10_multi, l02_knn, l02_ann, j10_similar_vectors, w11_best_window, w12_best_zone, q13_benchmark, a19_by_type, q11_lookups)}


def _tok(column: str) -> str:
    return SQL_TOKENS.replace("(text,", f"({column},")


def bm25_sql(corpus: str, queries: str, name: str = "hits") -> str:
    """CTEs ending in ``name``(qid, id, score): corpus gives (id, body), queries (qid, q)."""
    n = name
    return f"""{n}_c as ({corpus}), {n}_q as ({queries}),
 {n}_t as (select id, {_tok('body')} t from {n}_c where body is not null), {n}_d as (select id, t, len(t) dl from {n}_t where len(t) > 0),
 {n}_s as (select count(*) n, avg(dl) avgdl from {n}_d),
 {n}_tf as (select id, dl, tok, count(*) tf from (select id, dl, unnest(t) tok from {n}_d) group by all),
 {n}_raw as (select tok, ln(n - df + 0.5) - ln(df + 0.5) raw from (select tok, count(*) df from {n}_tf group by 1), {n}_s),
 {n}_idf as (select tok, case when raw < 0 then 0.25 * (select avg(raw) from {n}_raw) else raw end idf from {n}_raw),
 {n}_qt as (select qid, tok, count(*) qtf from (select qid, unnest({_tok('q')}) tok from {n}_q) group by all),
 {n} as (select qid, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from {n}_tf join {n}_qt using (tok) join {n}_idf using (tok), {n}_s group by all)"""


def cosine_sql(corpus: str, queries: str, name: str) -> str:
    n = name
    return f"""{n}_c as ({corpus}), {n}_q as ({queries}),
 {n}_tf as (select id, tok, count(*) tf from (select id, unnest({_tok('body')}) tok from {n}_c) group by all),
 {n}_n as (select id, sqrt(sum(tf * tf)) norm from {n}_tf group by 1),
 {n}_qt as (select qid, tok, count(*) qtf from (select qid, unnest({_tok('q')}) tok from {n}_q) group by all),
 {n}_qn as (select qid, sqrt(sum(qtf * qtf)) qnorm from {n}_qt group by 1),
 {n} as (select qid, id, round(sum(tf * qtf) / (max(norm) * max(qnorm)), 6) score from {n}_tf join {n}_qt using (tok) join {n}_n using (id) join {n}_qn using (qid) group by qid, id)"""


_DOCS = "select doc_id id, text body from documents where text is not null"
_QS = "select item_id qid, question q from benchmark_items"
_RANK = "row_number() over (partition by qid order by score desc, id)"
_BENCH = f"""{bm25_sql(_DOCS, _QS)},
 top10 as (select qid, id, {_RANK} rank from hits qualify rank <= 10),
 g as (select distinct item_id qid, doc_id id from (select item_id, trim(regexp_replace(unnest(string_split(passage, '. ')), '\\.+$', '')) s from benchmark_items) join (select doc_id, trim(regexp_replace(unnest(string_split(text, '. ')), '\\.+$', '')) s from documents where text is not null) using (s) where length(s) >= 40),
 sizes as (select qid, count(*) n_gold from g group by 1), h as (select qid, min(rank) f, sum(1 / log2(rank + 1)) dcg from top10 join g using (qid, id) group by 1),
 res as (select qid item_id, case when f is null then 0.0 else 1.0 end recall_any, round(coalesce(1 / f, 0), 6) rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 6) ndcg from sizes left join h using (qid))"""
_RRF = "round(sum(1.0 / (60 + rank)), 8)"
ORACLES = {
    "q01_bm25": f"with {bm25_sql(_DOCS, _QS)} select qid item_id, id doc_id, score, {_RANK} rank from hits qualify rank <= 10",
    "q01_bm25_filtered": f"with {bm25_sql(_DOCS, _QS)} select qid item_id, id doc_id, score, {_RANK} rank from hits join documents on doc_id = id where lang = 'en' and path like 'concepts/%' qualify rank <= 5",
    "q02_text_cosine": f"with {cosine_sql(_DOCS, _QS, 'hits')} select qid item_id, id doc_id, score, {_RANK} rank from hits qualify rank <= 10",
    "q03_hybrid": f"with {cosine_sql(_DOCS, _QS, 'a')}, {bm25_sql(_DOCS, _QS, 'b')}, st as (select qid, 1 stream, id, {_RANK} rank from a qualify rank <= 30 union all select qid, 2, id, {_RANK} rank from b qualify rank <= 30), f as (select qid, id, {_RRF} rrf_score, min(stream * 1000 + rank) seen, count(*) votes from st group by all) select qid item_id, id doc_id, rrf_score, votes, row_number() over (partition by qid order by rrf_score desc, seen, id) place from f qualify place <= 10",
    "q04_linked": f"with {bm25_sql(_DOCS, _QS)}, st as (select qid, source, source || '/' || id hit, row_number() over (partition by qid, source order by score desc, id) rank from hits join documents on doc_id = id qualify rank <= 5) select qid item_id, hit, rrf_score, row_number() over (partition by qid order by rrf_score desc, source, rank, hit) place from (select qid, hit, source, rank, round(1.0 / (60 + rank), 8) rrf_score from st) qualify place <= 10",
    "q05_daily": f"with {cosine_sql('select chunk_no id, text body from daily_chunks where log_date >= date ' + chr(39) + '2025-01-01' + chr(39), _QS, 'hits')} select qid item_id, id chunk_no, score, {_RANK} rank from hits qualify rank <= 5",
    "q06_exact": "select chunk_no, id, date_int from daily_chunks where contains(text, 'retry queue') order by date_int desc nulls last, chunk_no limit 50",
    "q07_exact_first": f"with {bm25_sql('select chunk_no id, text body from daily_chunks where id is not null', 'select 1 qid, ' + chr(39) + 'stale retry queue' + chr(39) + ' q')}, r as (select id k, {_RANK} rank from hits qualify rank <= 30), s as (select id, 0 stream, chunk_no rank from daily_chunks where id is not null and contains(text, 'retry queue') union all select d.id, 1, r.rank from r join daily_chunks d on d.chunk_no = r.k) select id, stream, rank from s qualify row_number() over (partition by id order by stream, rank) = 1 order by stream, rank, id limit 40",
    "q10_multi": f"with qs as (select * from (values (1, 'lock file retry queue'), (2, 'transcript archive'), (3, 'budget selector cost report')) v(qid, q)), {bm25_sql('select chunk_no id, text body from daily_chunks', 'select * from qs', 'a')}, {bm25_sql(_DOCS, 'select * from qs', 'b')}, st as (select 'daily' channel, 'daily:' || id hit, {_RANK} rank from a qualify rank <= 10 union all select 'docs', 'docs:' || id, {_RANK} rank from b qualify rank <= 10) select channel, hit, {_RRF} rrf_score from st group by all order by rrf_score desc, hit desc limit 12",
    "l02_knn": "select q.vec_id query_key, e.vec_id \"key\", round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) cosine, row_number() over (partition by q.vec_id order by cosine desc, e.vec_id) rank from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0 qualify rank <= 5",
    "j10_similar_vectors": "select q.vec_id query_key, e.vec_id \"key\", round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) cosine from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0 and list_cosine_similarity(q.embedding::double[], e.embedding::double[]) >= 0.35 - 1e-9",
    "w12_best_zone": f"with {bm25_sql('select distinct slug || chr(35) || md5(body) id, body from (select slug, unnest([observed, synthesized]) body from article_zones) where body is not null', _QS)}, best as (select qid, split_part(id, '#', 1) id, max(score) score from hits group by all) select qid item_id, id slug, score, {_RANK} rank from best qualify rank <= 5",
    "q13_benchmark": f"with {_BENCH} select * from res",
    "a19_by_type": f"with {_BENCH} select question_type, count(*) n, round(avg(recall_any), 6) recall_any, round(avg(rr), 6) rr, round(avg(ndcg), 6) ndcg from res join benchmark_items using (item_id) group by rollup (question_type)",
    "q11_lookups": "with a as (select slug, title from articles qualify row_number() over (partition by slug order by article_id desc) = 1) select s.slug, a.title, case when a.slug is null then 'not_found' end error from (select slug_a slug from duplicate_pairs union select slug_b from duplicate_pairs) s left join a using (slug)",
}
