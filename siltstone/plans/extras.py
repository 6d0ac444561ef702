"""Further compositions: set operations, dependency views, bundles, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import graph, lint, ranking, selection
from siltstone.operators.search import search
from siltstone.plans.analytics import ORACLES as ANALYTICS
from siltstone.plans.analytics import a10_hotspots, a11_cochange, m01_priority
from siltstone.plans.graphs import page_edges
from siltstone.plans import quality
from siltstone.plans.search import _DOCS, _QS, _RANK, bm25_sql, cosine_sql
from siltstone.plans.text import SQL_LINKS, docs
from siltstone.session import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark_items")


def f08_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by scope, decided on both ends."""
    e = docs(spark, sf_dir).select("slug", F.explode(T.wikilinks(F.col("text"))).alias("target"))
    both = F.when(F.col("slug").startswith("concepts/") & F.col("target").startswith("concepts/"), "inside").when(F.col("slug").startswith("concepts/") | F.col("target").startswith("concepts/"), "across").otherwise("outside")
    return e.groupBy(both.alias("scope")).agg(F.count("*").alias("n"))


def f10_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.col("path").startswith("concepts/retry-queue")).select("doc_id", "path")


def f11_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the dictated texts that look like accessors of an entity."""
    names = table(spark, sf_dir, "whisper_history").select(F.explode(F.regexp_extract_all(F.col("transcript"), F.lit(r"\b([a-z]+_[a-z_]+)"), F.lit(1))).alias("name"))
    return names.groupBy(F.col("name").rlike("^(?:get|set|is|has|add|remove|merge|route)_").alias("accessor")).agg(F.count("*").alias("n"))


def g03_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents around a seed, in order of distance and id, until 20,000 characters are used."""
    seeds = spark.createDataFrame([("concepts/lint-suite",)], "seed string")
    # a step between topics is up to three here: topic, page, topic, page
    near = graph.neighbours(page_edges(spark, sf_dir), seeds, 3)
    d = docs(spark, sf_dir).select("doc_id", F.coalesce("slug", F.concat(F.lit("doc/"), "doc_id")).alias("node"), F.length("text").alias("chars"))
    j = d.join(near, "node")
    # each document costs at least the separator, so only the first 20,001 can matter
    order = Window.partitionBy("seed").orderBy("depth", "doc_id")
    ranked = j.withColumn("pos", F.row_number().over(order)).where("pos <= 20001")
    return selection.prefix_budget(ranked, "seed", "pos", "chars", 20_000).select("doc_id", F.col("used").cast("bigint").alias("used"))


def g10_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities' sizes, hubs and labels, largest first."""
    return graph.communities(page_edges(spark, sf_dir)).select("community_id", "hub", "size", "label").distinct()


def j11_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like a held-out passage: the five best per passage at 0.2 and above, each document once with its best."""
    hits = ranking.bag_cosine(docs(spark, sf_dir), "doc_id", "text", _items(spark, sf_dir), "item_id", "passage", 5).where("score >= 0.2")
    return hits.groupBy("doc_id").agg(F.max("score").alias("score"), F.count("*").alias("passages"))


def j17_file_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's node, history and partners side by side."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_brand")
    partners = a11_cochange(spark, sf_dir).groupBy("path").agg(F.count("*").alias("partners"))
    return p.join(a10_hotspots(spark, sf_dir).select("path", "commits", "bus_factor"), "path", "left").join(partners, "path", "left").select("path", "p_brand", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("bus_factor", F.lit(0)).alias("bus_factor"), F.coalesce("partners", F.lit(0)).alias("partners"))


def k11_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled document as entries in order of priority, each an excerpt of at most 600 characters."""
    z = table(spark, sf_dir, "article_zones").where("trim(observed) <> ''").groupBy("slug").agg(F.min(F.struct("zone_id", "observed")).alias("z"))
    a = m01_priority(spark, sf_dir).join(z, "slug").select("slug", "priority", F.col("z.observed").alias("body"))
    top = a.orderBy(F.desc("priority"), "slug").limit(30)  # the document holds thirty entries
    rank = F.row_number().over(Window.orderBy(F.desc("priority"), "slug"))
    return top.select(rank.cast("bigint").alias("rank"), "slug", F.md5(F.concat(F.lit("## "), "slug", F.lit("\n\n"), T.excerpt(F.col("body"), F.col("slug"), 600))).alias("entry_md5"))


def k14_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the report on quality, by severity."""
    issues = lint.report(quality.corpus(spark, sf_dir))
    return issues.groupBy("severity", "check").agg(F.count("*").alias("n")).select(F.concat(F.lit("- **"), "severity", F.lit("** "), "check", F.lit(": "), F.col("n").cast("string")).alias("line"))


def k16_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_zones").join(table(spark, sf_dir, "articles").select("slug"), "slug", "left_semi").select("zone_id")


def p13_code_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of source documents that suit a question, as path:first-last."""
    from siltstone.operators.chunking import line_windows

    w = line_windows(table(spark, sf_dir, "source_documents").where("content is not null").select("source_id", "path", "content"), "content", 150, 30)
    w = w.withColumn("at", F.concat_ws(":", "source_id", F.concat_ws("-", "first_line", "last_line")))
    hits = ranking.bag_cosine(w, "at", "window", spark.createDataFrame([(1, "how does the retry queue flush rows")], "qid int, q string"), "qid", "q", 5)
    return hits.select("at", "score", F.col("rank").cast("bigint").alias("rank"))


def p25_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the citation ids c1 to cN of their question."""
    hits = ranking.bm25(docs(spark, sf_dir), "doc_id", "text", _items(spark, sf_dir), "item_id", "question", 4)
    return hits.select("item_id", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("citation"), "doc_id")


def q08_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source documents of one kind by the cosine of their tokens."""
    s = table(spark, sf_dir, "source_documents").where("path like '%/adr/%' or path like '%/notes/%'")
    hits = ranking.bag_cosine(s, "source_id", "content", spark.createDataFrame([(1, "retry queue lock file"), (2, "community map")], "qid int, q string"), "qid", "q", 5)
    return hits.select(F.col("qid").cast("bigint").alias("qid"), "source_id", "score", F.col("rank").cast("bigint").alias("rank"))


def q09_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes of the one search entry side by side, English documents only."""
    d, q = docs(spark, sf_dir), _items(spark, sf_dir)
    keep = d.where("lang = 'en'")
    parts = [search(d, "doc_id", "text", q, "item_id", "question", 3, mode, keep).select(F.lit(mode).alias("mode"), "item_id", "doc_id", F.col("rank").cast("bigint").alias("rank")) for mode in ("lexical", "vector")]
    return parts[0].unionByName(parts[1])


def q12_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question pages only, one per slug, for each benchmark question."""
    d = docs(spark, sf_dir)
    hits = ranking.bm25(d, "doc_id", "text", _items(spark, sf_dir), "item_id", "question", None).join(d.where("slug like 'qa/%'").select("doc_id", "slug"), "doc_id")
    best = hits.groupBy("item_id", "slug").agg(F.max("score").alias("score"))
    return ranking.top(best, "item_id", "slug", 3).select("item_id", "slug", "score", F.col("rank").cast("bigint").alias("rank"))


def r10_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose synthesis changed between their first and last indexing, and whether the new one cites anything."""
    z = table(spark, sf_dir, "article_zones").where("slug is not null").groupBy("slug").agg(F.min(F.struct("zone_id", "synthesized")).alias("a"), F.max(F.struct("zone_id", "synthesized")).alias("b"))
    return z.groupBy((~F.col("a.synthesized").eqNullSafe(F.col("b.synthesized"))).alias("changed"), F.coalesce(F.col("b.synthesized").contains("[["), F.lit(False)).alias("cites")).agg(F.count("*").alias("n"))


def u02_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics named by links and by pages: one row each, pages win."""
    pages = docs(spark, sf_dir).select(F.regexp_replace("slug", r"-\d+$", "").alias("id"), F.lit("page").alias("origin")).where("id is not null").distinct()
    links = docs(spark, sf_dir).select(F.explode(T.wikilinks(F.col("text"))).alias("id"), F.lit("link").alias("origin")).distinct()
    return pages.unionByName(links).groupBy("id").agg(F.max("origin").alias("origin"))


def u03_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("slug").subtract(table(spark, sf_dir, "article_zones").select("slug"))


def u04_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("slug").intersect(table(spark, sf_dir, "article_zones").select("slug"))


def w13_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document per file name, names used by daily logs left out."""
    d = docs(spark, sf_dir).withColumn("name", F.element_at(F.split("path", "/"), -1)).where("name is not null")
    used = d.where("path like 'daily/%'").select("name").distinct()
    w = Window.partitionBy("name").orderBy(F.desc("n_chars"), "doc_id")
    return d.join(used, "name", "left_anti").withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "name")


def w16_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten entries of each mode."""
    w = Window.partitionBy("mode").orderBy(F.desc("saved_at"), F.desc("entry_id"))
    return table(spark, sf_dir, "whisper_history").withColumn("n", F.row_number().over(w).cast("bigint")).where("n <= 10").select("mode", "entry_id", "n")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "fgjkpqruw" and k[1:3].isdigit() and v.__module__ == __name__}
_D = "documents where text is not null"
_L = f"(select regexp_replace(path, '\\.md$', '') slug, unnest({SQL_LINKS}) target from {_D})"
_Z = "article_zones where slug is not null"
ORACLES = {
    "f08_scopes": f"select case when starts_with(slug, 'concepts/') and starts_with(target, 'concepts/') then 'inside' when starts_with(slug, 'concepts/') or starts_with(target, 'concepts/') then 'across' else 'outside' end scope, count(*) n from {_L} group by 1",
    "f10_prefix": f"select doc_id, path from {_D} and starts_with(path, 'concepts/retry-queue')",
    "f11_accessors": "select regexp_matches(name, '^(?:get|set|is|has|add|remove|merge|route)_') accessor, count(*) n from (select unnest(regexp_extract_all(transcript, '\\b([a-z]+_[a-z_]+)', 1)) name from whisper_history) group by 1",
    "j11_preflight": f"with {cosine_sql(_DOCS, 'select item_id qid, passage q from benchmark_items', 'hits')}, t as (select * from hits qualify {_RANK} <= 5) select id doc_id, max(score) score, count(*) passages from t where score >= 0.2 group by 1",
    "j17_file_deps": f"select p_partkey path, p_brand, coalesce(commits, 0) commits, coalesce(bus_factor, 0) bus_factor, coalesce(c.n, 0) partners from part left join ({ANALYTICS['a10_hotspots']}) h on h.path = p_partkey left join (select path, count(*) n from ({ANALYTICS['a11_cochange']}) group by 1) c on c.path = p_partkey",
    "k14_report": f"select '- **' || severity || '** ' || \"check\" || ': ' || n line from ({quality.ORACLES['lint_totals']})",
    "k16_pruned": "select zone_id from article_zones where slug in (select slug from articles where slug is not null)",
    "p25_citations": f"with {bm25_sql(_DOCS, _QS)} select qid item_id, 'c' || {_RANK} citation, id doc_id from hits qualify {_RANK} <= 4",
    "q08_code": f"with {cosine_sql('select source_id id, content body from source_documents where path like ' + chr(39) + '%/adr/%' + chr(39) + ' or path like ' + chr(39) + '%/notes/%' + chr(39), 'select * from (values (1, ' + chr(39) + 'retry queue lock file' + chr(39) + '), (2, ' + chr(39) + 'community map' + chr(39) + ')) v(qid, q)', 'hits')} select qid, id source_id, score, {_RANK} rank from hits qualify rank <= 5",
    "q09_modes": f"with {bm25_sql(_DOCS, _QS, 'a')}, {cosine_sql(_DOCS + ' and lang = ' + chr(39) + 'en' + chr(39), _QS, 'b')}, e as (select a.* from a join documents on doc_id = id where lang = 'en') select 'lexical' \"mode\", qid item_id, id doc_id, {_RANK} rank from e qualify rank <= 3 union all select 'vector', qid, id, {_RANK} rank from b qualify rank <= 3",
    "q12_scenarios": f"with {bm25_sql(_DOCS, _QS)}, t as (select qid, regexp_replace(path, '\\.md$', '') id, max(score) score from hits join documents on doc_id = id where path like 'qa/%' group by all) select qid item_id, id slug, score, {_RANK} rank from t qualify rank <= 3",
    "r10_credit": f"select a is distinct from b changed, coalesce(contains(b, '[['), false) cites, count(*) n from (select slug, arg_min(coalesce(synthesized, '∅'), zone_id) a, arg_max(coalesce(synthesized, '∅'), zone_id) b from {_Z} group by 1) group by 1, 2",
    "u02_symbols": f"select id, max(o) origin from (select regexp_replace(regexp_replace(path, '\\.md$', ''), '-[0-9]+$', '') id, 'page' o from {_D} and path is not null union all select target, 'link' from {_L}) group by 1",
    "u03_removed": "select slug from articles except select slug from article_zones",
    "u04_shared": "select slug from articles intersect select slug from article_zones",
    "w13_basenames": f"select doc_id, name from (select doc_id, n_chars, list_extract(string_split(path, '/'), -1) name from {_D} and path is not null) where name not in (select list_extract(string_split(path, '/'), -1) from {_D} and path like 'daily/%') qualify row_number() over (partition by name order by n_chars desc, doc_id) = 1",
    "w16_history": "select mode, entry_id, row_number() over (partition by mode order by saved_at desc, entry_id desc) n from whisper_history qualify n <= 10",
}
