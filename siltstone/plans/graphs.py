"""Graph queries over the pages of the corpus, their topics and the links between them.

Queries whose SQL keeps to the topics under ``concepts/`` come twice: as that SQL says, and
as ``..._pages`` over the links of every page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import graph
from siltstone.plans.text import SQL_LINKS, docs
from siltstone.session import table


Edges = Callable[[SparkSession, str], DataFrame]


def topic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic -> linked topic, where a topic is a slug without its number."""
    e = docs(spark, sf_dir).select(F.regexp_replace("slug", r"-\d+$", "").alias("src"), F.explode(T.wikilinks(F.col("text"))).alias("dst"))
    return e.where("src is not null and src like 'concepts/%' and src <> dst").distinct()


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page -> its link targets, and every topic (a slug without its number) -> its pages.

    Membership goes on where links end, as they name topics.  A page without a path goes by its id.
    """
    d = docs(spark, sf_dir).select(F.coalesce("slug", F.concat(F.lit("doc/"), "doc_id")).alias("page"), "slug", "text")
    links = d.select(F.col("page").alias("src"), F.explode(T.wikilinks(F.col("text"))).alias("dst"))
    parts = d.select(F.regexp_replace("slug", r"-\d+$", "").alias("src"), F.col("page").alias("dst")).where("src <> dst")
    return links.unionByName(parts).distinct()


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("concepts/lint-suite",), ("concepts/retry-queue",)], "seed string")


def g01_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges by kind of the unified graph: topics, documents, sources; links and membership; dangling links dropped."""
    d = docs(spark, sf_dir)
    topics = d.select(F.regexp_replace("slug", r"-\d+$", "").alias("id")).where("id is not null").distinct()
    links = d.select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("id")).distinct().join(topics, "id", "left_semi")
    part = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    out = part("node:topic", topics).unionByName(part("node:document", d)).unionByName(part("node:source", d.select("source").distinct()))
    return out.unionByName(part("edge:wikilink", links)).unionByName(part("edge:contains", d.where("source is not null")))


def g02_neighbours(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir), _seeds(spark), 2).select("seed", "node", F.col("depth").cast("bigint").alias("depth"))


def g04_path(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    p = graph.shortest_path(edges(spark, sf_dir), "concepts/lint-suite", "concepts/retry-queue")
    return p.agg(F.max("step").cast("bigint").alias("steps"))


def g05_trace(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    roots = spark.createDataFrame([("concepts/lint-suite",)], "root string")
    t = graph.trace(edges(spark, sf_dir), roots, 2)
    return t.select(F.array_join("path", ">").alias("path"), "leaf")


def g06_callers(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    return graph.reach(edges(spark, sf_dir), _seeds(spark), 6, reverse=True).select("seed", "node", F.col("depth").cast("bigint").alias("depth"))


def g07_cycles(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    return graph.strong_components(edges(spark, sf_dir))


def g08_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(page_edges(spark, sf_dir))


def g09_signature(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    """A key of the graph's state, independent of order and partitioning: counts and sums of hashes."""
    e = edges(spark, sf_dir)
    h = F.conv(F.substring(F.md5(F.concat_ws(">", "src", "dst")), 1, 8), 16, 10).cast("bigint")
    return e.agg(F.count("*").alias("edges"), F.sum(h).cast("double").alias("signature"))


def g11_merge_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per branch (supplier): files, communities (brands) and files that other branches touch too."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    f = li.select(F.col("l_suppkey").alias("branch"), F.col("l_partkey").alias("path")).distinct().join(p.select(F.col("p_partkey").alias("path"), "p_brand"), "path")
    shared = f.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit(1).alias("c"))
    return f.join(shared, "path", "left").groupBy("branch").agg(F.count("*").alias("files"), F.countDistinct("p_brand").alias("communities"), F.count("c").alias("conflicts"))


def g13_impact(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    """Topics that reach the seeds, with a risk of 1 / depth times the weight of how often they are linked."""
    e = edges(spark, sf_dir)
    back = graph.reach(e, _seeds(spark), 3, reverse=True)
    heat = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("heat"))
    r = back.join(heat, "node", "left").groupBy("node").agg(F.round(F.sum(F.coalesce("heat", F.lit(1)) / F.greatest("depth", F.lit(1))), 2).alias("risk"))
    return r


def g15_degrees(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    e = edges(spark, sf_dir)
    o, i = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return o.join(i, "node", "full_outer").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def j16_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings looked up along region <- nation <- supplier: the nearest level that defines each."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    parents = s.select(F.concat(F.lit("s"), "s_suppkey").alias("cls"), F.concat(F.lit("n"), "s_nationkey").alias("parent")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("cls"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    methods = spark.createDataFrame([("r0", "policy"), ("r1", "policy"), ("n3", "policy"), ("n7", "policy")], "cls string, method string")
    calls = s.select(F.concat(F.lit("x"), "s_suppkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("cls"), F.lit("policy").alias("method"))
    return graph.resolve_inherited(calls, methods, parents).select("src", "target")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "gj" and k[1:3].isdigit()}
QUERIES |= {f"{f.__name__}_pages": partial(f, edges=page_edges) for f in (g02_neighbours, g04_path, g05_trace, g06_callers, g07_cycles, g09_signature, g13_impact, g15_degrees)}
_D = "documents where text is not null"
_E = f"e as (select distinct src, dst from (select regexp_replace(regexp_replace(path, '\\.md$', ''), '-[0-9]+$', '') src, unnest({SQL_LINKS}) dst from {_D}) where src like 'concepts/%' and src <> dst)"
_S = "s as (select unnest(['concepts/lint-suite', 'concepts/retry-queue']) seed)"
_REACH = "r(seed, node, depth) as (select seed, b, 1 from s join x on a = seed union select seed, b, depth + 1 from r join x on a = node where depth < {depth}), m as (select seed, node, min(depth) depth from r group by 1, 2)"
ORACLES = {
    "g01_nodes": f"with t as (select distinct regexp_replace(regexp_replace(path, '\\.md$', ''), '-[0-9]+$', '') id from {_D} and path is not null) select 'node:topic' kind, count(*) n from t union all select 'node:document', count(*) from {_D} union all select 'node:source', count(*) from (select distinct source from {_D}) union all select 'edge:wikilink', count(*) from (select distinct doc_id, l from (select doc_id, unnest({SQL_LINKS}) l from {_D}) where l in (select id from t)) union all select 'edge:contains', count(*) from {_D} and source is not null",
    "g02_neighbours": f"with recursive {_E}, {_S}, x as (select src a, dst b from e union select dst, src from e), {_REACH.format(depth=2)} select * from m where node <> seed",
    "g04_path": f"with recursive {_E}, s as (select 'concepts/lint-suite' seed), x as (select src a, dst b from e union select dst, src from e), {_REACH.format(depth=6)} select min(depth) steps from m where node = 'concepts/retry-queue'",
    "g05_trace": f"with recursive {_E}, t(cur, path, cyc, d) as (select 'concepts/lint-suite', ['concepts/lint-suite'], false, 0 union all select dst, list_append(path, dst), list_contains(path, dst), d + 1 from t join e on src = cur where not cyc and d < 2) select array_to_string(path, '>') path, case when cyc then 'cycle' when cur not in (select src from e) then 'end' else 'depth' end leaf from t where cyc or d = 2 or cur not in (select src from e)",
    "g06_callers": f"with recursive {_E}, {_S}, x as (select dst a, src b from e), {_REACH.format(depth=6)} select * from m",
    "g07_cycles": f"with recursive {_E}, x as (select src a, dst b from e where dst in (select src from e)), c(a, b) as (select a, b from x union select c.a, x.b from c join x on c.b = x.a), p as (select c.a, c.b from c join c d on c.a = d.b and c.b = d.a where c.a <> c.b) select a node, least(a, min(b)) component from p group by a",
    "g09_signature": f"with {_E} select count(*) edges, sum(('0x' || substr(md5(src || '>' || dst), 1, 8))::bigint)::double signature from e",
    "g11_merge_risk": "with f as (select distinct l_suppkey branch, l_partkey path, p_brand from lineitem join part on l_partkey = p_partkey), s as (select path from f group by 1 having count(*) > 1) select branch, count(*) files, count(distinct p_brand) communities, count(*) filter (path in (select path from s)) conflicts from f group by 1",
    "g13_impact": f"with recursive {_E}, {_S}, x as (select dst a, src b from e), {_REACH.format(depth=3)}, h as (select dst node, count(*) heat from e group by 1) select node, round(sum(coalesce(heat, 1) / greatest(depth, 1)), 2) risk from m left join h using (node) group by 1",
    "g15_degrees": f"with {_E} select coalesce(o.n, i.n) node, coalesce(od, 0) out_degree, coalesce(idg, 0) in_degree from (select src n, count(*) od from e group by 1) o full join (select dst n, count(*) idg from e group by 1) i on o.n = i.n",
    "j16_inherited": "select 'x' || s_suppkey src, case when s_nationkey in (3, 7) then 'n' || s_nationkey when n_regionkey in (0, 1) then 'r' || n_regionkey else 's' || s_suppkey end target from supplier join nation on s_nationkey = n_nationkey",
}
