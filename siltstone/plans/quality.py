"""Queries of the checks, exports and incremental pipelines."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import lint, ranking
from siltstone.plans.analytics import AS_OF
from siltstone.plans.graphs import Edges, page_edges, topic_edges
from siltstone.plans.text import SQL_BODY, SQL_LINKS, docs, field_sql
from siltstone.session import table
from siltstone.sources import sinks
from siltstone.streaming import pipelines


def corpus(spark: SparkSession, sf_dir: str) -> lint.Corpus:
    """The driver tables as a corpus: documents as pages, source documents as logs read again and again."""
    pages = docs(spark, sf_dir).where("path is not null").select("path", "slug", "text")
    s = table(spark, sf_dir, "source_documents").where("path is not null").select("source_id", F.col("path").alias("name"), F.coalesce(T.content_hash(F.col("content")), F.lit("none")).alias("hash"), "frontmatter")
    chunks = table(spark, sf_dir, "daily_chunks").where("source_file is not null").select(F.col("source_file").alias("path"))
    e = table(spark, sf_dir, "embeddings")
    h = table(spark, sf_dir, "whisper_history").where("mode = 'verbatim' and enhanced_prompt is not null")
    return lint.Corpus(
        pages=pages,
        files=pages.select("path").unionByName(s.select(F.col("name").alias("path"))).unionByName(chunks).distinct(),
        logs=s.groupBy("name").agg(F.max_by("hash", "source_id").alias("hash")),
        compiled=s.where("frontmatter is not null").groupBy("name").agg(F.min_by("hash", "source_id").alias("hash")),
        declared=pages.where("path like 'daily/%'").select(F.col("path").alias("key")).distinct(),
        ingested=chunks.select(F.col("path").alias("key")).distinct(),
        indexed=table(spark, sf_dir, "article_zones").where("slug is not null").select("slug"),
        similar=ranking.vector_search(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), threshold=0.35).select(F.col("query_key").cast("string").alias("slug_a"), F.col("key").cast("string").alias("slug_b"), "cosine"),
        accesses=h.select(F.explode(T.wikilinks(F.col("enhanced_prompt"))).alias("slug")).groupBy("slug").agg(F.count("*").alias("n")),
        today=AS_OF,
    )


def lint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues per check and severity over all documents, all thirteen checks."""
    return lint.report(corpus(spark, sf_dir)).groupBy("severity", "check").agg(F.count("*").alias("n"))


def lint_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that fixers changed, with the number of fixes made and tried."""
    c = corpus(spark, sf_dir)
    issues = lint.report(c, ["broken_link", "missing_backlink", "memory_type", "source_anchor"])
    return lint.apply_fixes(c.pages, issues, files=c.files).select("path", F.md5("text").alias("text_md5"), "fixed", "attempted")


def lint_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs as last compiled, with the hash of stale ones emptied."""
    c = corpus(spark, sf_dir)
    return lint.fix_stale(c.compiled, lint.report(c, ["stale_article"]))


def lint_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of articles in lower case, each with the first article that has it."""
    a = table(spark, sf_dir, "articles").where("slug is not null").select(F.col("article_id").alias("seq"), "slug", "title", F.lit(None).cast("array<string>").alias("aliases"))
    return lint.title_index(a)


def lint_crosslinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages whose prose names topics they do not link to, with the number of links added."""
    names = table(spark, sf_dir, "articles").where("slug is not null").select(F.col("article_id").alias("seq"), F.regexp_extract("slug", r"^([a-z]+/[a-z]+-[a-z]+)", 1).alias("slug"), F.regexp_extract("title", "^([A-Za-z]+ [A-Za-z]+)", 1).alias("title"), F.lit(None).cast("array<string>").alias("aliases"))
    pages = docs(spark, sf_dir).where("path is not null").groupBy("path", "slug").agg(F.min_by("text", "doc_id").alias("text"))
    return lint.crosslinked(pages, lint.title_index(names)).select("path", F.col("n_links").cast("bigint").alias("n_links"), F.md5("text").alias("text_md5"))


def j26_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known topic most like each stale slug of the old duplicate list."""
    wanted = table(spark, sf_dir, "duplicate_pairs").select(F.col("slug_a").alias("target")).where("target is not null").distinct()
    return lint.best_matches(wanted, table(spark, sf_dir, "articles").where("slug is not null").select("slug"), 0.9)


def k12_graphml(spark: SparkSession, sf_dir: str, edges: Edges = topic_edges) -> DataFrame:
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return sinks.graphml(nodes, e).select(F.col("seq").cast("bigint").alias("seq"), "line")


def k02_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "article_zones").where("observed is not null")
    return z.select("zone_id", sinks.content_version("slug", "observed").alias("version"))


def r04_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user coalesced until half an hour was quiet."""
    e = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("kind"), F.col("event_type").alias("path"))
    s = pipelines.debounce(e, "30 minutes")
    return s.groupBy("kind").agg(F.count("*").alias("sessions"), F.max("n_changes").alias("longest")).select(F.col("kind").alias("user_id"), "sessions", "longest")


def r05_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions' imports as a queue: which are corrupt, exhausted, leased or ready."""
    s = table(spark, sf_dir, "agent_sessions")
    now = 1_767_225_600
    jobs = s.select(F.col("import_id").alias("job_id"), F.unix_seconds(F.col("imported_at").cast("timestamp")).alias("created_at"), F.unix_seconds(F.col("imported_at").cast("timestamp")).alias("spawned_at"), F.pmod("import_id", F.lit(7)).alias("attempts"), F.col("cwd").alias("context"))
    return pipelines.lease_queue(jobs, now, 30 * 86400).groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (lint_totals, lint_fixed, lint_restarted, lint_titles, lint_crosslinked, j26_fuzzy, k12_graphml, k02_versions, r04_sessions, r05_queue)}
QUERIES["k12_graphml_pages"] = partial(k12_graphml, edges=page_edges)
_D = "documents where text is not null and path is not null"
_SLUG = "regexp_replace(path, '\\.md$', '')"
_L = f"(select path, {_SLUG} slug, unnest({SQL_LINKS}) target from {_D})"
_W = "[ \\t\\n\\x0b\\f\\r]+"
_DAY = lambda k: f"try_strptime(case when regexp_matches({field_sql(k)}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then {field_sql(k)} end, '%Y-%m-%d')::date"
_HASH = "coalesce(substr(sha256(content), 1, 16), 'none')"
_LOGS = f"logs as (select path name, arg_max({_HASH}, source_id) h from source_documents where path is not null group by 1), compiled as (select path name, arg_min({_HASH}, source_id) h from source_documents where path is not null and frontmatter is not null group by 1)"
_CLEAN = "regexp_replace(text, '(?s)<!--.*?-->', '', 'g')"
_EDGES = f"(select distinct src, dst from (select regexp_replace({_SLUG}, '-[0-9]+$', '') src, unnest({SQL_LINKS}) dst from documents where text is not null) where src like 'concepts/%' and src <> dst)"
_X = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
ORACLES = {
    "lint_totals": f"""with k as (select distinct {_SLUG} slug from {_D}), l as {_L}, {_LOGS},
 files as (select path from {_D} union select path from source_documents where path is not null union select source_file from daily_chunks where source_file is not null),
 seen as (select unnest(regexp_extract_all(regexp_replace(enhanced_prompt, '(?s)<!--.*?-->', '', 'g'), '\\[\\[([^\\]]+)\\]\\]', 1)) slug from whisper_history where mode = 'verbatim' and enhanced_prompt is not null), i as (
 select 'error' severity, 'broken_link' \"check\" from l where regexp_matches(target, '^(?:concepts|connections|qa)/') and target not in (select slug from k)
 union all select 'warning', 'orphan_page' from {_D} and {_SLUG} not in (select target from l)
 union all select 'warning', 'orphan_source' from logs where name not in (select name from compiled)
 union all select 'warning', 'orphan_source_file' from (select distinct path from {_D} and path like 'daily/%') where path not in (select source_file from daily_chunks where source_file is not null)
 union all select 'warning', 'stale_article' from logs join compiled using (name) where logs.h <> compiled.h
 union all select 'suggestion', 'missing_backlink' from (select distinct path, slug, target from l where slug <> target and regexp_matches(target, '^(?:concepts|connections|qa)/') and target in (select slug from k)) e where not exists (select 1 from l b where b.slug = e.target and b.target = e.slug)
 union all select 'suggestion', 'sparse_article' from (select regexp_replace(regexp_replace({SQL_BODY}, '\\A{_W}', ''), '{_W}\\z', '') b from {_D}) where case when b = '' then 0 else len(regexp_split_to_array(b, '{_W}')) end < 200
 union all select 'suggestion', 'missing_source_anchor' from {_D} and not regexp_matches(text, '\\[src:[^\\]]+\\]')
 union all select 'error', 'broken_source_anchor' from (select unnest(regexp_extract_all(text, '\\[src:([^\\]]+)\\]', 1)) a from {_D}) where a not in (select path from files)
 union all select 'error', 'invalid_wikilink_relation' from (select unnest(regexp_extract_all({_CLEAN}, '\\[\\[([^\\]]+)\\]\\](?:\\{{([a-z0-9_]+)\\}})?', 2)) r from {_D}) where r <> '' and r not in ('depends_on', 'implements', 'conflicts_with', 'supersedes', 'related_to', 'blocks', 'corroborates', 'refutes')
 union all select case when t is null then 'suggestion' else 'error' end, case when t is null then 'missing_memory_type' else 'invalid_memory_type' end from (select {field_sql('type')} t from {_D}) where t is null or t not in ('fact', 'event', 'discovery', 'preference', 'advice', 'decision', 'tension', 'hypothesis')
 union all select 'warning', 'near_duplicate' from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0 and list_cosine_similarity(q.embedding::double[], e.embedding::double[]) >= 0.35 - 1e-9
 union all select 'warning', 'stale_vector' from (select distinct slug from article_zones where slug is not null) where slug not in (select slug from k)
 union all select 'suggestion', 'low_priority_article' from (select {_SLUG} slug, coalesce({_DAY('updated')}, {_DAY('created')}) d, {field_sql('pinned')} pin from {_D}) where coalesce(lower(pin), '') <> 'true' and date '{AS_OF}' - d > 90 and slug not in (select slug from seen))
 select severity, \"check\", count(*) n from i group by 1, 2""",
    "lint_restarted": f"with {_LOGS} select name, case when l.h <> c.h then '' else c.h end hash from compiled c join logs l using (name)",
    "lint_titles": "select lower(trim(title)) name, arg_min(slug, article_id) slug from articles where slug is not null and length(trim(title)) >= 4 group by 1",
    "k12_graphml": f"with e as {_EDGES} select 0 seq, '<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\"><graph edgedefault=\"directed\">' line union all select 3, '</graph></graphml>' union all select 1, '<node id=\"' || {_X('id')} || '\"/>' from (select src id from e union select dst from e) union all select 2, '<edge source=\"' || {_X('src')} || '\" target=\"' || {_X('dst')} || '\"/>' from e",
    "k02_versions": "select zone_id, slug || '::v' || substr(sha256(coalesce(slug, '') || chr(0) || observed), 1, 16) version from article_zones where observed is not null",
    "r04_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over w > interval 30 minutes or lag(ts) over w is null then 1 else 0 end f from events window w as (partition by user_id order by ts)), s as (select user_id, sum(f) over (partition by user_id order by ts) sid from g), c as (select user_id, sid, count(*) n from s group by 1, 2) select user_id, count(*) sessions, max(n) longest from c group by 1",
    "r05_queue": "select case when cwd is null or imported_at is null then 'corrupt' when import_id % 7 >= 5 then 'exhausted' when epoch(imported_at) > 1767225600 - 30 * 86400 then 'leased' else 'ready' end state, count(*) n from agent_sessions group by 1",
}
