"""Queries of the writers: exports of the link graph and reports as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.analytics import ORACLES as ANALYTICS
from siltstone.plans.analytics import a16_feedback
from siltstone.plans.extras import ORACLES as EXTRAS
from siltstone.plans.extras import j11_preflight
from siltstone.plans.graphs import page_edges
from siltstone.plans.text import SQL_LINKS, docs
from siltstone.session import table
from siltstone.sources import benchmark, sinks


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = page_edges(spark, sf_dir)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("seq").cast("bigint").alias("seq"), "line")


def k12_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(sinks.cypher(*_graph(spark, sf_dir)))


def k12_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(sinks.graph_json(*_graph(spark, sf_dir)))


def k12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(sinks.graph_html(*_graph(spark, sf_dir)))


def k13_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page as a flow chart."""
    return _lines(sinks.mermaid(_graph(spark, sf_dir)[1]))


def k14_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of feedback: contested users first, then trusted ones."""
    s = a16_feedback(spark, sf_dir)
    rows = s.select(F.concat(F.lit("u"), "user_id").alias("slug"), "score", "useful", "dead_end", "corrected", F.concat(F.lit("event|"), "last_event").alias("last_note"))
    return sinks.lessons(rows).select(F.col("seq").cast("bigint").alias("seq"), "slug", "line")


def k14_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on known-answer checks over prompts: entries that must hold their transcript's first word."""
    w = table(spark, sf_dir, "whisper_history").where("mode = 'clean'")
    first = F.regexp_extract(F.lower("transcript"), "^([a-z]+)", 1)
    ok = F.contains(F.lower("enhanced_prompt"), first)
    rows = w.select(F.col("entry_id").cast("string").alias("id"), ok.alias("passed"), F.when(ok, F.array().cast("array<string>")).otherwise(F.array(first)).alias("missing"), F.array().cast("array<string>").alias("forbidden"), F.col("enhanced_prompt").alias("answer"), F.when(F.col("enhanced_prompt").isNull(), "no answer").alias("error"))
    out = _lines(sinks.canary_report(rows, "2026-01-01"))
    return out.groupBy("seq").agg(F.count("*").alias("lines"), F.min("line").alias("least"))


def p24_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents most like a held-out passage as a block of candidates."""
    j = j11_preflight(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "path"), "doc_id")
    return _lines(sinks.preflight_block(j.select(F.concat(F.lit("doc/"), "doc_id").alias("slug"), F.col("path").alias("title"), F.col("score").alias("similarity"))))


def p26_whole_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything there is to read, in order: an index of paths, then every page under its name."""
    d = docs(spark, sf_dir).where("path is not null")
    index = d.agg(F.concat(F.lit("pages: "), F.count("*").cast("string")).alias("text"))
    return sinks.whole_content(index, d.select("path", "text")).select(F.col("seq").cast("bigint").alias("seq"), "path", F.md5("part").alias("part_md5"))


def s23_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-answer checks of the benchmark's questions: whether a document answers with the words asked for."""
    q = table(spark, sf_dir, "benchmark_items").select(F.col("item_id").cast("string").alias("id"), "question", F.array(F.regexp_extract(F.lower("question"), r"([a-z]+) ([a-z]+)\W*$", 0)).alias("must_contain"), F.array(F.lit("zzz")).alias("must_not_contain"))
    a = table(spark, sf_dir, "benchmark_items").select(F.col("item_id").cast("string").alias("id"), F.concat_ws(" ", "passage", F.when(F.col("item_id") % 2 == 0, F.col("question"))).alias("answer"))
    return benchmark.check_answers(a, q).select("id", "passed")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "kps" and k[1:3].isdigit()}

_EDGES = f"e as (select distinct src, dst from (select coalesce(regexp_replace(path, '\\.md$', ''), 'doc/' || doc_id) src, unnest({SQL_LINKS}) dst from documents where text is not null union all select regexp_replace(slug, '-[0-9]+$', ''), slug from (select regexp_replace(path, '\\.md$', '') slug from documents where text is not null and path is not null) where regexp_replace(slug, '-[0-9]+$', '') <> slug) where src is not null and dst is not null), n as (select src id from e union select dst from e)"
_X = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_C = lambda c: f"replace(replace({c}, '\\', '\\\\'), '''', '\\''')"
_M = lambda c: f"'n_' || substr(md5({c}), 1, 12) || '[\"' || replace(replace({c}, '\"', '#quot;'), chr(10), ' ') || '\"]'"
ORACLES = {
    "k12_cypher": f"with {_EDGES} select 1 seq, 'MERGE (:Node {{id: ''' || {_C('id')} || '''}});' line from n union all select 2, 'MATCH (a:Node {{id: ''' || {_C('src')} || '''}}), (b:Node {{id: ''' || {_C('dst')} || '''}}) MERGE (a)-[:LINK]->(b);' from e",
    "k12_json": f"with {_EDGES} select 0 seq, '{{\"nodes\": [' line union all select 2, 'null], \"edges\": [' union all select 4, 'null]}}' union all select 1, json_object('id', id)::varchar || ',' from n union all select 3, json_object('from', src, 'to', dst)::varchar || ',' from e",
    "k12_html": f"""with {_EDGES} select 0 seq, '<!doctype html><html><head><meta charset="utf-8"><title>Graph</title></head><body><h1>Graph</h1><table id="nodes"><tr><th>node</th></tr>' line union all select 2, '</table><table id="edges"><tr><th>from</th><th>to</th></tr>' union all select 4, '</table></body></html>'
 union all select 1, '<tr><td>' || {_X('id')} || '</td></tr>' from n union all select 3, '<tr><td>' || {_X('src')} || '</td><td>' || {_X('dst')} || '</td></tr>' from e""",
    "k13_mermaid": f"with {_EDGES} select 0 seq, 'flowchart LR' line union all select distinct 1, '  ' || {_M('src')} || ' --> ' || {_M('dst')} from e",
    "k14_lessons": f"""with s as ({ANALYTICS['a16_feedback']}) select 0 seq, '' slug, '## Contested (' || count(*) filter (score < 0.4) || ')' line from s union all select 2, '', '## Trusted (' || count(*) filter (score >= 0.7) || ')' from s
 union all select 1, 'u' || user_id, '| [[u' || user_id || ']] | ' || printf('%.2f', score) || ' | ' || corrected || ' | ' || dead_end || ' | ' || useful || ' | event\\|' || last_event || ' |' from s where score < 0.4
 union all select 3, 'u' || user_id, '| [[u' || user_id || ']] | ' || printf('%.2f', score) || ' | ' || useful || ' | ' || dead_end || ' | ' || corrected || ' |' from s where score >= 0.7""",
    "k14_canaries": """with w as (select entry_id::varchar id, enhanced_prompt a, regexp_extract(lower(transcript), '^([a-z]+)', 1) f from whisper_history where mode = 'clean'), s as (select *, case when a is null then 3 when contains(lower(a), f) then 7 else 5 end seq from w),
 l as (select seq, case seq when 3 then '- **' || id || '**: no answer' when 7 then '- ' || id else '### ' || id || chr(10) || chr(10) || '**Missing substrings:** ' || f || chr(10) || chr(10) || '> ' || replace(a, chr(10), chr(10) || '> ') end line from s
 union all select distinct seq - 1, case seq when 3 then '## Errored Canaries' when 5 then '## Failed Canaries' else '## Passed Canaries' end from s union all select 0, '# Canary Report - 2026-01-01' union all select 1, '**Total:** ' || count(*) || ' canaries | Passed: ' || count(*) filter (seq = 7) || ' | Failed: ' || count(*) filter (seq = 5) || ' | Errored: ' || count(*) filter (seq = 3) from s)
 select seq, count(*) lines, min(line) least from l group by 1""",
    "p24_preflight": f"with j as ({EXTRAS['j11_preflight']}) select 0 seq, '## Closest existing articles (possible duplicates)' line where exists (select 1 from j) union all select 1, '- `doc/' || doc_id || '` (similarity ' || printf('%.2f', score) || ')' || coalesce(' - ' || path, '') from j join documents using (doc_id)",
    "p26_whole_content": "with d as (select path, text from documents where text is not null and path is not null) select 0 seq, '' path, md5('## INDEX' || chr(10) || chr(10) || 'pages: ' || count(*)) part_md5 from d union all select case split_part(path, '/', 1) when 'concepts' then 1 when 'connections' then 2 else 3 end, path, md5('## ' || path || chr(10) || chr(10) || text) from d where regexp_matches(path, '^(?:concepts|connections|qa)/')",
    "s23_questions": "select item_id::varchar id, contains(lower(concat_ws(' ', passage, case when item_id % 2 = 0 then question end)), regexp_extract(lower(question), '([a-z]+) ([a-z]+)\\W*$')) and not contains(lower(concat_ws(' ', passage, case when item_id % 2 = 0 then question end)), 'zzz') passed from benchmark_items",
}
