"""Queries over agent histories, tool events, branches and retries.

Readers see JSON lines that are written here from the driver's tables, so that parser and
operator are checked end to end at any scale; the SQL works from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import changes, ranking
from siltstone.plans.search import bm25_sql
from siltstone.session import table
from siltstone.sources import files
from siltstone.streaming import pipelines


def history_lines(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """(path, line_no, value): each user's events as lines of an agent's history in one of the dialects, bad lines between."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit(f"{dialect}/"), "user_id").alias("path"), "user_id", F.col("event_id").alias("line_no"), "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").otherwise("system")
    text = F.concat("event_type", F.lit(" "), F.col("line_no").cast("string"))
    block = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), text.alias("text")))
    if dialect == "typed":
        v = F.struct(role.alias("type"), F.concat(F.lit("s"), "user_id").alias("sessionId"), F.lit("/w").alias("cwd"), F.col("ts").alias("timestamp"), F.struct(role.alias("role"), block("text").alias("content")).alias("message"))
    else:
        v = F.struct(F.col("ts").alias("timestamp"), F.struct(F.lit("message").alias("type"), F.concat(F.lit("s"), "user_id").alias("id"), F.lit("/w").alias("cwd"), role.alias("role"), block("input_text").alias("content")).alias("payload"))
    return e.select("path", "line_no", F.when(F.col("event_type") == "error", "{broken").otherwise(F.to_json(v)).alias("value"))


def _sessions(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    s = files.agent_sessions(history_lines(spark, sf_dir, dialect), dialect)
    return s.select("path", "session_id", "cwd", "started_at", F.size("turns").cast("bigint").alias("turns"), F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), ";").alias("talk"))


def s12_typed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the first dialect: id, folder, start and turns in order."""
    return _sessions(spark, sf_dir, "typed")


def s12_payload_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of the second dialect."""
    return _sessions(spark, sf_dir, "payload")


def s09_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns of the lines of a transcript."""
    t = files.transcript_lines(history_lines(spark, sf_dir, "typed"))
    return t.select("path", F.col("line_no").cast("bigint").alias("line_no"), "role", "text", "ts")


def s10_tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls per session and tool, malformed lines and values that are no objects skipped."""
    e = table(spark, sf_dir, "events")
    v = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_type").alias("tool"), F.from_json("props", "map<string,string>").alias("input"), F.col("event_id").alias("result_size"), (F.col("event_type") != "error").alias("ok")))
    line = F.when(F.col("event_id") % 11 == 0, "[1, 2]").when(F.col("event_id") % 13 == 0, "{oops").otherwise(v)
    t = files.tool_calls(e.select(line.alias("value")))
    return t.groupBy("session_id", "tool").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.max("result_size").alias("largest"))


def r02_fresh_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 200 characters of every user's events after its cursor."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("text"))
    cursors = e.groupBy("session_id").agg(F.floor(F.avg("ordinal")).alias("cursor")).where("session_id <> 's1'")
    return pipelines.fresh_window(e, cursors, 200).select("session_id", "ordinal", F.col("used").cast("bigint").alias("used"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a source as an attempt; one without a time has failed."""
    s = table(spark, sf_dir, "source_documents").where("path is not null")
    return s.select("path", "source_id", F.coalesce(T.content_hash(F.col("content")), F.lit("none")).alias("hash"), F.col("mtime").isNull().alias("failed"))


def r08_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each source's present content; a changed hash or a success starts anew."""
    return changes.failure_counts(_readings(spark, sf_dir), "path", "hash", "source_id", "failed")


def f16_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that may be tried: not those whose content is unchanged and has failed."""
    r = _readings(spark, sf_dir)
    now = r.groupBy("path").agg(F.max_by("hash", "source_id").alias("hash"))
    return changes.retry_gate(now, changes.failure_counts(r, "path", "hash", "source_id", "failed"), "path", "hash", 1)


def a30_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many logs and source files were ingested."""
    n = table(spark, sf_dir, "daily_chunks").where("source_file is not null").agg(F.countDistinct("source_file").alias("daily"))
    m = table(spark, sf_dir, "source_documents").where("path is not null").agg(F.countDistinct("path").alias("sources"))
    return n.join(m).select("daily", "sources", (F.col("daily") + F.col("sources")).alias("total"))  # one row each


def f01_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones for each question: not quarantined, of confidence 0.4 and more, of type fact, the observed zone; statistics over all."""
    z = table(spark, sf_dir, "article_zones")
    each = z.select("zone_id", "slug", F.explode(F.array(F.struct(F.lit("observed").alias("zone"), F.col("observed").alias("body")), F.struct(F.lit("synthesized").alias("zone"), F.col("synthesized").alias("body")))).alias("x"))
    corpus = each.select(F.concat_ws("::", F.col("zone_id").cast("string"), "x.zone").alias("key"), "slug", "x.zone", "x.body").where("body is not null")
    flags = table(spark, sf_dir, "articles").where("slug is not null").groupBy("slug").agg(F.max_by(F.struct("type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("quarantined", F.lit(False)).alias("quarantined")), "article_id").alias("m"))
    keep = corpus.join(flags, "slug").where("not m.quarantined and m.confidence >= 0.4 and m.type = 'fact' and zone = 'observed'").select("key")
    hits = ranking.bm25(corpus, "key", "body", table(spark, sf_dir, "benchmark_items"), "item_id", "question", None).join(keep, "key", "left_semi")
    return ranking.top(hits, "item_id", "key", 5).select("item_id", "key", "score", F.col("rank").cast("bigint").alias("rank"))


def p12_slim_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as slim hits: snippet, title or slug, and the metadata that readers get."""
    m = F.create_map(*[x for c in ("type", "confidence", "host_tz") for x in (F.lit(c), F.col(c).cast("string"))])
    hit = T.slim_hit(F.col("excerpt"), F.when(F.col("article_id") % 5 == 0, "").otherwise(F.col("title")), F.col("slug"), m)
    return table(spark, sf_dir, "articles").select("article_id", hit.alias("h")).select("article_id", "h.slug", "h.title", "h.snippet", F.array_join(F.array_sort(F.map_keys("h.metadata")), ",").alias("metadata"))


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(touched, ancestry, member): suppliers as branches over parts; a branch's ancestors are its number halved again and again."""
    touched = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("branch"), F.col("l_partkey").alias("path")).distinct()
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("branch"))
    up = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.log2(F.col("branch"))).cast("int")))).where("k >= 1 and branch > 1")
    ancestry = up.select(F.floor(F.col("branch") / F.pow(F.lit(2), F.col("k"))).cast("bigint").alias("ancestor"), "branch")
    return touched, ancestry, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("community"))


def a22_tip_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that at least two independent branches touch."""
    touched, ancestry, _ = _branches(spark, sf_dir)
    return changes.conflicts(touched, ancestry)


def j20_unrelated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of branches that share a community and of which none is the other's ancestor."""
    touched, ancestry, member = _branches(spark, sf_dir)
    return changes.branch_pairs(touched, member, ancestry)


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "afjprs" and k[1:3].isdigit()}

_ROLE = "case event_type when 'click' then 'user' when 'view' then 'assistant' else 'system' end"
_TALK = f"select user_id, event_id, {_ROLE} r, event_type || ' ' || event_id t, strftime(ts, '%Y-%m-%dT%H:%M:%S') at_ from events where event_type <> 'error'"


def _sessions_sql(dialect: str) -> str:
    return f"select '{dialect}/' || user_id path, 's' || user_id session_id, '/w' cwd, arg_min(at_, event_id) started_at, count(*) filter (r <> 'system') turns, coalesce(string_agg(r || ':' || t, ';' order by event_id) filter (r <> 'system'), '') talk from ({_TALK}) group by user_id"


_ANCESTRY = "anc as (select s_suppkey >> k::int ancestor, s_suppkey branch from supplier, range(1, 63) r(k) where s_suppkey > 1 and s_suppkey >> k::int > 0)"
_FLAGS = "(select slug, type t, coalesce(confidence, 0.5) c, coalesce(quarantined, false) q from articles where slug is not null qualify row_number() over (partition by slug order by article_id desc) = 1)"
_ZONES = "select zone_id || '::' || zone id, body, slug, zone from (select zone_id, slug, 'observed' zone, observed body from article_zones union all select zone_id, slug, 'synthesized', synthesized from article_zones) where body is not null"
_READ = "(select path, source_id, coalesce(substr(sha256(content), 1, 16), 'none') h, mtime is null f from source_documents where path is not null)"
_FAILS = f"fails as (with r as {_READ}, l as (select path, arg_max(h, source_id) last from r group by 1), x as (select path, max(source_id) filter (h <> last or not f) at_ from r join l using (path) group by 1) select l.path, l.last hash, count(*) filter (at_ is null or source_id > at_) attempts from l join x using (path) join r on r.path = l.path group by 1, 2)"
ORACLES = {
    "s12_typed_sessions": _sessions_sql("typed"),
    "s12_payload_sessions": _sessions_sql("payload"),
    "s09_transcripts": f"select 'typed/' || user_id path, event_id line_no, r \"role\", t \"text\", at_ ts from ({_TALK}) where r <> 'system'",
    "s10_tool_events": "select 's' || user_id session_id, event_type tool, count(*) calls, count(*) filter (event_type <> 'error') ok, max(event_id) largest from events where event_id % 11 <> 0 and event_id % 13 <> 0 group by 1, 2",
    "r02_fresh_window": "with e as (select 's' || user_id session_id, event_id ordinal, length(event_type) + 1 c from events), k as (select session_id, case when session_id = 's1' then 0 else floor(avg(ordinal)) end at_ from e group by 1) select session_id, ordinal, sum(c) over (partition by session_id order by ordinal) used from e join k using (session_id) where ordinal >= at_ qualify used <= 200",
    "r08_failures": f"with {_FAILS} select path, hash, attempts from fails",
    "f16_retries": f"with {_FAILS} select path, hash from fails where attempts < 1",
    "a30_ingested": "select d daily, s sources, d + s total from (select count(distinct source_file) d from daily_chunks), (select count(distinct path) s from source_documents)",
    "f01_filtered": f"with {bm25_sql(f'select id, body from ({_ZONES})', 'select item_id qid, question q from benchmark_items')}, k as (select id from ({_ZONES}) join {_FLAGS} using (slug) where not q and c >= 0.4 and t = 'fact' and zone = 'observed') select qid item_id, id \"key\", score, row_number() over (partition by qid order by score desc, id) rank from hits where id in (select id from k) qualify rank <= 5",
    "p12_slim_hits": "with a as (select *, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) f from articles) select article_id, slug, case when article_id % 5 = 0 or trim(title) = '' or title is null then slug else trim(title) end title, case when length(f) <= 220 then f else rtrim(substr(f, 1, 220)) || '…' end snippet, array_to_string(list_filter([case when confidence is not null then 'confidence' end, case when type is not null then 'type' end], lambda x: x is not null), ',') metadata from a",
    "a22_tip_conflicts": f"with {_ANCESTRY}, t as (select distinct l_suppkey branch, l_partkey path from lineitem) select path, count(*) branches from t x where not exists (select 1 from anc join t y on y.branch = anc.branch where anc.ancestor = x.branch and y.path = x.path) group by 1 having count(*) >= 2",
    "j20_unrelated_pairs": f"with {_ANCESTRY}, b as (select l_suppkey branch, p_brand community, count(distinct l_partkey) n, min(l_partkey) one from lineitem join part on l_partkey = p_partkey group by 1, 2) select x.branch a, y.branch b, count(*) shared from b x join b y using (community) where x.branch < y.branch and not (x.n = 1 and y.n = 1 and x.one = y.one) and not exists (select 1 from anc where ancestor = x.branch and anc.branch = y.branch) group by 1, 2",
}
