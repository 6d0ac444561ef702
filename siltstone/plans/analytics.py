"""Joins, aggregates, ranking, scoring and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring as S
from siltstone.functions import text as T
from siltstone.operators import changes, joins, lint, selection
from siltstone.plans.text import SQL_LINKS, docs
from siltstone.session import table

AS_OF, CODE_AS_OF, EVENTS_AS_OF = "2026-03-01", "2001-08-02", "2024-01-31"
_BIG = lambda c: F.col(c).cast("bigint").alias(c)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "slug", F.explode(T.wikilinks(F.col("text"))).alias("target"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per slug: the newest scan."""
    w = Window.partitionBy("slug").orderBy(F.desc("article_id"))
    return table(spark, sf_dir, "articles").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("day", F.try_to_date(F.substring("updated", 1, 10), "yyyy-MM-dd"))


_NEWEST = "select *, try_strptime(substr(updated, 1, 10), '%Y-%m-%d')::date \"day\" from articles qualify row_number() over (partition by slug order by article_id desc) = 1"


# --- joins ---------------------------------------------------------------------------------
def j01_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "articles").where("quarantined").select("slug").distinct()
    return table(spark, sf_dir, "article_zones").join(gone, "slug", "left_anti").select("zone_id")


def j02_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "articles").where("quarantined").select("slug").distinct().withColumn("q", F.lit(True))
    return table(spark, sf_dir, "article_zones").join(gone, "slug", "left").select("zone_id", F.col("q").isNotNull().alias("quarantined"))


def j03_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = docs(spark, sf_dir).select(F.col("slug").alias("target")).distinct()
    live = _links(spark, sf_dir).where(F.col("target").rlike("^(?:concepts|connections|qa)/"))
    return live.join(known, "target", "left_anti").groupBy("doc_id", "target").agg(F.count("*").alias("n"))


def j04_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "slug").join(_links(spark, sf_dir).select(F.col("target").alias("slug")).distinct(), "slug", "left_anti").select("doc_id")


def j05_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily logs of the corpus that no chunk was made of."""
    logs = docs(spark, sf_dir).where("path like 'daily/%'").select("path").distinct()
    return logs.join(table(spark, sf_dir, "daily_chunks").select(F.col("source_file").alias("path")).distinct(), "path", "left_anti")


def j06_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source documents read more than once whose content differs from the first reading."""
    s = table(spark, sf_dir, "source_documents").where("path is not null")
    first = s.groupBy("path").agg(F.min(F.struct("source_id", "content")).alias("f"))
    return s.join(first, "path").where(T.content_hash(F.col("content")) != T.content_hash(F.col("f.content"))).select("source_id", "path")


def j07_missing_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic-level links a -> b without b -> a: topics are link targets and slugs without their number."""
    topic = F.regexp_replace("slug", r"-\d+$", "")
    e = _links(spark, sf_dir).select(topic.alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()
    known = docs(spark, sf_dir).select(topic.alias("dst")).distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(known, "dst", "left_semi").join(back, ["src", "dst"], "left_anti").select("src", "dst")


def j09_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_zones").select("slug").distinct().join(table(spark, sf_dir, "articles").select("slug"), "slug", "left_anti")


def j12_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges against symbol spans of the same brand: how many changes touch each span."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    spans = p.select(F.col("p_brand").alias("file"), "p_partkey", F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"))
    changed = li.select("l_partkey", F.col("l_linenumber").cast("bigint").alias("n")).distinct().join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("file"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("n")).alias("end"))
    return joins.overlap_join(spans, changed, "file", 64).groupBy("p_partkey").agg(F.count("*").alias("touches"))


def j13_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every error the last click of the user within the hour before."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'error'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'click'").select("user_id", "us", F.col("event_id").alias("click_id"))
    return joins.asof_join(left, right, "user_id", "us", 3_600_000_000, "click_id").select("event_id", "click_id", "right_time")


def j20_branch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as branches that touch files of the same community (brand): pairs with the number shared.

    A pair meets once with all its communities, block by block, and is not moved.
    """
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    b = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("branch"), F.col("p_brand").alias("community")).distinct()
    return changes.sharing_pairs(b)


def j21_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many topics, named by the first two words of articles' titles, the prose of each document mentions."""
    d = docs(spark, sf_dir).select("doc_id", T.prose_only(F.col("text")).alias("prose"))
    found = joins.mentions(d, "doc_id", "prose", table(spark, sf_dir, "articles").select(F.regexp_extract("title", "^([A-Za-z]+ [A-Za-z]+)", 1).alias("name")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_names"))


def j27_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context links of prompts split into those whose target is a known topic and those that are not."""
    known = docs(spark, sf_dir).select(F.regexp_replace("slug", r"-\d+$", "").alias("target")).distinct().withColumn("known", F.lit(True))
    h = table(spark, sf_dir, "whisper_history").where("enhanced_prompt is not null").select("entry_id", F.explode(T.wikilinks(F.col("enhanced_prompt"))).alias("target"))
    return h.join(known, "target", "left").groupBy("entry_id").agg(F.count("known").alias("kept"), (F.count("*") - F.count("known")).alias("dropped"))


# --- filters -------------------------------------------------------------------------------
def f05_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    hay = F.lower(F.concat_ws(" ", "title", "slug", "excerpt"))
    return a.where("type = 'fact' and coalesce(confidence, 0.5) >= 0.4 and not coalesce(quarantined, false)").where(hay.contains("index")).select("article_id", "slug")


def f06_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "agent_sessions")
    return s.where((T.normal_path(F.col("cwd")) == "/home/dev/harbor-vault") & (F.substring("started_at", 1, 10) >= "2025-01-01") & (F.col("started_at").rlike("^[0-9]{4}-"))).select("import_id")


def f12_conceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "whisper_history")
    return w.where(F.col("transcript").rlike("(?i)^(?:[a-z]+ ){0,2}(?:why|how|what|explain|warum|pourquoi|por qué)")).select("entry_id")


def f13_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-answer checks over the prompts: all wanted words there, no forbidden one."""
    must, never = F.array(F.lit("skipped"), F.lit("test")), F.array(F.lit("sorry"))
    low = F.lower(F.col("enhanced_prompt"))
    w = table(spark, sf_dir, "whisper_history").where("enhanced_prompt is not null")
    passed = F.forall(must, lambda m: F.contains(low, m)) & ~F.exists(never, lambda m: F.contains(low, m))
    return w.select("entry_id", passed.alias("passed"))


def f14_safe_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.col("slug").rlike(r"^(?:concepts|connections|qa)/[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.col("slug").contains("..")
    return table(spark, sf_dir, "articles").select("article_id", safe.alias("safe"))


def f15_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    kind = F.when(p.rlike(r"^(?:concepts|connections|qa)/.*\.md$"), "article").when(p.rlike(r"^daily/.*\.md$"), "daily").when(p.rlike(r"\.(?:php|js|ts|py|twig|ya?ml)$"), "codebase").otherwise("ignore")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# --- aggregates ----------------------------------------------------------------------------
def a02_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("target not like 'daily/%'").groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("documents"))


def a05_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


def a06_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("sessions"))


def a08_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles per type, zeros included, unknown kinds together."""
    known = lint.MEMORY_TYPES
    kind = F.when(F.col("type").isin(*known), F.col("type")).otherwise("(none)")
    n = table(spark, sf_dir, "articles").groupBy(kind.alias("type")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(k,) for k in (*known, "(none)")], "type string").join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def a09_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    c = F.col("confidence")
    return a.agg(F.count("*").alias("articles"), F.count_if("quarantined").alias("quarantined"), F.count_if(c.isNull()).alias("unsure"), F.count_if(c < 0.4).alias("weak"), F.round(F.avg(F.when(c.between(0, 1), c)), 6).alias("mean_confidence"), F.sum(F.coalesce("source_count", F.lit(0))).alias("sources"), F.countDistinct("type").alias("types"))


def a17_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per kind of operation and over all, for the last day, week and month and ever: one ROLLUP."""
    e = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type").isin("purchase", "signup"), "write").when(F.col("event_type") == "error", "error").otherwise("read"))
    since = lambda d: F.col("ts") >= F.lit(d).cast("timestamp_ntz")
    total = lambda name, cond: F.round(F.sum(F.when(cond, F.col("value")).otherwise(0.0)), 4).alias(name)
    return e.rollup("op").agg(F.count("*").alias("n"), total("today", since("2024-01-30")), total("week", since("2024-01-24")), total("month", since("2024-01-01")), total("ever", F.lit(True)))


def a24_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "lang string")
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return catalog.join(n, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))


def w04_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source_file", "section").orderBy("chunk_no")
    return table(spark, sf_dir, "daily_chunks").where("source_file is not null").select("chunk_no", F.row_number().over(w).cast("bigint").alias("ordinal"))


def w05_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 50").select("user_id", "event_id", _BIG("n"))


def w09_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each transcript file, oldest first, until 4,000 characters are used."""
    t = table(spark, sf_dir, "session_turns").where("source_file is not null").groupBy("source_file", "line_no").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return selection.prefix_budget(t, "source_file", "line_no", "chars", 4000).select("source_file", _BIG("line_no"), _BIG("used"))


def w08_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by confidence into 40,000 characters, skipping what overflows."""
    a = _articles(spark, sf_dir).withColumn("chars", F.length(F.coalesce("excerpt", F.lit(""))) * 20).withColumn("pin", F.lit(False))
    return selection.greedy_budget(a.withColumn("sure", F.coalesce("confidence", F.lit(0.5))), "slug", "sure", "chars", 40_000, "pin")


# --- scores --------------------------------------------------------------------------------
def m01_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five signals of every article and its priority."""
    at = F.lit(AS_OF).cast("date")
    topic = F.regexp_extract("slug", r"^([a-z]+/[a-z]+-[a-z]+)", 1)
    inbound = _links(spark, sf_dir).groupBy(F.col("target").alias("topic")).agg(F.count("*").alias("inbound"))
    a = _articles(spark, sf_dir).withColumn("topic", topic).join(inbound, "topic", "left")
    sure = S.confidence(F.when(F.col("confidence").between(0, 1), F.col("confidence")), F.col("source_count"), F.col("day"), at)
    linked, recent, used = S.saturating(F.col("inbound"), 20), S.recency(F.col("day"), at), S.saturating(F.col("source_count"), 50)
    return a.select("slug", F.round(recent, 6).alias("recency"), F.round(linked, 6).alias("linkedness"), F.round(used, 6).alias("access"), F.round(sure, 6).alias("confidence"), F.round(S.priority(recent, linked, used, sure, F.lit(None)), 6).alias("priority"))


def a16_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime counts, last event and recency-weighted score of each user's newest fifty outcomes."""
    e = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.col("event_type").isin("purchase", "signup"), "useful").when((F.col("event_type") == "error") & (F.col("value") < 50), "dead_end").when(F.col("event_type") == "error", "corrected")).where("outcome is not null")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    age = (F.unix_micros(F.lit(EVENTS_AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    part = e.withColumn("n", F.row_number().over(w)).where("n <= 50").groupBy("user_id").agg(F.sum(S.outcome_value(F.col("outcome")) * S.feedback_weight(age)).alias("net"))
    life = e.groupBy("user_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("useful", "dead_end", "corrected")], F.max(F.struct("ts", "event_id")).alias("last"))
    return life.join(part, "user_id").select("user_id", "useful", "dead_end", "corrected", F.col("last.event_id").alias("last_event"), F.round(S.logistic(F.col("net")), 6).alias("score"))


# --- change history ------------------------------------------------------------------------
def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c = o.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.datediff(F.lit(CODE_AS_OF).cast("date"), F.col("o_orderdate")).alias("age"))
    f = li.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("l_quantity").alias("added")).groupBy("sha", "path").agg(F.sum("added").alias("added"))
    return f.join(c, "sha")


def a10_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir)
    score = F.round(F.sum(S.change_weight(F.col("age"))), 4)
    g = c.groupBy("path").agg(score.alias("score"), F.count("*").alias("commits"), F.count_if(F.col("age") <= 30).alias("commits_30d"), F.count_if(F.col("age") <= 90).alias("commits_90d"), F.round(F.sum(F.when(F.col("age") <= 90, F.col("added")).otherwise(0)), 4).alias("lines_90d"), F.countDistinct("author").alias("bus_factor"))
    per = c.groupBy("path", "author").agg(F.count("*").alias("n"), F.min("age").alias("newest"))
    owner = per.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("n"), "newest", "author")).alias("o"))
    return g.join(owner, "path").select("path", "score", "commits", "commits_30d", "commits_90d", "lines_90d", "bus_factor", F.col("o.author").alias("primary_owner"))


def a11_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest partners of each file: decayed weight of the commits they share, at least 1.

    Commits over 15 files are left out, which bounds the pairs of one commit.
    """
    c = _commits(spark, sf_dir).select("sha", "path", "age")
    small = c.groupBy("sha").agg(F.count("*").alias("n")).where("n between 2 and 15").select("sha")
    c = c.join(small, "sha", "left_semi")
    pairs = c.join(c.select("sha", F.col("path").alias("partner")), "sha").where("path <> partner")
    w = pairs.groupBy("path", "partner").agg(F.round(F.sum(S.change_weight(F.col("age"))), 6).alias("weight")).where("weight >= 1")
    r = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("weight"), "partner"))
    return w.withColumn("rank", r.cast("bigint")).where("rank <= 5")


def a22_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files touched by at least two branches (suppliers)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.countDistinct("l_suppkey").alias("branches")).where("branches >= 2")


# --- incremental ---------------------------------------------------------------------------
def r06_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus of the first half of the ids against the whole: what an incremental index would do per path."""
    d = table(spark, sf_dir, "documents").where("path is not null and text is not null")
    state = lambda x, pick: x.groupBy("path").agg(pick(F.struct("doc_id", T.content_hash(F.col("text")).alias("h"))).alias("s")).select("path", F.col("s.h").alias("h"))
    return changes.classify_changes(state(d, F.min), state(d.where("source is not null"), F.max), "path", "h").groupBy("change").agg(F.count("*").alias("n"))


def r07_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources done, exhausted or selected: the first reading is done, null contents have failed three times."""
    s = table(spark, sf_dir, "source_documents").where("path is not null")
    last = s.groupBy("path").agg(F.max(F.struct("source_id", F.coalesce(T.content_hash(F.col("content")), F.lit("none")).alias("h"))).alias("s")).select("path", F.col("s.h").alias("h"))
    first = s.where("content is not null and frontmatter is not null").groupBy("path").agg(F.min(F.struct("source_id", T.content_hash(F.col("content")).alias("h"))).alias("s")).select("path", F.col("s.h").alias("h"))
    failed = s.where("mtime is null").groupBy("path").agg(F.max(F.struct("source_id", F.coalesce(T.content_hash(F.col("content")), F.lit("none")).alias("h"))).alias("s")).select("path", F.col("s.h").alias("h"), F.lit(3).alias("attempts"))
    return changes.partition_sources(last, first, failed, "path", "h").groupBy("state").agg(F.count("*").alias("n"))


def r08_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures per user since its last purchase; the counter resets with each."""
    e = table(spark, sf_dir, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("reset"))
    n = e.join(last, "user_id", "left").where("event_type = 'error' and (reset is null or ts > reset)").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return n.select("user_id", "attempts", (F.col("attempts") >= 3).alias("exhausted"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "ajfwmr" and k[1:3].isdigit()}
_D = "documents where text is not null"
_L = f"(select doc_id, regexp_replace(path, '\\.md$', '') slug, unnest({SQL_LINKS}) target from {_D})"
_C = f"(select l_orderkey sha, l_partkey path, sum(l_quantity) added, any_value(o_custkey) author, any_value(date_diff('day', o_orderdate::date, date '{CODE_AS_OF}')) age from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"
_P = "(select path, substr(sha256(text), 1, 16) h, doc_id, source from documents where path is not null and text is not null)"
_SD = "(select source_id, path, coalesce(substr(sha256(content), 1, 16), 'none') h, content, frontmatter, mtime from source_documents where path is not null)"
_OUT = "(select *, case when event_type in ('purchase', 'signup') then 'useful' when event_type = 'error' and value < 50 then 'dead_end' when event_type = 'error' then 'corrected' end outcome from events)"
ORACLES = {
    "j01_kept": "select zone_id from article_zones where slug is null or slug not in (select slug from articles where quarantined and slug is not null)",
    "j02_flags": "select zone_id, slug is not null and slug in (select slug from articles where quarantined and slug is not null) quarantined from article_zones",
    "j03_broken_links": f"select doc_id, target, count(*) n from {_L} where regexp_matches(target, '^(?:concepts|connections|qa)/') and target not in (select regexp_replace(path, '\\.md$', '') from {_D} and path is not null) group by 1, 2",
    "j04_orphans": f"select doc_id from {_D} and (path is null or regexp_replace(path, '\\.md$', '') not in (select target from {_L}))",
    "j05_unindexed": f"select distinct path from {_D} and path like 'daily/%' and path not in (select source_file from daily_chunks where source_file is not null)",
    "j06_stale": "select s.source_id, s.path from source_documents s join (select path, arg_min(coalesce(content, '∅'), source_id) c from source_documents where path is not null group by 1) f using (path) where s.content <> f.c and f.c <> '∅'",
    "j07_missing_backlinks": f"with e as (select distinct regexp_replace(slug, '-[0-9]+$', '') src, target dst from {_L}), k as (select distinct regexp_replace(regexp_replace(path, '\\.md$', ''), '-[0-9]+$', '') t from {_D}) select src, dst from e where src <> dst and dst in (select t from k where t is not null) and not exists (select 1 from e b where b.src = e.dst and b.dst = e.src)",
    "j09_ghosts": "select distinct slug from article_zones where slug is null or slug not in (select slug from articles where slug is not null)",
    "j12_overlaps": "with c as (select distinct p_brand f, l_partkey s, l_partkey + l_linenumber e from lineitem join part on l_partkey = p_partkey) select p_partkey, count(*) touches from part join c on f = p_brand and s <= p_partkey + p_size and p_partkey <= e group by 1",
    "j13_asof": "with c as (select user_id, epoch_us(ts) t, max(event_id) id from events where event_type = 'click' group by 1, 2), r as (select e.event_id, c.id, c.t from (select * from events where event_type = 'error') e asof left join c on e.user_id = c.user_id and epoch_us(e.ts) >= c.t), k as (select r.*, epoch_us(e.ts) - r.t <= 3600000000 near from r join events e using (event_id)) select event_id, case when near then id end click_id, case when near then t end right_time from k",
    "j20_branch_pairs": "with b as (select distinct l_suppkey branch, p_brand community from lineitem join part on l_partkey = p_partkey) select x.branch a, y.branch b, count(*) shared from b x join b y using (community) where x.branch < y.branch group by 1, 2",
    "j21_mentions": f"with n as (select distinct lower(regexp_extract(title, '^([A-Za-z]+ [A-Za-z]+)', 1)) name from articles), d as (select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\\A---.*?---', ' '), '(?s)```.*?```', ' ', 'g'), '\\[\\[[^\\]]*\\]\\]', ' ', 'g'), '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '`[^`\\n]*`', ' ', 'g')) low from {_D}) select doc_id, count(*) n_names from d join n on length(name) >= 4 and contains(low, name) and regexp_matches(low, '\\b' || name || '\\b') group by 1",
    "j27_anchors": f"with k as (select distinct regexp_replace(regexp_replace(path, '\\.md$', ''), '-[0-9]+$', '') t from {_D}), h as (select entry_id, unnest(regexp_extract_all(regexp_replace(enhanced_prompt, '(?s)<!--.*?-->', '', 'g'), '\\[\\[([^\\]]+)\\]\\]', 1)) target from whisper_history where enhanced_prompt is not null) select entry_id, count(t) kept, count(*) - count(t) dropped from h left join k on t = target group by 1",
    "f05_viewer": "select article_id, slug from articles where type = 'fact' and coalesce(confidence, 0.5) >= 0.4 and not coalesce(quarantined, false) and contains(lower(concat_ws(' ', title, slug, excerpt)), 'index')",
    "f06_sessions": "select import_id from agent_sessions where lower(regexp_replace(replace(cwd, '\\', '/'), '/+$', '')) = '/home/dev/harbor-vault' and substr(started_at, 1, 10) >= '2025-01-01' and regexp_matches(started_at, '^[0-9]{4}-')",
    "f12_conceptual": "select entry_id from whisper_history where regexp_matches(transcript, '(?i)^(?:[a-z]+ ){0,2}(?:why|how|what|explain|warum|pourquoi|por qué)')",
    "f13_canary": "select entry_id, contains(lower(enhanced_prompt), 'skipped') and contains(lower(enhanced_prompt), 'test') and not contains(lower(enhanced_prompt), 'sorry') passed from whisper_history where enhanced_prompt is not null",
    "f14_safe_slugs": "select article_id, regexp_matches(slug, '^(?:concepts|connections|qa)/[A-Za-z0-9][A-Za-z0-9._-]*$') and not contains(slug, '..') safe from articles",
    "f15_paths": "select case when regexp_matches(path, '^(?:concepts|connections|qa)/.*\\.md$') then 'article' when regexp_matches(path, '^daily/.*\\.md$') then 'daily' when regexp_matches(path, '\\.(?:php|js|ts|py|twig|ya?ml)$') then 'codebase' else 'ignore' end kind, count(*) n from documents group by 1",
    "a02_inbound": f"select target, count(*) links, count(distinct doc_id) documents from {_L} where target not like 'daily/%' group by 1",
    "a05_tools": "select event_type, count(*) n from events group by 1",
    "a06_days": "select strftime(ts, '%Y-%m-%d') \"day\", count(*) total, count(*) filter (event_type = 'error') errors, count(distinct user_id) sessions from events group by 1",
    "a08_types": "with k as (select unnest(['fact', 'event', 'discovery', 'preference', 'advice', 'decision', 'tension', 'hypothesis', '(none)']) t) select t \"type\", count(article_id) n from k left join articles on t = case when type in (select t from k) then type else '(none)' end group by 1",
    "a09_health": f"select count(*) articles, count(*) filter (quarantined) quarantined, count(*) filter (confidence is null) unsure, count(*) filter (confidence < 0.4) weak, round(avg(confidence) filter (confidence between 0 and 1), 6) mean_confidence, sum(coalesce(source_count, 0)) sources, count(distinct type) types from ({_NEWEST})",
    "a17_costs": "select op, count(*) n, round(sum(case when ts >= '2024-01-30' then value else 0 end), 4) \"today\", round(sum(case when ts >= '2024-01-24' then value else 0 end), 4) \"week\", round(sum(case when ts >= '2024-01-01' then value else 0 end), 4) \"month\", round(sum(value), 4) ever from (select *, case when event_type in ('purchase', 'signup') then 'write' when event_type = 'error' then 'error' else 'read' end op from events) group by rollup (op)",
    "a24_languages": "with k as (select unnest(['en', 'de', 'fr', 'es', 'it']) l) select l lang, count(doc_id) n from k left join documents on lang = l group by 1",
    "w04_ordinals": "select chunk_no, row_number() over (partition by source_file, section order by chunk_no) ordinal from daily_chunks where source_file is not null",
    "w05_newest": "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) n from events qualify n <= 50",
    "w09_prefix": "with t as (select source_file, line_no, max(length(coalesce(text, ''))) c from session_turns where source_file is not null group by all) select source_file, line_no, sum(c + 1) over (partition by source_file order by line_no) used from t qualify used <= 4000",
    "w08_budget": f"with recursive a as (select slug, length(coalesce(excerpt, '')) * 20 c, row_number() over (order by coalesce(confidence, 0.5) desc, slug) i from ({_NEWEST})), t(i, used, took, n) as (select 0::bigint, 0::bigint, null::varchar, 0::bigint union all select a.i, case when used + c <= 40000 then used + c else used end, case when used + c <= 40000 then slug end, n + case when used + c <= 40000 then 1 else 0 end from t join a on a.i = t.i + 1) select took slug, n place from t where took is not null",
    "m01_priority": f"with ib as (select target topic, count(*) inbound from {_L} group by 1), a as (select *, regexp_extract(slug, '^([a-z]+/[a-z]+-[a-z]+)', 1) topic, date_diff('day', \"day\", date '{AS_OF}') d from ({_NEWEST})), s as (select slug, case when d is null then 0.1 else 1 / (1 + 0.05 * greatest(d, 0)) end recency, least(1, ln(1 + coalesce(inbound, 0)) / ln(21)) linkedness, least(1, ln(1 + coalesce(source_count, 0)) / ln(51)) acc, greatest(0.05, least(1, case when confidence between 0 and 1 then confidence else 0.5 end * pow(0.5, case when d is null or d < 0 then 30 else d end / 90.0) + least(0.25, greatest(0, coalesce(source_count, 0) - 1) * 0.05))) conf from a left join ib using (topic)) select slug, round(recency, 6) recency, round(linkedness, 6) linkedness, round(acc, 6) \"access\", round(conf, 6) confidence, round(0.2975 * recency + 0.255 * linkedness + 0.17 * acc + 0.1275 * conf + 0.15 * 0.5, 6) priority from s",
    "a16_feedback": f"with o as (select * from {_OUT} where outcome is not null), n as (select * from o qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 50), s as (select user_id, sum(case outcome when 'useful' then 1 when 'dead_end' then -1 else -2 end * pow(0.5, greatest((epoch_us(timestamp '{EVENTS_AS_OF}') - epoch_us(ts)) / 86400000000.0, 0) / 45)) net from n group by 1) select user_id, count(*) filter (outcome = 'useful') useful, count(*) filter (outcome = 'dead_end') dead_end, count(*) filter (outcome = 'corrected') corrected, arg_max(event_id, (ts, event_id)) last_event, round(1 / (1 + exp(-any_value(net) / 2)), 6) score from o join s using (user_id) group by 1",
    "a10_hotspots": f"with c as {_C}, o as (select path, author from (select path, author, count(*) n, min(age) newest from c group by 1, 2) qualify row_number() over (partition by path order by n desc, newest, author) = 1) select c.path, round(sum(exp(-age / 180.0)), 4) score, count(*) commits, count(*) filter (age <= 30) commits_30d, count(*) filter (age <= 90) commits_90d, round(sum(case when age <= 90 then added else 0 end), 4) lines_90d, count(distinct c.author) bus_factor, any_value(o.author) primary_owner from c join o on o.path = c.path group by 1",
    "a11_cochange": f"with c as {_C}, k as (select sha from c group by 1 having count(*) between 2 and 15), w as (select a.path, b.path partner, round(sum(exp(-a.age / 180.0)), 6) weight from c a join c b on a.sha = b.sha and a.path <> b.path where a.sha in (select sha from k) group by 1, 2 having round(sum(exp(-a.age / 180.0)), 6) >= 1) select *, row_number() over (partition by path order by weight desc, partner) rank from w qualify rank <= 5",
    "a22_conflicts": "select l_partkey path, count(distinct l_suppkey) branches from lineitem group by 1 having count(distinct l_suppkey) >= 2",
    "r06_changes": f"with o as (select path, arg_min(h, doc_id) h from {_P} group by 1), n as (select path, arg_max(h, doc_id) h from {_P} where source is not null group by 1) select case when o.path is null then 'new' when n.path is null then 'removed' when o.h = n.h then 'same' else 'changed' end \"change\", count(*) n from o full join n on o.path = n.path group by 1",
    "r07_partition": f"with s as {_SD}, l as (select path, arg_max(h, source_id) h from s group by 1), f as (select path, arg_min(h, source_id) h from s where content is not null and frontmatter is not null group by 1), b as (select path, arg_max(h, source_id) h from s where mtime is null group by 1) select case when l.h = f.h then 'done' when l.h = b.h then 'exhausted' else 'selected' end state, count(*) n from l left join f using (path) left join b using (path) group by 1",
    "r08_retries": "with l as (select user_id, max(ts) reset from events where event_type = 'purchase' group by 1) select user_id, count(*) attempts, count(*) >= 3 exhausted from events left join l using (user_id) where event_type = 'error' and (reset is null or ts > reset) group by 1",
}
