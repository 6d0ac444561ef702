"""The remaining projections, summaries and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import events as E
from siltstone.functions import text as T
from siltstone.operators import chunking, ranking
from siltstone.plans.text import docs
from siltstone.session import table
from siltstone.sources import code


def a07_daily_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def a14_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").groupBy(F.substring_index("slug", "/", 1).alias("prefix"), F.floor(F.when(F.col("confidence").between(0, 1), F.col("confidence")) * 10).alias("decile")).agg(F.count("*").alias("n"))


def a25_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("articles", "article_zones", "daily_chunks", "documents", "session_turns", "agent_sessions", "source_documents", "whisper_history")
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("collection"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def a29_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each topic was put into a prompt's context."""
    h = table(spark, sf_dir, "whisper_history").where("mode = 'verbatim' and enhanced_prompt is not null")
    return h.select(F.explode(T.wikilinks(F.col("enhanced_prompt"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def l05_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve newest articles by day, those without one last."""
    a = table(spark, sf_dir, "articles").withColumn("day", F.try_to_date(F.substring("updated", 1, 10), "yyyy-MM-dd"))
    return a.orderBy(F.desc_nulls_last("day"), "article_id").select("article_id", F.col("day").cast("string").alias("day")).limit(12)


def l07_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three sections of every daily log, in order."""
    w = Window.partitionBy("source_file").orderBy(F.desc("chunk_no"))
    return table(spark, sf_dir, "daily_chunks").where("source_file is not null").withColumn("back", F.row_number().over(w).cast("bigint")).where("back <= 3").select("source_file", "chunk_no", "back")


def p07_query_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.query_chunks(docs(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", F.col("part").cast("bigint").alias("part"), F.length("piece").cast("bigint").alias("chars"))


def p10_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.length(T.fallback_truth(F.col("text"))).cast("bigint").alias("chars"))


def p16_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of index pages reduced to link and last column."""
    line = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^- \[\["))
    return line.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_extract("line", r"^- \[\[([^\]]+)\]\]", 1).alias("link"), F.trim(F.element_at(F.split("line", "—"), -1)).alias("last"))


def p17_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wikilinks, with or without an alias, as markdown links."""
    c = F.regexp_replace(F.regexp_replace("text", r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2](/a/$1)"), r"\[\[([^\]|]+)\]\]", "[$1](/a/$1)")
    return docs(spark, sf_dir).select("doc_id", F.md5(c).alias("page_md5"))


def p19_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tool events; every event's input is taken for that of an unknown tool."""
    e = table(spark, sf_dir, "events")
    d = E.input_digest(F.col("event_type"), F.col("props"))
    return e.select("event_id", F.try_element_at(d, F.lit("k")).alias("k"), E.event_label(F.col("event_type"), d).alias("label"))


def p23_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark question the bodies of its three best documents under their headings; vanished ones are skipped."""
    d = docs(spark, sf_dir)
    hits = ranking.bm25(d, "doc_id", "text", table(spark, sf_dir, "benchmark_items"), "item_id", "question", 3).join(d.select("doc_id", "slug", "text"), "doc_id")
    block = F.concat(F.lit("## "), "slug", F.lit("\n\n"), F.col("text"))
    g = hits.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return g.select("item_id", F.md5(F.array_join(F.transform("x", lambda r: r["b"]), "\n\n")).alias("context_md5"))


def u05_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded twice: ids with one text collapse, ids with several are conflicts."""
    g = table(spark, sf_dir, "daily_chunks").where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("texts"))
    return g.groupBy(F.when(F.col("n") == 1, "single").when(F.col("texts") == 1, "collapsed").otherwise("conflict").alias("state")).agg(F.count("*").alias("ids"))


def w07_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to forty events per user: by tier of their kind, then in order; views are left out."""
    tier = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type").isin("signup", "click"), 1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy(F.desc("tier"), "event_id")
    return table(spark, sf_dir, "events").withColumn("tier", tier).where("tier > 0").withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 40").select("user_id", "event_id", "place")


def w10_first_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each file that names an exact reference."""
    t = table(spark, sf_dir, "session_turns").where("source_file is not null and text is not null and line_no is not null")
    r = t.select("source_file", "line_no", "turn_id", F.explode(T.exact_references(F.col("text"))).alias("reference"))
    return r.groupBy("source_file", "reference").agg(F.min(F.struct("line_no", "turn_id")).alias("f")).select("source_file", "reference", F.col("f.turn_id").alias("turn_id"))


def w14_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty users written last, each with its greatest cursor."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("cursor"), F.max("ts").alias("at"))
    return e.orderBy(F.desc("at"), "user_id").limit(50).select("user_id", "cursor")


def x13_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(code.PHP_SYMBOL), F.lit(1)))).alias("symbol"))


def x16_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "whisper_history").where("transcript is not null")
    return w.select("entry_id", F.array_join(E.prompt_paths(F.col("transcript")), ",").alias("paths"), F.array_join(E.prompt_classes(F.col("transcript")), ",").alias("classes"))


def x17_open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(E.open_work(F.col("text"))).alias("open_md5")).where("open_md5 is not null")


def s27_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the logs, newest first, with sizes and whether tools were used that day."""
    c = table(spark, sf_dir, "daily_chunks").where("log_date is not null").groupBy(F.col("log_date").cast("string").alias("day")).agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"))
    days = table(spark, sf_dir, "events").select(F.date_format(F.col("ts") + F.expr("interval 500 days"), "yyyy-MM-dd").alias("day")).distinct().withColumn("has", F.lit(True))
    return c.join(days, "day", "left").select("day", "sections", "chars", F.coalesce("has", F.lit(False)).alias("has_drawer"))


def s25_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that stands for an article in a catalog: its fields by line, nulls left out."""
    line = lambda label, c: F.concat(F.lit(label + ": "), F.nullif(F.trim(c), F.lit("")))
    t = F.concat_ws("\n", line("title", F.col("title")), line("type", F.col("type")), line("excerpt", F.col("excerpt")))
    return table(spark, sf_dir, "articles").select("article_id", F.md5(t).alias("taxonomy_md5"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "alpuwxs" and k[1:3].isdigit()}
_D = "documents where text is not null"
_FIRST = lambda c: f"array_to_string(list_filter({c}, lambda x, i: list_position({c}, x) = i)[:3], ',')"
_OPEN = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(text, '(?ms)^##+ Open Questions[^\\n]*\\n(.*)\\z', 1), '(?ms)^##+ .*\\z', ''), '\\A\\s+', ''), '\\s+\\z', '')"
ORACLES = {
    "a07_daily_tools": "select strftime(ts, '%Y-%m-%d') \"day\", event_type, count(*) n from events group by 1, 2",
    "a14_prefixes": "select split_part(slug, '/', 1) prefix, floor(case when confidence between 0 and 1 then confidence end * 10)::bigint decile, count(*) n from articles group by 1, 2",
    "a25_sizes": " union all ".join(f"select '{t}' collection, count(*) n from {t}" for t in ("articles", "article_zones", "daily_chunks", "documents", "session_turns", "agent_sessions", "source_documents", "whisper_history")),
    "a29_access": "select topic, count(*) n from (select unnest(regexp_extract_all(regexp_replace(enhanced_prompt, '(?s)<!--.*?-->', '', 'g'), '\\[\\[([^\\]]+)\\]\\]', 1)) topic from whisper_history where mode = 'verbatim' and enhanced_prompt is not null) group by 1",
    "l05_recent": "select article_id, \"day\"::varchar \"day\" from (select article_id, try_strptime(substr(updated, 1, 10), '%Y-%m-%d')::date \"day\" from articles) order by \"day\" desc nulls last, article_id limit 12",
    "l07_tail": "select source_file, chunk_no, row_number() over (partition by source_file order by chunk_no desc) back from daily_chunks where source_file is not null qualify back <= 3",
    "p16_compact": f"select doc_id, i - 1 pos, regexp_extract(l[i], '^- \\[\\[([^\\]]+)\\]\\]', 1) link, trim(list_extract(string_split(l[i], '—'), -1)) \"last\" from (select doc_id, string_split(text, chr(10)) l from {_D}), unnest(range(1, len(l) + 1)) u(i) where starts_with(l[i], '- [[')",
    "p17_rewritten": f"select doc_id, md5(regexp_replace(regexp_replace(text, '\\[\\[([^\\]|]+)\\|([^\\]]+)\\]\\]', '[\\2](/a/\\1)', 'g'), '\\[\\[([^\\]|]+)\\]\\]', '[\\1](/a/\\1)', 'g')) page_md5 from {_D}",
    "p19_digests": "select event_id, props->>'$.k' k, event_type \"label\" from events",
    "u05_collapsed": "select case when n = 1 then 'single' when t = 1 then 'collapsed' else 'conflict' end state, count(*) ids from (select id, count(*) n, count(distinct sha256(text)) t from daily_chunks where id is not null group by 1) group by 1",
    "w07_tiers": "select user_id, event_id, row_number() over (partition by user_id order by t desc, event_id) place from (select *, case event_type when 'error' then 3 when 'purchase' then 2 when 'signup' then 1 when 'click' then 1 else 0 end t from events) where t > 0 qualify place <= 40",
    "w10_first_references": "select source_file, reference, arg_min(turn_id, (line_no, turn_id)) turn_id from (select source_file, line_no, turn_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>\"'']+|[A-Za-z0-9][A-Za-z0-9_.:/?&=%+-]{31,}')) reference from session_turns where source_file is not null and text is not null and line_no is not null) group by 1, 2",
    "w14_cursors": "select user_id, max(event_id) \"cursor\" from events group by 1 order by max(ts) desc, user_id limit 50",
    "x13_symbols": f"select distinct doc_id, unnest(regexp_extract_all(text, '\\b(?:class|interface|trait|enum|function)\\s+([A-Za-z_]\\w*)', 1)) symbol from {_D}",
    "x16_entities": f"with e as (select entry_id, regexp_extract_all(transcript, '[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\\.[a-z]{{1,5}}') p, regexp_extract_all(transcript, '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b') c from whisper_history where transcript is not null) select entry_id, {_FIRST('p')} paths, {_FIRST('c')} classes from e",
    "x17_open_work": f"select doc_id, md5(b) open_md5 from (select doc_id, {_OPEN} b from {_D}) where lower(b) not in ('', 'none', '- none', 'n/a', '-', '(none)')",
    "s27_logs": "with d as (select distinct strftime(ts + interval 500 days, '%Y-%m-%d') x from events) select log_date::varchar \"day\", count(*) sections, sum(length(text)) chars, log_date::varchar in (select x from d) has_drawer from daily_chunks where log_date is not null group by 1, 4",
    "s25_taxonomy": "select article_id, md5(concat_ws(chr(10), 'title: ' || nullif(trim(title), ''), 'type: ' || nullif(trim(\"type\"), ''), 'excerpt: ' || nullif(trim(excerpt), ''))) taxonomy_md5 from articles",
}
