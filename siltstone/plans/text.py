"""Queries over the text functions, chunkers and links of the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking
from siltstone.session import spread, table

#: DuckDB twins of the expressions that several oracles share.
SQL_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"
SQL_CLEAN = "regexp_replace(text, '(?s)<!--.*?-->', '', 'g')"
SQL_LINKS = f"regexp_extract_all({SQL_CLEAN}, '\\[\\[([^\\]]+)\\]\\]', 1)"
SQL_FM = "regexp_extract(text, '(?s)\\A---(.*?)---', 1)"
SQL_BODY = "regexp_replace(text, '(?s)\\A---.*?---', '')"
SLUG = "regexp_replace(path, '\\.md$', '')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text; the path without suffix is the slug that links use."""
    return spread(table(spark, sf_dir, "documents").where("text is not null")).withColumn("slug", F.regexp_replace("path", r"\.md$", ""))


def field_sql(key: str) -> str:
    return f"nullif(regexp_replace(trim(regexp_extract({SQL_FM}, '(?m)^{key}:[ \\t]*(.*)$', 1)), '^[\"'']|[\"'']$', '', 'g'), '')"


def x01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def x02_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("article_id", T.slugify(F.col("title")).alias("title_slug"))


def x03_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "daily_chunks").where("source_file is not null").select("chunk_no", T.chunk_id(F.col("source_file"), F.coalesce("section", F.lit(""))).alias("made_id"))


def x04_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = docs(spark, sf_dir).select("doc_id", F.posexplode(T.wikilinks(F.col("text"))).alias("pos", "target"))
    return links.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "target")


def x05_typed_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = docs(spark, sf_dir).select(F.explode(T.typed_wikilinks(F.col("text"))).alias("l"))
    return links.groupBy("l.target", "l.relation").agg(F.count("*").alias("n"))


def x06_source_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(T.source_anchors(F.col("text"))).cast("bigint").alias("n_anchors"))


def x07_exact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(T.exact_references(F.col("text"))).alias("reference"))


def x08_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(T.urls(F.col("text"))).alias("url"))


def x09_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(T.prose_only(F.col("text")), " +", " ")).alias("prose_md5"))


def x10_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def x11_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "agent_sessions").select("import_id", T.normal_path(F.col("cwd")).alias("cwd_path"), T.short_id(F.col("session_id")).alias("short_id"))


def x12_archive_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "agent_sessions").select("import_id", T.archive_stem(F.col("session_id")).alias("stem"))


def x18_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "whisper_history").where("transcript is not null")
    c = F.col("transcript")
    return e.select("entry_id", F.md5(T.xml_escape(c)).alias("xml"), F.md5(T.cypher_escape(c)).alias("cypher"), F.md5(T.mermaid_escape(c)).alias("mermaid"))


def x19_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clip(F.col("text"), 60).alias("clipped"), T.snippet(F.col("text"), 220).alias("snippet"))


def s03_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = T.frontmatter(F.col("text"))
    return docs(spark, sf_dir).select(
        "doc_id", T.field(block, "title").alias("title"), T.field(block, "type").alias("type"),
        T.field(block, "confidence").try_cast("double").alias("confidence"), T.source_count(block).cast("bigint").alias("source_count"),
    )


def s04_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.length(T.without_frontmatter(F.col("text"))).cast("bigint").alias("body_chars"))


def a04_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words")).where("words < 200")


def p01_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.heading_sections(docs(spark, sf_dir), "doc_id", "path", "text")
    return out.select("doc_id", "chunk_id", "section", F.md5("chunk").alias("chunk_md5"))


def p02_char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.char_windows(docs(spark, sf_dir), "text", 6000, 256)
    return out.select("doc_id", F.col("part").cast("bigint").alias("part"), F.length("window").cast("bigint").alias("chars"))


def p03_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.word_windows(docs(spark, sf_dir), "text", 150, 30)
    return out.select("doc_id", F.col("part").cast("bigint").alias("part"), F.md5("window").alias("window_md5"))


def p04_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.line_windows(docs(spark, sf_dir), "text", 150, 30)
    return out.select("doc_id", F.col("first_line").cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"))


def p08_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.length(T.truth_section(F.col("text"))).cast("bigint").alias("truth_chars"))


def p09_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = docs(spark, sf_dir).select("doc_id", T.zones(F.col("text")).alias("z"))
    return z.select("doc_id", F.explode(F.array(F.struct(F.lit("observed").alias("zone"), F.col("z.observed").alias("t")), F.struct(F.lit("synthesized").alias("zone"), F.col("z.synthesized").alias("t")))).alias("x")).select(
        "doc_id", "x.zone", F.md5("x.t").alias("text_md5")
    ).where(F.col("text_md5") != F.md5(F.lit("")))


def p11_zone_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable zones: title folded into the indexed text, with flags and defaults of the article."""
    z = table(spark, sf_dir, "article_zones")
    newest = Window.partitionBy("slug").orderBy(F.desc("article_id"))
    a = table(spark, sf_dir, "articles").withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("slug", "title", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"))
    each = z.select("zone_id", "slug", F.explode(F.map_from_arrays(F.array(F.lit("observed"), F.lit("synthesized")), F.array("observed", "synthesized"))).alias("zone", "body"))
    kept = each.where("body is not null and trim(body) <> ''").join(a, "slug")
    return kept.select("zone_id", "zone", F.length(F.concat_ws(" ", "title", "body")).cast("bigint").alias("index_chars"), F.round("confidence", 6).alias("confidence"), "quarantined")


def p14_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.match_context(F.col("text"), "retry queue").alias("context")).where("context is not null")


def p15_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.excerpt(F.col("text"), F.col("slug"), 1500)).alias("excerpt_md5"))


def p18_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript file flattened to ``role: text`` lines, in parts of 2,048 lines, so that no file is one group."""
    t = table(spark, sf_dir, "session_turns")
    line = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    part = F.floor(F.coalesce("line_no", F.lit(0)) / 2048).cast("bigint")
    g = t.groupBy("source_file", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("line_no", "turn_id", line.alias("l")))).alias("x"))
    return g.select("source_file", "part", F.md5(F.array_join(F.transform("x", lambda r: r["l"]), "\n")).alias("flat_md5"))


def p22_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at the last complete section before 2,000 characters, with shown and total headings."""
    d = docs(spark, sf_dir)
    head = F.substring("text", 1, 2000)
    kept = F.when(F.length("text") <= 2000, F.col("text")).when(head.contains("\n## "), F.regexp_extract(head, r"(?s)\A(.*)\n## ", 1)).otherwise(head)
    n = lambda c: (F.size(F.split(c, "\n## ")) - 1).cast("bigint")
    return d.select("doc_id", F.length(kept).cast("bigint").alias("kept_chars"), n(kept).alias("shown"), n(F.col("text")).alias("total"))


_LINES = "string_split(text, chr(10))"
QUERIES = {
    f.__name__: f
    for f in (x01_tokens, x02_slugs, x03_chunk_ids, x04_wikilinks, x05_typed_wikilinks, x06_source_anchors, x07_exact_references, x08_urls, x09_prose, x10_hashes, x11_paths, x12_archive_stems, x18_escapes, x19_clips, s03_frontmatter, s04_bodies, a04_sparse, p01_sections, p02_char_windows, p03_word_windows, p04_line_windows, p08_truth, p09_zones, p11_zone_corpus, p14_contexts, p15_excerpts, p18_flatten, p22_truncated)
}
_D = "documents where text is not null"
_TRIM = "regexp_replace(regexp_replace({0}, '\\A\\s+', ''), '\\s+\\z', '')"
SQL_TRUTH = _TRIM.format("regexp_replace(regexp_extract(text, '(?ms)^## Truth[ \\t]*\\n(.*)\\z', 1), '(?ms)^(?:---|## Timeline)[ \\t]*$.*\\z', '')")
ORACLES = {
    "x01_tokens": f"select doc_id, len({SQL_TOKENS}) n_tokens, len(list_distinct({SQL_TOKENS})) n_distinct from {_D}",
    "x02_slugs": "select article_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{M}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') title_slug from articles",
    "x03_chunk_ids": "select chunk_no, source_file || '#' || coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(section, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') made_id from daily_chunks where source_file is not null",
    "x04_wikilinks": f"select doc_id, i - 1 pos, l[i] target from (select doc_id, {SQL_LINKS} l from {_D}), unnest(range(1, len(l) + 1)) u(i)",
    "x05_typed_wikilinks": f"select target, nullif(relation, '') relation, count(*) n from (select unnest(regexp_extract_all({SQL_CLEAN}, '\\[\\[([^\\]]+)\\]\\](?:\\{{([a-z0-9_]+)\\}})?', 1)) target, unnest(regexp_extract_all({SQL_CLEAN}, '\\[\\[([^\\]]+)\\]\\](?:\\{{([a-z0-9_]+)\\}})?', 2)) relation from {_D}) group by 1, 2",
    "x06_source_anchors": f"select doc_id, len(regexp_extract_all(text, '\\[src:([^\\]]+)\\]', 1)) n_anchors from {_D}",
    "x07_exact_references": f"select distinct doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>\"'']+|[A-Za-z0-9][A-Za-z0-9_.:/?&=%+-]{{31,}}')) reference from {_D}",
    "x08_urls": f"select distinct doc_id, regexp_replace(u, '[.,;:!?]+$', '') url from (select doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>\"''\\)\\]]+')) u from {_D})",
    "x09_prose": f"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\\A---.*?---', ' '), '(?s)```.*?```', ' ', 'g'), '\\[\\[[^\\]]*\\]\\]', ' ', 'g'), '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), ' +', ' ', 'g')) prose_md5 from {_D}",
    "x10_hashes": f"select doc_id, substr(sha256(text), 1, 16) content_hash from {_D}",
    "x11_paths": "select import_id, lower(regexp_replace(replace(cwd, '\\', '/'), '/+$', '')) cwd_path, substr(list_extract(regexp_split_to_array(regexp_replace(session_id, '[\\\\/]+$', ''), '[\\\\/]'), -1), 1, 12) short_id from agent_sessions",
    "x12_archive_stems": "select import_id, case when regexp_full_match(session_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') then session_id else coalesce(nullif(regexp_replace(substr(regexp_replace(session_id, '[^A-Za-z0-9._-]+', '-', 'g'), 1, 40), '^[.-]+|[.-]+$', '', 'g'), ''), 'session') || '-' || substr(sha256(session_id), 1, 20) end stem from agent_sessions",
    "x18_escapes": "select entry_id, md5(replace(replace(replace(replace(replace(transcript, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) xml, md5(replace(replace(replace(transcript, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n')) cypher, md5(replace(replace(transcript, '\"', ''''), chr(10), ' ')) mermaid from whisper_history where transcript is not null",
    "x19_clips": f"select doc_id, case when length(text) <= 60 then text else substr(text, 1, 60) || '…' end clipped, case when length(f) <= 220 then f else rtrim(substr(f, 1, 220)) || '…' end snippet from (select doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) f from {_D})",
    "s03_frontmatter": f"select doc_id, {field_sql('title')} title, {field_sql('type')} \"type\", try_cast({field_sql('confidence')} as double) confidence, len(list_filter(string_split({SQL_FM}, chr(10)), lambda x: starts_with(ltrim(x), '- '))) source_count from {_D}",
    "s04_bodies": f"select doc_id, length({SQL_BODY}) body_chars from {_D}",
    "a04_sparse": f"select doc_id, words from (select doc_id, case when b = '' then 0 else len(regexp_split_to_array(b, '[ \\t\\n\\x0b\\f\\r]+')) end words from (select doc_id, regexp_replace(regexp_replace({SQL_BODY}, '\\A[ \\t\\n\\x0b\\f\\r]+', ''), '[ \\t\\n\\x0b\\f\\r]+\\z', '') b from {_D})) where words < 200",
    "p02_char_windows": f"select doc_id, i part, least(6000, length(text) - i * 5744) chars from (select * from {_D}), unnest(range(0, (length(text) - 1) // 5744 + 1)) u(i) where length(text) > 0",
    "p08_truth": f"select doc_id, length({SQL_TRUTH}) truth_chars from {_D}",
    "p11_zone_corpus": "with a as (select slug, title, coalesce(confidence, 0.5) confidence, coalesce(quarantined, false) quarantined from articles qualify row_number() over (partition by slug order by article_id desc) = 1), e as (select zone_id, slug, 'observed' zone, observed body from article_zones union all select zone_id, slug, 'synthesized', synthesized from article_zones) select zone_id, zone, length(concat_ws(' ', title, body)) index_chars, round(confidence, 6) confidence, quarantined from e join a using (slug) where body is not null and trim(body) <> ''",
    "p14_contexts": f"select doc_id, substr(text, s, p - s + 11 + 80) context from (select doc_id, text, instr(text, 'retry queue') p, greatest(instr(text, 'retry queue') - 80, 1) s from {_D}) where p > 0",
    "p18_flatten": "select source_file, coalesce(line_no, 0) // 2048 part, md5(string_agg(coalesce(role, 'unknown') || ': ' || coalesce(text, ''), chr(10) order by line_no nulls first, turn_id)) flat_md5 from session_turns group by 1, 2",
    "p22_truncated": f"select doc_id, length(k) kept_chars, len(string_split(k, chr(10) || '## ')) - 1 shown, len(string_split(text, chr(10) || '## ')) - 1 total from (select doc_id, text, case when length(text) <= 2000 then text when contains(substr(text, 1, 2000), chr(10) || '## ') then regexp_extract(substr(text, 1, 2000), '(?s)\\A(.*)\\n## ', 1) else substr(text, 1, 2000) end k from {_D})",
    "p03_word_windows": f"select doc_id, i part, md5(array_to_string(w[i * 120 + 1 : i * 120 + 150], ' ')) window_md5 from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') w from {_D}), unnest(range(0, case when len(w) = 0 then 0 when len(w) <= 150 then 1 else ceil((len(w) - 150) / 120.0)::int + 1 end)) u(i)",
    "p04_line_windows": f"select doc_id, i * 120 + 1 first_line, least(i * 120 + 150, len(l)) last_line from (select doc_id, {_LINES} l from {_D}), unnest(range(0, case when len(l) <= 150 then 1 else ceil((len(l) - 150) / 120.0)::int + 1 end)) u(i)",
    "p09_zones": f"select doc_id, zone, md5(t) text_md5 from (select doc_id, unnest(['observed', 'synthesized']) zone, unnest([case when p then tr else {_TRIM.format('regexp_replace(regexp_extract(tr, ' + chr(39) + '(?ms)^### Observed[ \\t]*\\n(.*)\\z' + chr(39) + ', 1), ' + chr(39) + '(?ms)^###\\s.*\\z' + chr(39) + ', ' + chr(39) * 2 + ')')} end, case when p then '' else {_TRIM.format('regexp_replace(regexp_extract(tr, ' + chr(39) + '(?ms)^### Synthesized[ \\t]*\\n(.*)\\z' + chr(39) + ', 1), ' + chr(39) + '(?ms)^###\\s.*\\z' + chr(39) + ', ' + chr(39) * 2 + ')')} end]) t from (select doc_id, {SQL_TRUTH} tr, not regexp_matches({SQL_TRUTH}, '(?m)^### (?:Observed|Synthesized)[ \\t]*$') p from {_D})) where t <> ''",
}
