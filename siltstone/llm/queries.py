"""The pN_ queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import contamination, conversations, neardup, packing, pairs, pii, spam, splitting
from siltstone.session import spread, table

#: The key of the demonstration queries; real runs pass their own.
PII_KEY = "demonstration"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of each whole conversation with its place in it."""
    return conversations.rebuild(table(spark, sf_dir, "session_turns"), table(spark, sf_dir, "agent_sessions"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole conversations, their turns flattened to text per part."""
    parts = conversations.conversations(table(spark, sf_dir, "session_turns"), table(spark, sf_dir, "agent_sessions"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return parts.select("session_id", "part_no", "n_turns", flat.alias("dialogue"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _spoken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "session_turns").select(F.lit("session_turns").alias("source_table"), F.col("turn_id").alias("row_id"), "text")
    history = table(spark, sf_dir, "whisper_history").select(F.lit("whisper_history").alias("source_table"), F.col("entry_id").alias("row_id"), F.col("transcript").alias("text"))
    return spread(turns.unionByName(history))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct find of personal information that a surrogate replaces in each row of text."""
    found = pii.replaced(_spoken_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"), PII_KEY)
    return found.select("source_table", "row_id", "kind", "surface").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that held personal information, with typed placeholders in its place."""
    return pii.redact(_spoken_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"), key=PII_KEY)


def p3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with surrogates of the same kind and format instead."""
    return pii.redact(_spoken_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"), key=PII_KEY, realistic=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose prompt is no usable answer, with the kind of the defect."""
    return pairs.defects(table(spark, sf_dir, "whisper_history"))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "article_zones").select(F.col("slug").alias("key"), F.col("observed").alias("text")).where("slug is not null and observed is not null")
    slugs = table(spark, sf_dir, "articles").select(F.col("slug").alias("key")).distinct()
    return zones.join(slugs, "key", "left_semi")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles whose observed texts are nearly the same."""
    return neardup.similar_pairs(_observed(spark, sf_dir)).select(F.col("key_a").alias("slug_a"), F.col("key_b").alias("slug_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that nearly equal articles form: one row per article with its class, links and group."""
    return neardup.similar_groups(_observed(spark, sf_dir)).withColumnRenamed("key", "slug")


def _splittable(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "daily_chunks").select(F.lit("daily_chunks").alias("source_table"), F.col("chunk_no").alias("row_id"), splitting.body(F.col("text"), False).alias("body"))
    sources = table(spark, sf_dir, "source_documents").select(
        F.lit("source_documents").alias("source_table"), F.col("source_id").alias("row_id"), splitting.body(F.col("content"), True).alias("body")
    )
    return chunks.unionByName(sources)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that had to be split: those that came out in more than one piece."""
    return splitting.pieces(_splittable(spark, sf_dir)).where("piece_no = 0 and n_pieces > 1").select("source_table", "row_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized rows."""
    return splitting.pieces(_splittable(spark, sf_dir))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with the container of 2,048 tokens each goes to."""
    return packing.pack(packing.token_counts(_documents(spark, sf_dir)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items and the documents that hold twelve consecutive words of their passage."""
    return contamination.leaked_items(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in each document the leaked passages stand."""
    return contamination.leaked_spans(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of keywords, links or tags instead of sentences."""
    return spam.spam_pages(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_conversations": p1_conversations,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_surrogates": p3_surrogates,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
}
_TRIMMED = "regexp_replace(regexp_replace({0}, '\\A[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+\\z', '')"
_GRAMS = "select distinct {key}, array_to_string(w[i : i + {more}], ' ') g from {rows}, unnest(range(1, len(w) - {more} + 1)) u(i)"
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_SEEN = "regexp_replace({0}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}]', '', 'g')"
_UUID = "regexp_extract(lower({0}), '^\\s*(?:\\{{|urn:uuid:)?([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})(?:\\}}|\\.jsonl?)?\\s*$', 1)"
_MICROS = "case when length(trim(ts)) = 10 then try_cast(ts as bigint) * 1000000 when length(trim(ts)) = 13 then try_cast(ts as bigint) * 1000 else epoch_us(try_cast(regexp_replace(ts, '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2') as timestamptz)) end"
_NOTICE = " or ".join("regexp_matches(flat, '" + p.replace("'", "''") + "')" for p in conversations.NOTICES)
#: One row per line of a session: its speaker and what kind of turn it is (1 user, 2 assistant's reply, 3 a client's notice).
_LINES = f"""r as (select turn_id, {_UUID.format('session_id')} sid, coalesce(source_file, '') f, line_no l, {_MICROS} us, coalesce(text, '') text, regexp_replace(coalesce(text, ''), '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g') flat,
  regexp_replace(lower(coalesce("role", '')), '[\\s\\p{{Z}}:]+', '', 'g') ro from session_turns),
 k as (select *, case when ro in ('user', 'human', 'you', 'me', 'customer', 'prompt') then 'u' when ro in ('assistant', 'agent', 'ai', 'bot', 'model', 'chatbot') then 'a' when ro in ('tool', 'tool_result', 'tool_use', 'tool_call', 'function', 'function_call', 'system', 'developer', 'environment') then 'o' end who, flat <> '' seen from r where sid <> ''),
 t as (select sid, f, l, text, min(turn_id) id, min(us) us, bool_or(seen and who is null) nameless, arg_min(case when not seen then 0 when who = 'u' then 1 when who = 'a' and ({_NOTICE}) then 3 when who = 'a' then 2 else 0 end, turn_id) kind from k group by 1, 2, 3, 4),
 fl as (select sid, f, min(us) began, count(*) = count(distinct l) and min(l) = 1 and max(l) = count(*) whole, bool_or(nameless) nameless from t group by 1, 2),
 o as (select t.sid, t.id, t.kind, row_number() over w pos, lead(t.kind) over w nxt from t join fl using (sid, f) where kind > 0 window w as (partition by t.sid order by began nulls last, f, l)),
 good as (select sid from o group by 1 having bool_and(kind <> 1 or coalesce(nxt, 0) = 2) and arg_min(kind, pos) = 1)"""
ORACLES: dict[str, str] = {
    "p1_found": f"""with {_LINES} select o.sid session_id, pos::int turn_pos, id turn_id from o where sid in (select sid from good) and sid not in (select sid from fl where not whole or whole is null or nameless) and sid in (select {_UUID.format('session_id')} from agent_sessions where session_id is not null)""",
    "p5_found": f"""with z as (select distinct slug, {_WORDS.format('observed')} w from article_zones where observed is not null and slug in (select slug from articles)),
 g as ({_GRAMS.format(key='slug, w', more=2, rows='z')}), n as (select slug, w, count(*) n from g group by 1, 2),
 c as (select a.slug s1, a.w w1, b.slug s2, b.w w2, count(*) c from g a join g b using (g) where a.slug < b.slug group by 1, 2, 3, 4)
 select distinct s1 slug_a, s2 slug_b from c join n a on a.slug = s1 and a.w = w1 join n b on b.slug = s2 and b.w = w2 where c >= 0.5 * (a.n + b.n - c)""",
    "p6_found": f"""select 'daily_chunks' source_table, chunk_no row_id from daily_chunks where length({_TRIMMED.format('text')}) > 6000
 union all select 'source_documents', source_id from source_documents where length({_TRIMMED.format("regexp_replace(content, '(?s)\\A\\s*---[ \\t]*\\r?\\n(?:.*?\\r?\\n)?---[ \\t]*(?:\\r?\\n|\\z)', '')")}) > 6000""",
    "p8_found": f"""with d as (select doc_id, {_WORDS.format(_SEEN.format('text'))} w from documents where text is not null), p as (select item_id, {_WORDS.format(_SEEN.format('passage'))} w from benchmark_items where passage is not null),
 a as ({_GRAMS.format(key='doc_id', more=11, rows='d')}), b as ({_GRAMS.format(key='item_id', more=11, rows='p')})
 select distinct item_id, doc_id from a join b using (g)""",
}
