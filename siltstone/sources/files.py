"""File sources: markdown trees, JSONL transcripts and events, git logs and diffs.

All of them are DataFrame reads; malformed lines are skipped or kept apart as each
table's rule says, and nothing is listed or read on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: Readers by source type; a new type registers itself here.
HANDLERS: dict = {}


def handler(kind: str):  # noqa: ANN201
    """Registers a reader: (spark, path) -> DataFrame(path, text)."""

    def add(f):  # noqa: ANN001, ANN202
        HANDLERS[kind] = f
        return f

    return add


@handler("markdown")
def read_markdown(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text) of whole files below the roots, ``*.md`` only."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def articles(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Articles of a tree: slug is the root's name and the file's, the title defaults to the file's name."""
    files = read_markdown(spark, roots)
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    block = T.frontmatter(F.col("text"))
    z = T.zones(F.col("text"))
    return files.select(
        F.regexp_extract("path", r"([^/]+/[^/]+)\.md$", 1).alias("slug"), F.coalesce(T.field(block, "title"), stem).alias("title"), T.field(block, "type").alias("type"),
        T.field(block, "confidence").try_cast("double").alias("confidence"), T.field(block, "updated").alias("updated"), (T.field(block, "pinned") == "true").alias("pinned"),
        T.source_count(block).alias("source_count"), z["observed"].alias("observed"), z["synthesized"].alias("synthesized"), F.substring(F.regexp_replace(T.without_frontmatter(F.col("text")), "\n", " "), 1, 200).alias("excerpt"), "text",
    )


def glob_rows(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Files (path) whose path matches an include pattern and whose name matches no exclude; globs with * and ?."""

    def pattern(glob: str) -> str:
        return "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in glob.replace("**/", "\0")).replace("\\\0", "(?:.*/)?")

    name = F.element_at(F.split("path", "/"), -1)
    keep, drop = F.lit(False), F.lit(False)
    for g in include:
        keep = keep | F.col("path").rlike(f"(?:^|/){pattern(g)}$")
    for g in exclude:
        drop = drop | name.rlike(f"^{pattern(g)}$")
    return files.where(keep & ~drop).distinct()


def source_groups(spark: SparkSession, config: dict) -> DataFrame:
    """The groups of a parsed configuration; entries without id, type or include are skipped, other versions refused."""
    if config.get("version", 1) != 1:
        raise ValueError("unknown version of the source configuration")
    rows = [(g["id"], g["type"], g["include"], g.get("exclude") or [], g.get("category"), g.get("description")) for g in config.get("sources") or [] if g.get("id") and g.get("type") and g.get("include")]
    return spark.createDataFrame(rows, "id string, type string, include array<string>, exclude array<string>, category string, description string")


# --- JSONL ---------------------------------------------------------------------------------


def _text_of(value: Column) -> Column:
    """A content that is a string, or the text blocks of an array joined by line ends."""
    blocks = F.try_variant_get(value, "$", "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return F.coalesce(joined, F.try_variant_get(value, "$", "string"))  # as a string, an array would be its JSON


def transcript_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, role, text, ts) of JSONL transcript lines (path, line_no, value); bad lines are skipped.

    Role and content stand in a nested message or flat; only user and assistant turns
    with text come out.
    """
    v = lines.withColumn("v", F.try_parse_json("value")).where("v is not null")
    pick = lambda name: F.coalesce(F.try_variant_get("v", f"$.message.{name}", "string"), F.try_variant_get("v", f"$.{name}", "string"))
    content = F.coalesce(F.try_variant_get("v", "$.message.content", "variant"), F.try_variant_get("v", "$.content", "variant"))
    rows = v.select("path", "line_no", pick("role").alias("role"), _text_of(content).alias("text"), F.try_variant_get("v", "$.timestamp", "string").alias("ts"))
    return rows.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, value): numbered lines of each file; a file is read by one task, line by line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return whole.where("trim(value) <> ''").withColumn("line_no", F.col("line_no") + 1)


def tool_events(spark: SparkSession, path: str) -> DataFrame:
    """Tool calls of JSONL files; malformed lines and values that are no objects are skipped."""
    return tool_calls(spark.read.text(path))


def tool_calls(lines: DataFrame) -> DataFrame:
    """Tool calls of JSON lines (value)."""
    v = lines.withColumn("v", F.try_parse_json("value")).where("schema_of_variant(v) like 'OBJECT%'")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    return v.select(get("ts", "string"), get("session_id", "string"), get("tool", "string"), F.to_json(F.try_variant_get("v", "$.input", "variant")).alias("input"), get("result_size", "bigint"), get("ok", "boolean"))


def tool_events_of(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """Tool calls of all sessions of one day; a day not written YYYY-MM-DD raises, one without a file gives no rows."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"not a day: {day!r}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{day}.jsonl")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return tool_calls(spark.createDataFrame([], "value string"))
    return tool_events(spark, f"{folder}/{day}.jsonl")


def discover_sessions(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, length, modified) of the session files below a root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


#: The two dialects of agent histories: which line kinds hold a message, and where.
DIALECTS = {
    "typed": {"where": "$.type", "kinds": ("user", "assistant"), "role": "$.message.role", "content": "$.message.content", "id": "$.sessionId", "cwd": "$.cwd", "ts": "$.timestamp"},
    "payload": {"where": "$.payload.type", "kinds": ("message",), "role": "$.payload.role", "content": "$.payload.content", "id": "$.payload.id", "cwd": "$.payload.cwd", "ts": "$.timestamp"},
}


def agent_sessions(lines: DataFrame, dialect: str) -> DataFrame:
    """One row per file: the first non-empty id, folder and time, and its ordered turns.

    Turns of a file come as one list; very long files should be read by ``transcript_lines``.
    """
    d = DIALECTS[dialect]
    v = lines.withColumn("v", F.try_parse_json("value")).where("v is not null")
    get = lambda k: F.nullif(F.try_variant_get("v", d[k], "string"), F.lit(""))
    texts = F.try_variant_get("v", d["content"], "array<struct<text: string>>")
    body = F.coalesce(F.array_join(F.transform(texts, lambda b: b["text"]), "\n"), F.try_variant_get("v", d["content"], "string"))
    role = get("role")
    is_turn = F.try_variant_get("v", d["where"], "string").isin(*d["kinds"]) & role.isin("user", "assistant") & (F.trim(body) != "")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    return v.groupBy("path").agg(
        first(get("id")).alias("session_id"), first(get("cwd")).alias("cwd"), first(get("ts")).alias("started_at"),
        F.array_sort(F.collect_list(F.when(is_turn, F.struct("line_no", role.alias("role"), body.alias("text"))))).alias("turns"),
    )


# --- git -----------------------------------------------------------------------------------


def git_log(lines: DataFrame) -> DataFrame:
    """(sha, author, date, message, path, added, deleted) of numbered ``--numstat`` output.

    A header line reads ``commit<TAB>sha<TAB>author<TAB>date<TAB>message``; '-' counts are 0.  The
    header is carried forward within its file.
    """
    parts = F.split("value", "\t")
    head = F.when(F.col("value").startswith("commit\t"), F.struct(*[F.get(parts, i).alias(n) for i, n in enumerate(("kind", "sha", "author", "date", "message"))]))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = lines.withColumn("h", F.last(head, ignorenulls=True).over(w)).where(F.col("value").rlike(r"^(?:\d+|-)\t(?:\d+|-)\t.+"))
    n = lambda i: F.coalesce(F.get(parts, i).try_cast("bigint"), F.lit(0))
    return r.select("h.sha", "h.author", "h.date", "h.message", F.get(parts, 2).alias("file"), n(0).alias("added"), n(1).alias("deleted"))


def diff_hunks(lines: DataFrame, suffix: str = ".php") -> DataFrame:
    """(file, start, end) of the new side of ``-U0`` hunks; a deletion's hunk is its anchor line."""
    name = F.when(F.col("value").startswith("+++ "), F.regexp_extract("value", r"^\+\+\+ (?:b/)?(.+)$", 1))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    r = lines.withColumn("file", F.last(name, ignorenulls=True).over(w)).where(F.col("value").rlike(pattern))
    start = F.regexp_extract("value", pattern, 1).cast("int")
    n = F.coalesce(F.nullif(F.regexp_extract("value", pattern, 2), F.lit("")).try_cast("int"), F.lit(1))
    return r.where(F.col("file").endswith(suffix)).select("file", start.alias("start"), (start + F.greatest(n, F.lit(1)) - 1).alias("end"))


def archive_state(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action) of an append-only archive: keep, replace (a longer extension), or diverged."""
    o, n = old.select(key, F.col(content).alias("_o")), new.select(key, F.col(content).alias("_n"))
    action = F.when(F.col("_o").isNull() | (F.startswith("_n", "_o") & (F.length("_n") > F.length("_o"))), "replace").when(F.startswith("_o", "_n"), "keep").otherwise("diverged")
    return n.join(o, key, "left").select(key, action.alias("action"))
