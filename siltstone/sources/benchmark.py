"""Benchmark questions, canaries and selected transcripts, with the invariants their readers demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import files

_QUESTIONS = (
    "question_id string, question string, question_type string, haystack_session_ids array<string>, "
    "haystack_sessions array<array<struct<role: string, content: string>>>, answer_session_ids array<string>"
)


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions with gold ids, haystack sessions as flat texts) of a JSON file.

    Ids stand one to one with sessions, gold lies in the haystack, and neither a question
    nor its gold is empty; anything else raises when the rows are computed.  Sessions
    repeated with the same text collapse, with another text they raise.
    """
    q = spark.read.schema(_QUESTIONS).option("multiLine", "true").json(path)
    ok = (
        (F.trim("question") != "") & (F.size("haystack_session_ids") == F.size("haystack_sessions")) & (F.size("answer_session_ids") > 0)
        & (F.size(F.array_except("answer_session_ids", "haystack_session_ids")) == 0)
    )
    checked = q.withColumn("question", F.when(F.coalesce(ok, F.lit(False)), F.col("question")).otherwise(F.raise_error(F.concat(F.lit("question is not sound: "), F.coalesce("question_id", F.lit("?"))))))
    line = lambda t: F.concat(F.coalesce(t["role"], F.lit("unknown")), F.lit(": "), F.coalesce(t["content"], F.lit("")))
    each = checked.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("s"))
    flat = each.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.array_join(F.transform("s.haystack_sessions", line), "\n").alias("text"))
    one = flat.groupBy("question_id", "session_id").agg(F.min("text").alias("text"), F.countDistinct("text").alias("n"))
    text = F.when(F.col("n") == 1, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("conflicting texts of session "), F.col("session_id"))))
    haystack = one.select("question_id", "session_id", text.alias("text")).where("trim(text) <> ''")
    return checked.select("question_id", "question", "question_type", F.col("answer_session_ids").alias("gold")), haystack


def canaries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Known-answer checks of a parsed configuration; a missing id, question or must_contain raises."""
    for r in rows:
        if not (r.get("id") and r.get("question") and r.get("must_contain")):
            raise ValueError(f"canary without id, question or must_contain: {r}")
    data = [(r["id"], r["question"], list(r["must_contain"]), list(r.get("must_not_contain") or [])) for r in rows]
    return spark.createDataFrame(data, "id string, question string, must_contain array<string>, must_not_contain array<string>")


def check_answers(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """(id, passed, missing, forbidden) of answers (id, answer); no answer misses everything."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    lacks = F.filter("must_contain", lambda m: ~F.contains(low, F.lower(m)))
    wrong = F.filter("must_not_contain", lambda m: F.contains(low, F.lower(m)))
    j = checks.join(answers, "id", "left")
    return j.select("id", ((F.size(lacks) == 0) & (F.size(wrong) == 0)).alias("passed"), lacks.alias("missing"), wrong.alias("forbidden"))


def backfill(spark: SparkSession, folder: str, ids: list[str] | None = None) -> DataFrame:
    """Turns of the transcripts of a folder, or of the named ones; names without a file raise before anything is read."""
    if ids is None:
        return files.transcript_lines(files.read_lines(spark, f"{folder}/*.jsonl"))
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    lost = [i for i in ids if not fs.exists(jvm.Path(f"{folder}/{i}.jsonl"))]
    if lost:
        raise FileNotFoundError(f"no transcript for {lost}")
    return files.transcript_lines(files.read_lines(spark, [f"{folder}/{i}.jsonl" for i in ids]))
