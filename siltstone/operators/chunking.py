"""Chunkers: one row in, several rows out.  Each keeps the other columns of its input.

Null and empty texts give no rows.  Windows are made by a generated sequence inside the
row, so no shuffle is needed; only the numbering of repeated headings groups rows, by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import chunk_id


def heading_sections(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, chunk_id, section, chunk) per H2 or H3 section with a body.

    Frontmatter and what stands before the first section are dropped; repeated titles of
    one file get ``-2``, ``-3``; the heading stays at the top of its chunk.
    """
    body = F.regexp_replace(F.col(text), r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    parts = F.split(body, r"(?m)(?=^#{2,3} )")
    rows = df.select(F.col(key), F.col(source).alias("source"), F.posexplode(parts).alias("pos", "part")).where(F.col("part").rlike(r"\A#{2,3} "))
    head = F.trim(F.regexp_extract("part", r"\A#{2,3} +([^\n]*)", 1))
    rest = F.regexp_replace("part", r"\A[^\n]*", "")
    rows = rows.where(rest.rlike(r"\S")).withColumn("section", head).withColumn("base", chunk_id(F.col("source"), head))
    n = F.row_number().over(Window.partitionBy(key, "base").orderBy("pos"))
    made = F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string")))
    return rows.select(key, made.alias("chunk_id"), "section", F.regexp_replace("part", r"\A\s+|\s+\z", "").alias("chunk"))


def char_windows(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """``part`` and ``window`` columns; a last window that is already covered is still given."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("part", F.explode(starts)).withColumn("window", F.substring(F.col(text), F.col("part") * step + 1, F.lit(size)))


def _parts(n, size: int, overlap: int):  # noqa: ANN001, ANN202
    """Numbers of the windows over n items, stopping once the end is reached."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    more = F.ceil((n - size) / (size - overlap)).cast("int")
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), more))


def word_windows(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """``part`` and ``window``: ``size`` words joined by blanks, ``overlap`` of them shared with the next."""
    words = df.withColumn("_words", F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    out = words.withColumn("part", F.explode(_parts(F.size("_words"), size, overlap)))
    return out.withColumn("window", F.array_join(F.slice("_words", F.col("part") * (size - overlap) + 1, F.lit(size)), " ")).drop("_words")


def line_windows(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """``first_line``, ``last_line`` (from 1) and ``window``."""
    lines = df.withColumn("_lines", F.split(F.col(text), "\n"))
    out = lines.withColumn("_part", F.explode(_parts(F.size("_lines"), size, overlap)))
    first = F.col("_part") * (size - overlap) + 1
    out = out.withColumn("first_line", first).withColumn("last_line", F.least(first + size - 1, F.size("_lines")))
    return out.withColumn("window", F.array_join(F.slice("_lines", first, F.lit(size)), "\n")).drop("_lines", "_part")


def query_pieces(text: str, size: int = 900, most: int = 12) -> list[str]:
    """At most ``most`` pieces of up to ``size`` characters, cut at the last heading or blank line past the half."""
    out, at = [], 0
    while at < len(text) and len(out) < most:
        head = text[at : at + size]
        if at + size < len(text):
            cut = max(head.rfind("\n#"), head.rfind("\n\n"))
            if cut >= size // 2:
                head = head[:cut]
        if head.strip():
            out.append(head.strip())
        at += max(len(head), 1)
    return out


def query_chunks(df: DataFrame, key: str, text: str, size: int = 900, most: int = 12) -> DataFrame:
    """(key, part, piece): data-dependent cuts, so one Arrow pass; null and blank texts give none."""
    @F.pandas_udf("array<string>")
    def cut(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: query_pieces(t, size, most) if t else [])

    return df.select(key, F.posexplode(cut(F.col(text))).alias("part", "piece"))
