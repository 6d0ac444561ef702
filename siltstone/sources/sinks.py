"""Writers: generations of keyed tables, partition replacement, graph exports and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.session import materialize


class GenerationTable:
    """A keyed table on a shared folder: each change writes a new generation, then a new pointer to it.

    Pointers are numbered files that appear whole, by one rename; the highest number
    counts, and no pointer is taken away before a later one stands.  Readers see one
    generation or the next, never a mixture and never none; a writer that fails at any step
    leaves the last pointer where it was.  One writer at a time: a second one that takes the
    same number fails.
    """

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _pointers(self) -> list[str]:
        found = self._fs().globStatus(self._path("CURRENT-*"))
        return sorted(f.getPath().getName() for f in (found or []))

    def current(self) -> str | None:
        pointers = self._pointers()
        return self.spark.read.text(f"{self.path}/{pointers[-1]}").first()[0] if pointers else None

    def read(self) -> DataFrame | None:
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame) -> str:
        name = f"gen-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _point(self, name: str) -> None:
        fs, old = self._fs(), self._pointers()
        number = int(old[-1].split("-")[1]) + 1 if old else 1
        fresh, target = self._path(f"PENDING-{uuid.uuid4().hex}"), self._path(f"CURRENT-{number:012d}")
        out = fs.create(fresh, False)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(target) or not fs.rename(fresh, target):
            fs.delete(fresh, False)
            raise OSError("another writer has moved the pointer")
        for stale in old[:-1]:  # the one before stays for readers that have just listed it
            fs.delete(self._path(stale), False)

    def _swap(self, df: DataFrame) -> None:
        self._point(self._write(df))

    def _unique(self, rows: DataFrame) -> None:
        if rows.groupBy(self.key).count().where("count > 1").limit(1).count():
            raise ValueError("repeated keys in the rows to write")

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same key; further ones are added.  Repeated keys in ``rows`` raise."""
        self._unique(rows)
        old = self.read()
        self._swap(rows if old is None else old.join(rows.select(self.key), self.key, "left_anti").select(old.columns).unionByName(rows))

    def delete(self, keys: DataFrame) -> None:
        if (old := self.read()) is not None:
            self._swap(old.join(keys.select(self.key), self.key, "left_anti").select(old.columns))

    def stage(self, rows: DataFrame) -> str:
        """Writes rows beside the table, where no reader sees them, and gives their name."""
        self._unique(rows)
        name = f"staged-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def promote(self, staged: str, by: str) -> None:
        """The staged rows take the place of all rows with the same value of ``by``, such as their source file.

        A key that another value of ``by`` holds raises; the stage is taken back then and
        the table stays as it was.
        """
        rows, old = self.spark.read.parquet(f"{self.path}/{staged}"), self.read()
        if old is None:
            self._swap(rows)
        else:
            kept = old.join(rows.select(by).distinct(), by, "left_anti").select(old.columns)
            if kept.join(rows.select(self.key), self.key, "left_semi").limit(1).count():
                self.rollback(staged)
                raise ValueError("a staged key belongs to another source")
            self._swap(kept.unionByName(rows))
        self.rollback(staged)

    def rollback(self, staged: str) -> None:
        """Drops a stage."""
        self._fs().delete(self._path(staged), True)


def upsert_batches(rows: DataFrame, put: Callable[[list[dict]], None], size: int = 256) -> int:
    """Hands all rows to ``put``, a function that runs in the tasks, ``size`` at a time; gives their number.

    A task that is run again puts its batches again, so ``put`` has to be idempotent, as an upsert is.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            n = len(held) - len(held) % size
            for i in range(0, n, size):
                put(held[i : i + size])
            held = held[n:]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        if held:
            put(held)

    return rows.mapInArrow(send, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a folder of JSON lines, one folder per day of ``ts``; nothing that is there is read or changed."""
    events.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").json(path)


def write_once(documents: DataFrame, path: str) -> int:
    """Adds the documents (name_hash and others) whose hash the folder does not hold yet; gives how many."""
    fs = documents.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(documents.sparkSession._jsc.hadoopConfiguration()).exists(fs)
    fresh = documents.dropDuplicates(["name_hash"])
    if there:
        fresh = fresh.join(documents.sparkSession.read.parquet(path).select("name_hash"), "name_hash", "left_anti")
    fresh = materialize(fresh)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def append_logs(entries: DataFrame, logs: str, index: str, chunk: Callable[[DataFrame], DataFrame]) -> bool:
    """Adds entries (day, text) to the logs and chunks the days that grew anew; whether the index is up to date.

    ``chunk`` turns whole logs (day, text) into chunks with a ``day``.  The logs are
    written first; if the chunks fail, the days are noted under ``index``/stale and tried again with the next call.
    """
    spark = entries.sparkSession
    entries.select("day", "text", F.current_timestamp().alias("at")).write.mode("append").partitionBy("day").parquet(logs)
    stale = f"{index}/stale"
    days = entries.select(F.col("day").cast("string").alias("day")).distinct()
    try:
        days = days.unionByName(spark.read.parquet(stale).select("day")).distinct()
    except AnalysisException:
        pass  # nothing is stale
    days = materialize(days)
    try:
        # a log is one document: the entries of a day, in the order in which they came
        grown = spark.read.parquet(logs).withColumn("day", F.col("day").cast("string")).join(days, "day").groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
        replace_partitions(materialize(chunk(grown)), f"{index}/chunks", "day")
    except Exception:
        days.write.mode("overwrite").parquet(stale)
        return False
    days.limit(0).write.mode("overwrite").parquet(stale)
    return True


def zone_rows(rows: DataFrame, zones: tuple[str, ...] = ("observed", "synthesized")) -> DataFrame:
    """Rows (slug, zone, text) that may be written: blank texts are left out, any other zone raises when it is met."""
    known = F.when(F.col("zone").isin(*zones), F.col("zone")).otherwise(F.raise_error(F.concat(F.lit("unknown zone "), F.coalesce("zone", F.lit("null")))))
    return rows.where(F.trim("text") != "").withColumn("zone", known)


class CachedTable:
    """A table made by ``build`` and kept in memory until its sentinel file is touched."""

    def __init__(self, spark: SparkSession, sentinel: str, build: Callable[[], DataFrame]) -> None:
        self.spark, self.build = spark, build
        self.path = spark._jvm.org.apache.hadoop.fs.Path(sentinel)
        self.seen: int | None = None
        self.held: DataFrame | None = None

    def _modified(self) -> int:
        fs = self.path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(self.path).getModificationTime() if fs.exists(self.path) else 0

    def read(self) -> DataFrame:
        now = self._modified()
        if self.held is None or now != self.seen:
            if self.held is not None:
                self.held.unpersist()
            self.held, self.seen = self.build().persist(), now
        return self.held


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes the partitions that ``df`` holds and leaves the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def content_version(key: str, text: str, *metadata: str):  # noqa: ANN201
    """``key::v`` and 16 hex digits over key, text and metadata: equal content gives an equal id."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, text, *metadata)]
    return F.concat(F.col(key), F.lit("::v"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16))


def merge_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A keyed state with incoming values where there are any, others kept."""
    columns = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns if c in new.columns])
    joined = old.join(n, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in columns])


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, line) of a GraphML file: head, nodes by id, edges by ends, tail."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "seq int, line string")
    n = nodes.select(F.lit(1).alias("seq"), F.concat(F.lit('<node id="'), T.xml_escape(F.col("id")), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(2).alias("seq"), F.concat(F.lit('<edge source="'), T.xml_escape(F.col("src")), F.lit('" target="'), T.xml_escape(F.col("dst")), F.lit('"/>')).alias("line"))
    return head.unionByName(n).unionByName(e).orderBy("seq", "line")


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, line) of Cypher statements."""
    n = nodes.select(F.lit(1).alias("seq"), F.concat(F.lit("MERGE (:Node {id: '"), T.cypher_escape(F.col("id")), F.lit("'});")).alias("line"))
    e = edges.select(F.lit(2).alias("seq"), F.concat(F.lit("MATCH (a:Node {id: '"), T.cypher_escape(F.col("src")), F.lit("'}), (b:Node {id: '"), T.cypher_escape(F.col("dst")), F.lit("'}) MERGE (a)-[:LINK]->(b);")).alias("line"))
    return n.unionByName(e).orderBy("seq", "line")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, line) of a JSON document of the graph, nodes and edges in order, each list closed by a null."""
    n = nodes.select(F.lit(1).alias("seq"), F.to_json(F.struct("id")).alias("line"))
    e = edges.select(F.lit(3).alias("seq"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))).alias("line"))
    # a null closes each list, so that every line before it may end with a comma wherever it is written
    n, e = (d.withColumn("line", F.concat("line", F.lit(","))) for d in (n, e))
    frame = nodes.sparkSession.createDataFrame([(0, '{"nodes": ['), (2, 'null], "edges": ['), (4, "null]}")], "seq int, line string")
    return frame.unionByName(n).unionByName(e).orderBy("seq", "line")


def graph_html(nodes: DataFrame, edges: DataFrame, title: str = "Graph") -> DataFrame:
    """(seq, line) of a page that lists the graph in two tables and needs no script from elsewhere."""
    spark = nodes.sparkSession
    frame = [
        (0, f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><table id="nodes"><tr><th>node</th></tr>'),
        (2, '</table><table id="edges"><tr><th>from</th><th>to</th></tr>'),
        (4, "</table></body></html>"),
    ]
    cell = lambda c: F.concat(F.lit("<td>"), T.xml_escape(F.col(c)), F.lit("</td>"))
    row = lambda *c: F.concat(F.lit("<tr>"), *map(cell, c), F.lit("</tr>")).alias("line")
    n, e = nodes.select(F.lit(1).alias("seq"), row("id")), edges.select(F.lit(3).alias("seq"), row("src", "dst"))
    return spark.createDataFrame(frame, "seq int, line string").unionByName(n).unionByName(e).orderBy("seq", "line")


def _node_id(text: Column) -> Column:
    return F.concat(F.lit("n_"), F.substring(F.md5(text), 1, 12))


def _node(key: Column, label: Column) -> Column:
    return F.concat(_node_id(key), F.lit('["'), T.mermaid_escape(label), F.lit('"]'))


def _chart(spark: SparkSession, head: str, lines: DataFrame) -> DataFrame:
    return spark.createDataFrame([(0, head)], "seq int, line string").unionByName(lines.select(F.lit(1).alias("seq"), F.concat(F.lit("  "), "line").alias("line")).distinct()).orderBy("seq", "line")


def mermaid(edges: DataFrame) -> DataFrame:
    """(seq, line) of a Mermaid flow chart of edges, such as those of the cycles of a graph."""
    return _chart(edges.sparkSession, "flowchart LR", edges.select(F.concat(_node(F.col("src"), F.col("src")), F.lit(" --> "), _node(F.col("dst"), F.col("dst"))).alias("line")))


def mermaid_trace(paths: DataFrame) -> DataFrame:
    """(seq, line) of the call tree of (path array, leaf): every place in the tree is a node, cycles are marked."""
    prefix = lambda k: F.array_join(F.slice("path", 1, k), ">")
    steps = paths.select("path", "leaf", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"))
    mark = F.when((F.col("k") == F.size("path")) & (F.col("leaf") == "cycle"), " (cycle)").otherwise("")
    here = _node(prefix(F.col("k")), F.concat(F.element_at("path", F.col("k")), mark))
    up = F.when(F.col("k") > 1, F.concat(_node_id(prefix(F.col("k") - 1)), F.lit(" --> "), here)).otherwise(here)
    return _chart(paths.sparkSession, "flowchart TD", steps.select(up.alias("line")))


def mermaid_impact(reaches: DataFrame) -> DataFrame:
    """(seq, line) of what a change reaches: (kind, name, risk, symbol, depth), routes with their risk, scripts apart."""
    label = F.when(F.col("kind") == "route", F.concat("name", F.lit(" risk "), F.coalesce(F.col("risk").cast("string"), F.lit("0")))).otherwise(F.col("name"))
    line = F.concat(_node(F.concat_ws(" ", "kind", "name"), label), F.when(F.col("kind") == "script", F.lit(" -.->|")).otherwise(F.lit(" -->|")), F.col("depth").cast("string"), F.lit("| "), _node(F.col("symbol"), F.col("symbol")))
    return _chart(reaches.sparkSession, "flowchart TD", reaches.select(line.alias("line")))


def canary_report(results: DataFrame, day: str) -> DataFrame:
    """(seq, line) of the report on known-answer checks: id, passed, missing, forbidden, answer, error."""
    status = F.when(F.col("error").isNotNull(), "errored").when(F.col("passed"), "passed").otherwise("failed")
    r = results.withColumn("status", status)
    n = lambda s: F.count_if(F.col("status") == s).cast("string")
    head = r.agg(F.concat(F.lit("**Total:** "), F.count("*").cast("string"), F.lit(" canaries | Passed: "), n("passed"), F.lit(" | Failed: "), n("failed"), F.lit(" | Errored: "), n("errored")).alias("line")).select(F.lit(1).alias("seq"), F.lit("").alias("id"), "line")
    title = r.sparkSession.createDataFrame([(0, "", f"# Canary Report - {day}")], "seq int, id string, line string")
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n**{label}:** "), F.array_join(c, ", "))).otherwise("")
    body = F.when(F.col("status") == "errored", F.concat(F.lit("- **"), "id", F.lit("**: "), "error")).when(
        F.col("status") == "failed", F.concat(F.lit("### "), "id", listed("Missing substrings", "missing"), listed("Forbidden substrings matched", "forbidden"), F.lit("\n\n> "), F.replace(F.coalesce("answer", F.lit("")), F.lit("\n"), F.lit("\n> ")))
    ).otherwise(F.concat(F.lit("- "), "id"))
    order = F.when(F.col("status") == "errored", 3).when(F.col("status") == "failed", 5).otherwise(7)
    rows = r.select(order.alias("seq"), "id", body.alias("line"))
    heads = r.select((order - 1).alias("seq"), F.lit("").alias("id"), F.concat(F.lit("## "), F.initcap("status"), F.lit(" Canaries")).alias("line")).distinct()
    return title.unionByName(head).unionByName(heads).unionByName(rows).orderBy("seq", "id").select("seq", "line")


def lessons(scores: DataFrame, trusted: float = 0.7, contested: float = 0.4) -> DataFrame:
    """(seq, slug, line) of the digest of feedback: slug, score, useful, dead_end, corrected, last_note.

    Contested articles come first, the least score first; then trusted ones, the best first.
    """
    note = F.substring(F.replace(F.coalesce("last_note", F.lit("")), F.lit("|"), F.lit("\\|")), 1, 80)
    total = F.col("useful") + F.col("dead_end") + F.col("corrected")
    link, score = F.concat(F.lit("[["), "slug", F.lit("]]")), F.format_string("%.2f", "score")
    table = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[x.cast("string") for x in c]), F.lit(" |"))
    bad = scores.where(F.col("score") < contested).select(F.lit(1).alias("seq"), F.col("score").alias("k"), (-total).alias("t"), "slug", table(link, score, F.col("corrected"), F.col("dead_end"), F.col("useful"), note).alias("line"))
    good = scores.where(F.col("score") >= trusted).select(F.lit(3).alias("seq"), (-F.col("score")).alias("k"), (-total).alias("t"), "slug", table(link, score, F.col("useful"), F.col("dead_end"), F.col("corrected")).alias("line"))
    heads = scores.agg(F.count_if(F.col("score") < contested).alias("b"), F.count_if(F.col("score") >= trusted).alias("g"))
    head = lambda seq, text, n: heads.select(F.lit(seq).alias("seq"), F.lit(0.0).alias("k"), F.lit(0).cast("bigint").alias("t"), F.lit("").alias("slug"), F.concat(F.lit(text), F.lit(" ("), F.col(n).cast("string"), F.lit(")")).alias("line"))
    return head(0, "## Contested", "b").unionByName(bad).unionByName(head(2, "## Trusted", "g")).unionByName(good).orderBy("seq", "k", "t", "slug").select("seq", "slug", "line")


def preflight_block(candidates: DataFrame) -> DataFrame:
    """(seq, line): the articles most like a new one (slug, title, similarity), best first; without one no row."""
    rows = candidates.select(F.lit(1).alias("seq"), F.col("similarity").alias("s"), "slug", F.concat(F.lit("- `"), "slug", F.lit("` (similarity "), F.when(F.col("similarity").isNull(), "?").otherwise(F.format_string("%.2f", "similarity")), F.lit(")"), F.coalesce(F.concat(F.lit(" - "), "title"), F.lit(""))).alias("line"))
    head = candidates.limit(1).select(F.lit(0).alias("seq"), F.lit(None).cast("double").alias("s"), F.lit("").alias("slug"), F.lit("## Closest existing articles (possible duplicates)").alias("line"))
    return head.unionByName(rows).orderBy("seq", F.desc_nulls_last("s"), "slug").select("seq", "line")


def whole_content(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(seq, path, part): the index, then every page in order of its folder and path, each under its name.

    Joined with ``\\n\\n---\\n\\n`` the parts are one document; they stay rows, so that it may be of any size.
    """
    folder = F.element_at(F.create_map(F.lit("concepts"), F.lit(1), F.lit("connections"), F.lit(2), F.lit("qa"), F.lit(3)), F.substring_index("path", "/", 1))
    head = index.select(F.lit(0).alias("seq"), F.lit("").alias("path"), F.concat(F.lit("## INDEX\n\n"), "text").alias("part"))
    body = pages.where(F.col("path").rlike("^(?:concepts|connections|qa)/")).select(folder.alias("seq"), "path", F.concat(F.lit("## "), "path", F.lit("\n\n"), "text").alias("part"))
    return head.unionByName(body).orderBy("seq", "path")


def session_markdown(turns: DataFrame) -> DataFrame:
    """(session_id, markdown, name_hash): a rendering per part of a conversation, named by its content."""
    body = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("**"), F.initcap(t["role"]), F.lit(":**\n\n"), t["text"])), "\n\n")
    return turns.select("session_id", body.alias("markdown")).withColumn("name_hash", T.content_hash(F.col("markdown")))
