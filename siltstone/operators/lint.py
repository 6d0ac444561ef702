"""Quality checks over a corpus as one table of issues, and fixers that rewrite text.

Checks are a registry of functions ``Corpus`` -> issues; ``report`` is their union.
Issues: severity, check, file, detail, argument (what a fixer has to know).  A check
whose tables the corpus does not hold gives no issues.  Pages without a text are no pages.

Fixers are pure functions text -> text, registered by check; ``apply_fixes`` runs them
over a table of pages.  All are idempotent: a second run changes nothing.
"""

from __future__ import annotations

import difflib
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scoring as S
from siltstone.functions import text as T
from siltstone.operators import joins

#: The kinds of memories and the relations of links.
MEMORY_TYPES = ("fact", "event", "discovery", "preference", "advice", "decision", "tension", "hypothesis")
RELATIONS = ("depends_on", "implements", "conflicts_with", "supersedes", "related_to", "blocks", "corroborates", "refutes")
#: Beginnings of file names and the kind they tell.
TYPE_PREFIXES = {
    "feedback_": "preference", "feedback-": "preference", "decision_": "decision", "decision-": "decision",
    "discovery_": "discovery", "discovery-": "discovery", "event_": "event", "event-": "event",
}
#: Heading, bullet and comments that fixers write.
RELATED, BACKLINK = "### Related Concepts", "- [[{}]] - Auto-added backlink"
BROKEN_LINK, BROKEN_ANCHOR = "<!-- BROKEN-LINK: {} -->", "<!-- BROKEN-SRC: {} -->"
LEAST_WORDS, OLD_DAYS, FUZZY = 200, 90, 0.9


@dataclass(frozen=True)
class Corpus:
    """What the checks look at; everything but the pages may be left out."""

    pages: DataFrame  #: path, slug, text
    files: DataFrame | None = None  #: path: the files that anchors may name, of all roots
    logs: DataFrame | None = None  #: name, hash: the logs there are
    compiled: DataFrame | None = None  #: name, hash: the logs as last compiled
    declared: DataFrame | None = None  #: key: the source files that are declared
    ingested: DataFrame | None = None  #: key: the source files that were ingested
    indexed: DataFrame | None = None  #: slug: the articles that have vectors
    similar: DataFrame | None = None  #: slug_a, slug_b, cosine: vectors that are alike
    accesses: DataFrame | None = None  #: slug, n
    today: str = "1970-01-01"


CHECKS: dict[str, Callable[[Corpus], DataFrame | None]] = {}


def check(f: Callable[[Corpus], DataFrame | None]) -> Callable[[Corpus], DataFrame | None]:
    """Registers a check; it gives (severity, check, file, detail, argument) or None."""
    CHECKS[f.__name__] = f
    return f


def _issues(rows: DataFrame, severity: str | Column, name: str | Column, file: str, detail: Column, argument: Column | None = None) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        as_column(severity).alias("severity"), as_column(name).alias("check"), F.col(file).alias("file"), detail.cast("string").alias("detail"), (F.lit(None) if argument is None else argument).cast("string").alias("argument")
    )


def _links(pages: DataFrame) -> DataFrame:
    return pages.select("path", "slug", F.explode(T.wikilinks(F.col("text"))).alias("target"))


def _wiki(target: str = "target") -> Column:
    return F.col(target).rlike("^(?:concepts|connections|qa)/")


@check
def broken_link(c: Corpus) -> DataFrame:
    known = c.pages.select(F.col("slug").alias("target")).distinct()
    return _issues(_links(c.pages).where(_wiki()).join(known, "target", "left_anti"), "error", "broken_link", "path", F.col("target"), F.col("target"))


@check
def orphan_page(c: Corpus) -> DataFrame:
    linked = _links(c.pages).select(F.col("target").alias("slug")).distinct()
    return _issues(c.pages.join(linked, "slug", "left_anti"), "warning", "orphan_page", "path", F.col("slug"))


@check
def orphan_source(c: Corpus) -> DataFrame | None:
    if c.logs is None or c.compiled is None:
        return None
    return _issues(c.logs.join(c.compiled.select("name"), "name", "left_anti"), "warning", "orphan_source", "name", F.col("name"))


@check
def orphan_source_file(c: Corpus) -> DataFrame | None:
    if c.declared is None or c.ingested is None:
        return None
    return _issues(c.declared.join(c.ingested.select("key"), "key", "left_anti"), "warning", "orphan_source_file", "key", F.col("key"))


@check
def stale_article(c: Corpus) -> DataFrame | None:
    if c.logs is None or c.compiled is None:
        return None
    both = c.logs.join(c.compiled.select("name", F.col("hash").alias("compiled_hash")), "name").where(~F.col("hash").eqNullSafe(F.col("compiled_hash")))
    return _issues(both, "warning", "stale_article", "name", F.col("name"), F.col("name"))


@check
def missing_backlink(c: Corpus) -> DataFrame:
    e = _links(c.pages).where(_wiki()).select("path", F.col("slug").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()
    known = c.pages.select(F.col("slug").alias("dst")).distinct()
    back = _links(c.pages).select(F.col("target").alias("src"), F.col("slug").alias("dst")).distinct()
    found = e.join(known, "dst", "left_semi").join(back, ["src", "dst"], "left_anti")
    return _issues(found, "suggestion", "missing_backlink", "path", F.col("dst"), F.concat_ws(" ", "src", "dst"))


@check
def sparse_article(c: Corpus) -> DataFrame:
    n = T.word_count(F.col("text"))
    return _issues(c.pages.where(n < LEAST_WORDS), "suggestion", "sparse_article", "path", n)


@check
def source_anchor(c: Corpus) -> DataFrame | None:
    """Anchors that no root holds, and pages without any."""
    anchors = c.pages.select("path", T.source_anchors(F.col("text")).alias("anchors"))
    out = _issues(anchors.where(F.size("anchors") == 0), "suggestion", "missing_source_anchor", "path", F.lit("no anchors"))
    if c.files is None:
        return out
    each = anchors.select(F.col("path").alias("page"), F.explode("anchors").alias("path")).join(c.files.select("path").distinct(), "path", "left_anti")
    return out.unionByName(_issues(each, "error", "broken_source_anchor", "page", F.col("path"), F.col("path")))


@check
def wikilink_relation(c: Corpus) -> DataFrame:
    r = c.pages.select("path", F.explode(T.typed_wikilinks(F.col("text"))).alias("l")).where("l.relation is not null")
    return _issues(r.where(~F.col("l.relation").isin(*RELATIONS)), "error", "invalid_wikilink_relation", "path", F.concat(F.lit("[["), "l.target", F.lit("]]{"), "l.relation", F.lit("}")))


@check
def memory_type(c: Corpus) -> DataFrame:
    rows = c.pages.select("path", T.field(T.frontmatter(F.col("text")), "type").alias("kind")).where(F.col("kind").isNull() | ~F.col("kind").isin(*MEMORY_TYPES))
    missing = F.col("kind").isNull()
    return _issues(rows, F.when(missing, "suggestion").otherwise("error"), F.when(missing, "missing_memory_type").otherwise("invalid_memory_type"), "path", F.coalesce("kind", F.lit("no type")))


@check
def near_duplicate(c: Corpus, identical: float = 0.97) -> DataFrame | None:
    if c.similar is None:
        return None
    return _issues(c.similar, F.when(F.col("cosine") >= identical, "error").otherwise("warning"), "near_duplicate", "slug_a", F.concat(F.col("slug_b"), F.format_string(" (cosine %.3f)", "cosine")))


@check
def stale_vector(c: Corpus) -> DataFrame | None:
    if c.indexed is None:
        return None
    return _issues(c.indexed.select("slug").distinct().join(c.pages.select("slug").distinct(), "slug", "left_anti"), "warning", "stale_vector", "slug", F.col("slug"))


@check
def low_priority(c: Corpus) -> DataFrame | None:
    """Pages that are old, never looked up and not pinned, with the score they would get."""
    if c.accesses is None:
        return None
    fm = T.frontmatter(F.col("text"))
    day = F.coalesce(*[F.try_to_date(F.when(T.field(fm, k).rlike(r"^\d{4}-\d{2}-\d{2}$"), T.field(fm, k)), "yyyy-MM-dd") for k in ("updated", "created")])
    today = F.lit(c.today).cast("date")
    pages = c.pages.where(~F.coalesce(F.lower(T.field(fm, "pinned")) == "true", F.lit(False))).select("path", "slug", day.alias("day"))
    pages = pages.where(F.datediff(today, "day") > OLD_DAYS).join(c.accesses.where("n > 0").select("slug"), "slug", "left_anti")
    inbound = _links(c.pages).where("target not like 'daily/%'").groupBy(F.col("target").alias("slug")).agg(F.count("*").alias("links"))
    scored = pages.join(inbound, "slug", "left")
    score = S.priority(S.recency(F.col("day"), today), S.saturating(F.col("links"), 20), F.lit(0.0), F.lit(0.5), F.lit(None))
    return _issues(scored, "suggestion", "low_priority_article", "path", F.format_string("%d days, %d links, score %.3f", F.datediff(today, "day"), F.coalesce("links", F.lit(0)), score))


def contradictions(replies: DataFrame) -> DataFrame:
    """Issues out of a reviewer's replies (one text column, ``reply``): lines ``CONTRADICTION: [a] vs [b] - why``; others are skipped.

    Slugs may stand in brackets, double brackets or back quotes, with or without ``.md``.
    """
    name = r"[\[`]*([\w./-]+?)(?:\.md)?[\]`]*"
    line = rf"(?im)^\s*(?:[-*]\s*)?(CONTRADICTION|INCONSISTENCY)\s*:\s*{name}\s+(?:vs\.?|and|<->)\s+{name}\s*(?:[-–—:]\s*(.*))?$"
    parts = F.arrays_zip(*[F.regexp_extract_all("reply", F.lit(line), F.lit(g)) for g in (1, 2, 3, 4)])
    each = replies.where("reply is not null").select(F.explode(parts).alias("p"))
    rows = each.select(F.concat(F.col("p.1"), F.lit(".md")).alias("file"), F.col("p.2").alias("other"), F.trim("p.3").alias("why"))
    return _issues(rows, "warning", "contradiction", "file", F.concat_ws(" - ", "other", "why"), F.col("other"))


def report(corpus: Corpus, names: list[str] | None = None) -> DataFrame:
    """All issues of the chosen checks; an unknown name raises."""
    chosen = names or list(CHECKS)
    unknown = [n for n in chosen if n not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks {unknown}; known are {sorted(CHECKS)}")
    out = None
    for n in chosen:
        issues = CHECKS[n](corpus)
        if issues is not None:
            out = issues if out is None else out.unionByName(issues)
    if out is None:
        raise ValueError(f"the corpus has no tables for {chosen}")
    return out


# --- fixers --------------------------------------------------------------------------------

FIXERS: dict[str, Callable[[str, str, str | None, str | None], str]] = {}


def fixer(name: str):  # noqa: ANN201
    """Registers a fixer: (path, text, argument, best match) -> text."""

    def add(f: Callable[[str, str, str | None, str | None], str]) -> Callable[[str, str, str | None, str | None], str]:
        FIXERS[name] = f
        return f

    return add


def wrap_bare(text: str, target: str, comment: str) -> str:
    """``target`` put into the comment wherever it does not stand in one already."""
    head = comment.split("{}")[0]
    return re.sub(rf"(?<!{re.escape(head)}){re.escape(target)}", lambda m: comment.format(m.group()), text)


def _repointed(text: str, mark: str, argument: str | None, best: str | None, comment: str) -> str:
    old = mark.format(argument)
    if not argument or old not in text or text.count(comment.split("{}")[0] + old) >= text.count(old):
        return text
    return text.replace(old, mark.format(best)) if best else wrap_bare(text, old, comment)


@fixer("broken_link")
def fix_broken_link(path: str, text: str, argument: str | None, best: str | None) -> str:
    """Points the link at the best match, or comments it out when there is none."""
    return _repointed(text, "[[{}]]", argument, best, BROKEN_LINK)


@fixer("broken_source_anchor")
def fix_anchor(path: str, text: str, argument: str | None, best: str | None) -> str:
    return _repointed(text, "[src:{}]", argument, best, BROKEN_ANCHOR)


def _body_start(text: str) -> int:
    end = text.find("---", 3) if text.startswith("---") else -1
    return end + 3 if end >= 0 else 0


def with_related(text: str, bullets: list[str]) -> str:
    """The bullets under the related concepts; the section is made at the end of the truth if it is not there."""
    if not bullets:
        return text
    lines = "\n".join(bullets)
    if m := re.search(rf"^{re.escape(RELATED)}[ \t]*\n(?:[ \t]*\n)?((?:[ \t]*[-*] [^\n]*(?:\n|\Z))*)", text, re.M):
        kept = m.group(1).rstrip("\n")
        return text[: m.start(1)] + (kept + "\n" if kept else "") + lines + "\n" + text[m.end(1) :]
    start = _body_start(text)
    cut = re.search(r"^(?:---|## Timeline)[ \t]*$", text[start:], re.M)
    section = f"{RELATED}\n\n{lines}\n"
    if cut:
        at = start + cut.start()
        return f"{text[:at].rstrip()}\n\n{section}\n{text[at:]}"
    return f"{text.rstrip()}\n\n{section}"


@fixer("missing_backlink")
def fix_backlink(path: str, text: str, argument: str | None, best: str | None) -> str:
    """Links back to the page that links here; a link that is there stays single."""
    return text if not argument or f"[[{argument}]]" in text else with_related(text, [BACKLINK.format(argument)])


@fixer("missing_memory_type")
def fix_memory_type(path: str, text: str, argument: str | None, best: str | None) -> str:
    """Sets the type that the file's name tells, at the end of the frontmatter; a page with a type is left alone."""
    name = path.rsplit("/", 1)[-1]
    kind = next((k for p, k in TYPE_PREFIXES.items() if name.startswith(p)), None)
    end = text.find("---", 3)
    if kind is None or not text.startswith("---") or end < 0 or re.search(r"^type\s*:", text, re.M):
        return text
    return f"{text[:end]}type: {kind}\n{text[end:]}"


def fix_stale(compiled: DataFrame, issues: DataFrame) -> DataFrame:
    """(name, hash) with the hash of stale logs emptied, so that the next run takes them for new."""
    stale = issues.where(F.col("check") == "stale_article").select(F.col("argument").alias("name"), F.lit(True).alias("stale")).distinct()
    return compiled.join(stale, "name", "left").select("name", F.when(F.col("stale"), "").otherwise(F.col("hash")).alias("hash"))


def apply_fixes(pages: DataFrame, issues: DataFrame, only: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """(path, text, fixed, attempted) of the pages that have an issue with a fixer.

    Broken links look for the page most like them, broken anchors for the file.  ``only``
    restricts the checks; those without a fixer are skipped.  The fixes of one page are
    applied in one task, in order of check and argument: they all end up in its one text.
    """
    checks = [c for c in (only or FIXERS) if c in FIXERS]
    chosen = issues.where(F.col("check").isin(*checks)).select("check", "file", "argument").distinct()
    # a missing backlink is mended where the link leads, not where it was found
    pair = F.split("argument", " ")
    moved = chosen.where("check = 'missing_backlink'").select("check", pair[1].alias("slug"), pair[0].alias("argument")).join(pages.select("slug", F.col("path").alias("file")).distinct(), "slug").select("check", "file", "argument")
    rest = chosen.where("check <> 'missing_backlink'")
    link = best_matches(rest.where("check = 'broken_link'").select(F.col("argument").alias("target")), pages.select("slug"), FUZZY).select(F.lit("broken_link").alias("check"), F.col("target").alias("argument"), "best")
    paths = (pages if files is None else files).select(F.col("path").alias("slug"))
    anchor = best_matches(rest.where("check = 'broken_source_anchor'").select(F.col("argument").alias("target")), paths, FUZZY).select(F.lit("broken_source_anchor").alias("check"), F.col("target").alias("argument"), "best")
    fixes = rest.join(link.unionByName(anchor), ["check", "argument"], "left").unionByName(moved.withColumn("best", F.lit(None).cast("string")))
    grouped = fixes.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("check", "argument", "best"))).alias("fixes"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, counts, tried = batch.column(0).to_pylist(), [], [], []
            for path, text, todo in zip(paths, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fixed = 0
                for f in todo:
                    new = FIXERS[f["check"]](path, text, f["argument"], f["best"])
                    fixed += new != text
                    text = new
                texts.append(text), counts.append(fixed), tried.append(len(todo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(tried, pa.int64())], names=["path", "text", "fixed", "attempted"])

    return pages.select("path", "text").join(grouped, "path").mapInArrow(scan, "path string, text string, fixed bigint, attempted bigint")


def title_index(articles: DataFrame, least: int = 4) -> DataFrame:
    """(name, slug): titles and aliases in lower case; of articles that share one the first (by ``seq``) has it.

    ``articles``: seq, slug, title, aliases.
    """
    names = articles.select("seq", "slug", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k", "name"))
    names = names.select("seq", "k", "slug", F.lower(F.trim("name")).alias("name")).where(F.length("name") >= least)
    return names.groupBy("name").agg(F.min_by("slug", F.struct("seq", "k")).alias("slug"))


def add_related_links(text: str, slugs: list[str]) -> str:
    """The text with links to those of the slugs that it does not link to yet."""
    have = set(re.findall(T.WIKILINK, text))
    return with_related(text, [f"- [[{s}]]" for s in slugs if s not in have])


def crosslinked(pages: DataFrame, index: DataFrame) -> DataFrame:
    """(path, n_links, text) of the pages whose prose names articles that they do not link to, with the links added.

    ``pages``: path, slug, text; ``index``: name, slug.  Links come in the order in which their names first stand.
    """
    prose = pages.select("path", T.prose_only(F.col("text")).alias("prose"))
    found = joins.mentions(prose, "path", "prose", index.select("name")).join(index.withColumnRenamed("slug", "target"), "name")
    first = found.groupBy("path", "target").agg(F.min("position").alias("at"))
    own = pages.select("path", F.col("slug").alias("target"))
    have = _links(pages).select("path", "target").distinct()
    new = first.join(own, ["path", "target"], "left_anti").join(have, ["path", "target"], "left_anti")
    # at most one entry per article named in the one page
    slugs = new.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda x: x["target"]).alias("slugs"))

    @F.pandas_udf("string")
    def linked(text, slugs):  # noqa: ANN001, ANN202
        return text.combine(slugs, lambda t, s: add_related_links(t, list(s)))

    return pages.join(slugs, "path").select("path", F.size("slugs").alias("n_links"), linked("text", "slugs").alias("text"))


def best_matches(wanted: DataFrame, known: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(target, best, ratio): the most alike known slug at or above ``ratio`` by matching blocks.

    Candidates are those of nearly the same length with a word in common, met by an
    equi-join on words; ties go to the least slug.  The pairs stay where they meet: bounds of
    what blocks can match (a mask of the letters, then the characters and the pairs of neighbours
    that both hold) leave few to be compared, and one row per target and batch goes on.
    """
    # the folder says nothing: nearly all share it
    word = lambda c: F.explode(F.array_distinct(F.split(F.regexp_replace(c, "^[a-z]+/", ""), "[^a-z0-9]+")))
    times = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    bit = lambda here, at: F.when(here, F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint")
    # which letters a text holds, and which twice: each bit that differs is a character that matches nothing
    bits = lambda c: sum((bit(times(c, x) >= n, 26 * (n - 1) + i) for i, x in enumerate(string.ascii_lowercase) for n in (1, 2)), sum(bit(F.contains(c, F.lit(d)), 52 + int(d)) for d in string.digits))
    a = wanted.select("target").distinct().withColumn("mask_a", bits(F.col("target"))).withColumn("word", word("target")).where("length(word) > 2")
    b = known.select(F.col("slug").alias("best")).distinct().withColumn("mask_b", bits(F.col("best"))).withColumn("word", word("best")).where("length(word) > 2")
    near = F.least(F.length("target"), F.length("best")) * 2 >= ratio * (F.length("target") + F.length("best"))
    both = F.length("target") + F.length("best")
    alike = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= both - 2 * F.ceil(ratio * both / 2 - 1e-9)
    pairs = a.join(b, "word").where(near & alike).select("target", "best")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets, bests = (c.dictionary_encode() for c in batch.columns)
            one, other = (np.array(x) for x in (targets.indices, bests.indices))
            (m, pm), (n, pn) = (character_counts(d.dictionary.to_pylist()) for d in (targets, bests))
            keep = np.ones(len(one), bool)
            left, right = m.sum(1).astype(np.int64), n.sum(1).astype(np.int64)
            whole = left[one] + right[other]
            for start in range(0, len(one), 4096):
                x, y, part = one[start : start + 4096], other[start : start + 4096], slice(start, start + 4096)
                keep[part] = 2 * np.minimum(m[x], n[y]).sum(1) >= ratio * whole[part] - 1e-9
            at = np.flatnonzero(keep)
            # with s of the target unmatched or the slug's own, blocks are at most s + 1, and each holds one pair less than characters
            slack = whole[at] - 2 * np.ceil(ratio * whole[at] / 2 - 1e-9)
            for start in range(0, len(at), 4096):
                k, part = at[start : start + 4096], slice(start, start + 4096)
                keep[k] = np.minimum(pm[one[k]], pn[other[k]]).sum(1) >= np.ceil(ratio * whole[k] / 2 - 1e-9) - (slack[part] + 1)
            names, slugs, top = targets.dictionary.to_pylist(), bests.dictionary.to_pylist(), {}
            matcher, last = difflib.SequenceMatcher(None), None
            for k in sorted(set(zip(other[keep].tolist(), one[keep].tolist(), strict=True))):
                if k[0] != last:
                    matcher.set_seq2(slugs[last := k[0]])
                matcher.set_seq1(names[k[1]])
                if (r := matcher.ratio()) >= ratio:
                    top[k[1]] = min(top.get(k[1], (0.0, "")), (-r, slugs[k[0]]))
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in top], pa.string()), pa.array([r for r, _ in top.values()], pa.float64()), pa.array([b for _, b in top.values()], pa.string())], names=["target", "r", "best"])

    scored = pairs.mapInArrow(compare, "target string, r double, best string")
    top = scored.groupBy("target").agg(F.min(F.struct("r", "best")).alias("m"))
    return top.select("target", F.col("m.best").alias("best"), F.round(-F.col("m.r"), 6).alias("ratio"))


def character_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text holds the characters, and the pairs of neighbours, of each of 64 and 128 groups (at most 255 times)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    single = np.bincount(row * 64 + codes % 64, minlength=len(texts) * 64).reshape(-1, 64)
    same = row[1:] == row[:-1]
    double = np.bincount((row[:-1] * 128 + (codes[:-1] * 31 + codes[1:]) % 128)[same], minlength=len(texts) * 128).reshape(-1, 128)
    kind = np.uint8 if not len(lengths) or lengths.max() < 256 else np.int64
    return single.astype(kind), double.astype(kind)


def mask_non_prose(text: str) -> str:
    """The text with frontmatter, code and links blanked at the same length, line ends kept."""
    out = text
    for pattern, flags in ((r"\A---.*?---", re.S), (r"```.*?```", re.S), (r"\[\[[^\]]*\]\]", 0), (r"\[[^\]]*\]\([^)]*\)", 0), (r"`[^`\n]*`", 0)):
        out = re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m.group()), out, flags=flags)
    return out
