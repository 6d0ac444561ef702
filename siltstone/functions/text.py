"""Text functions as Column expressions: they stay in the JVM and need no UDF.

A null text gives null (or an empty array where the result is a list); nothing here raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of links, anchors and references.
WIKILINK = r"\[\[([^\]]+)\]\]"
TYPED_WIKILINK = r"\[\[([^\]]+)\]\](?:\{([a-z0-9_]+)\})?"
SOURCE_ANCHOR = r"\[src:([^\]]+)\]"
EXACT_REFERENCE = r"https?://[^\s<>\"']+|[A-Za-z0-9][A-Za-z0-9_.:/?&=%+-]{31,}"
URL = r"https?://[^\s<>\"'\)\]]+"
COMMENT = r"(?s)<!--.*?-->"
FRONTMATTER = r"(?s)\A---.*?---"
FENCED, INLINE_CODE, MARKDOWN_LINK = r"(?s)```.*?```", r"`[^`\n]*`", r"\[[^\]]*\]\([^)]*\)"


def tokens(text: Column) -> Column:
    """Search tokens: camelCase split, lower case, runs of a-z0-9 of at least two characters."""
    parted = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(parted, "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def slugify(text: Column) -> Column:
    """Lower case, word characters and hyphens only, blanks and underscores as single hyphens."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def chunk_id(source: Column, section: Column) -> Column:
    """``source#section`` with the section in a-z0-9 and hyphens, 'section' if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(section), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(source, F.lit("#"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("section")))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] in order, repeats kept, comments skipped."""
    return F.coalesce(F.regexp_extract_all(without_comments(text), F.lit(WIKILINK), F.lit(1)), F.array().cast("array<string>"))


def typed_wikilinks(text: Column) -> Column:
    """Array of (target, relation); a plain link has a null relation."""
    clean = without_comments(text)
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(TYPED_WIKILINK), F.lit(1)), F.regexp_extract_all(clean, F.lit(TYPED_WIKILINK), F.lit(2)))
    return F.transform(pairs, lambda p: F.struct(p["0"].alias("target"), F.nullif(p["1"], F.lit("")).alias("relation")))


def source_anchors(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(SOURCE_ANCHOR), F.lit(1)), F.array().cast("array<string>"))


def exact_references(text: Column) -> Column:
    """URLs and long identifiers, first occurrences in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EXACT_REFERENCE), F.lit(0)))


def urls(text: Column) -> Column:
    """URLs without trailing punctuation, first occurrences in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)


def normal_path(path: Column) -> Column:
    """Forward slashes, no trailing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""))


def short_id(value: Column) -> Column:
    """The last path part, at most 12 characters."""
    return F.substring(F.element_at(F.split(F.regexp_replace(value, r"[\\/]+$", ""), r"[\\/]"), -1), 1, 12)


def archive_stem(session: Column) -> Column:
    """A safe id as it is; others as 40 readable characters and 20 of their hash."""
    readable = F.regexp_replace(F.substring(F.regexp_replace(session, "[^A-Za-z0-9._-]+", "-"), 1, 40), "^[.-]+|[.-]+$", "")
    hashed = F.concat(F.coalesce(F.nullif(readable, F.lit("")), F.lit("session")), F.lit("-"), F.substring(F.sha2(session, 256), 1, 20))
    return F.when(session.rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), session).otherwise(hashed)


def frontmatter(text: Column) -> Column:
    """The block between the first --- at the very start and the next ---, else ''."""
    return F.regexp_extract(text, r"(?s)\A---(.*?)---", 1)


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def field(block: Column, key: str) -> Column:
    """The value of a ``key: value`` line of a frontmatter block, unquoted; null if absent."""
    value = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def source_count(block: Column) -> Column:
    """How many list items the block holds, of whatever key."""
    return F.size(F.filter(F.split(block, "\n"), lambda x: F.ltrim(x).startswith("- ")))


def truth_section(text: Column) -> Column:
    """What stands under ``## Truth`` up to a rule or ``## Timeline``; '' if there is none."""
    rest = F.regexp_extract(text, r"(?ms)^## Truth[ \t]*\n(.*)\z", 1)
    return F.regexp_replace(F.regexp_replace(rest, r"(?ms)^(?:---|## Timeline)[ \t]*$.*\z", ""), r"\A\s+|\s+\z", "")


def zone(truth: Column, name: str) -> Column:
    """The ``### name`` part of a truth section, up to the next ###."""
    rest = F.regexp_extract(truth, rf"(?ms)^### {name}[ \t]*\n(.*)\z", 1)
    return F.regexp_replace(F.regexp_replace(rest, r"(?ms)^###\s.*\z", ""), r"\A\s+|\s+\z", "")


def zones(text: Column) -> Column:
    """(observed, synthesized); a truth section without subsections is all observed."""
    truth = truth_section(text)
    plain = ~truth.rlike(r"(?m)^### (?:Observed|Synthesized)[ \t]*$")
    return F.struct(F.when(plain, truth).otherwise(zone(truth, "Observed")).alias("observed"), F.when(plain, "").otherwise(zone(truth, "Synthesized")).alias("synthesized"))


def section(body: Column, heading: str) -> Column:
    """Text under a ## or ### heading up to the next of the same or a higher level; null if absent or blank."""
    out = F.lit(None).cast("string")
    for level in (3, 2):
        rest = F.regexp_extract(body, rf"(?ms)^#{{{level}}}[ \t]+{heading}[ \t]*\n(.*)\z", 1)
        text = F.regexp_replace(F.regexp_replace(rest, rf"(?ms)^#{{1,{level}}}[ \t]+\S.*\z", ""), r"\A\s+|\s+\z", "")
        out = F.coalesce(F.nullif(text, F.lit("")), out)
    return out


def fallback_truth(text: Column) -> Column:
    """Intro, key points or the first 200 words of the details, and related concepts of an older article."""
    body = without_frontmatter(text)
    intro = F.regexp_replace(F.regexp_replace(body, r"(?ms)^## .*\z", ""), r"\A\s*# [^\n]*(?:\n|\z)", "")
    intro = F.nullif(F.regexp_replace(intro, r"\A\s+|\s+\z", ""), F.lit(""))
    words = F.split(F.coalesce(section(body, "Details"), section(body, "Evidence")), r"\s+")
    details = F.concat(F.lit("### Details (excerpt)\n\n"), F.array_join(F.slice(words, 1, 200), " "), F.when(F.size(words) > 200, "...").otherwise(""))
    points = F.concat(F.lit("### Key Points\n\n"), F.coalesce(section(body, "Key Points"), section(body, "Key Insight")))
    related = F.concat(F.lit("### Related Concepts\n\n"), section(body, "Related Concepts"))
    return F.concat_ws("\n\n", F.coalesce(intro, section(body, "The Connection")), F.coalesce(points, details), related)


def excerpt(text: Column, slug: Column, cap: int) -> Column:
    """``text`` cut to ``cap`` characters at a paragraph, line or word break past the half, with a pointer.

    A code fence that the cut leaves open is closed.
    """
    head = F.substring(text, 1, cap)

    def before(mark: str) -> Column:
        kept = F.length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 1
        return F.when((F.locate(mark[::-1], F.reverse(head)) > 0) & (kept >= cap // 2), F.substring(head, F.lit(1), kept.cast("int")))

    cut = F.regexp_replace(F.coalesce(before("\n\n"), before("\n"), before(" "), head), r"\s+\z", "")
    fences = F.size(F.split(cut, "```")) - 1
    closed = F.concat(cut, F.when(fences % 2 == 1, "\n```").otherwise(""), F.lit("\n\n(excerpt of "), slug, F.lit(")"))
    return F.when(F.length(text) <= cap, text).otherwise(closed)


def snippet(text: Column, width: int) -> Column:
    """At most ``width`` characters on one line, marked where cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit("…")))


#: The metadata that a slim hit keeps.
SLIM_METADATA = ("type", "confidence", "quarantined", "updated", "zone")


def slim_hit(text: Column, title: Column, slug: Column, metadata: Column) -> Column:
    """A hit as readers get it: a snippet of 220 characters, the slug where there is no title, and a few of the metadata (a map)."""
    kept = F.map_filter(metadata, lambda k, v: k.isin(*SLIM_METADATA) & v.isNotNull())
    return F.struct(slug.alias("slug"), F.coalesce(F.nullif(F.trim(title), F.lit("")), slug).alias("title"), snippet(text, 220).alias("snippet"), kept.alias("metadata"))


def match_context(text: Column, query: str, around: int = 80) -> Column:
    """The text ``around`` characters before and after the first place of the query; null without one."""
    at = F.locate(query, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start.cast("int"), (at - start + len(query) + around).cast("int")))


def word_count(text: Column) -> Column:
    """Words by white space, without frontmatter."""
    body = F.regexp_replace(without_frontmatter(text), r"\A\s+|\s+\z", "")
    return F.when(F.length(body) == 0, 0).otherwise(F.size(F.split(body, r"\s+")))


def prose_only(text: Column) -> Column:
    """The text with frontmatter, code and links blanked to single spaces; enough to tell whether a name occurs."""
    out = text
    for pattern in (FRONTMATTER, FENCED, r"\[\[[^\]]*\]\]", MARKDOWN_LINK, INLINE_CODE):
        out = F.regexp_replace(out, pattern, " ")
    return out


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cypher_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))


def mermaid_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))


def clip(text: Column, width: int, mark: str = "…") -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width), F.lit(mark)))


def unfenced_json(text: Column) -> Column:
    """What stands inside a json code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), F.trim(text))
