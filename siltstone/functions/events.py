"""Projections of tool events and prompts as Column expressions; null input gives null or an empty list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a tool's input that its digest keeps.
DIGEST_FIELDS = {
    "Read": ("file_path", "offset", "limit"), "Write": ("file_path",), "Edit": ("file_path",), "MultiEdit": ("file_path",), "Bash": ("command", "description"),
    "Grep": ("pattern", "path", "glob"), "Glob": ("pattern", "path"), "WebFetch": ("url",), "WebSearch": ("query",), "Task": ("description", "subagent_type"),
}
DIGEST_WIDTH = 240


def input_digest(tool: Column, input_json: Column) -> Column:
    """Map of the kept fields of a tool's input, each clipped; a shell command keeps its first line.

    Unknown tools keep their flat fields only.
    """
    v = F.try_parse_json(input_json)
    value = lambda name: F.substring(F.substring_index(F.try_variant_get(v, f"$.{name}", "string"), "\n", 1), 1, DIGEST_WIDTH)
    out = None
    for name, fields in DIGEST_FIELDS.items():
        kept = F.map_from_entries(F.array_compact(F.array(*[F.when(value(f).isNotNull(), F.struct(F.lit(f), value(f))) for f in fields])))
        out = F.when(tool == name, kept) if out is None else out.when(tool == name, kept)
    flat = F.map_filter(F.from_json(input_json, "map<string,string>"), lambda k, x: x.isNotNull() & ~x.rlike(r"^\s*[\[{]"))
    return out.otherwise(F.transform_values(flat, lambda k, x: F.substring(x, 1, DIGEST_WIDTH)))


def event_label(tool: Column, digest: Column) -> Column:
    """One line for an event: the tool and what it touched."""
    what = F.coalesce(*[F.try_element_at(digest, F.lit(k)) for k in ("file_path", "command", "pattern", "url", "query", "description")])
    return F.when(what.isNull(), tool).otherwise(F.concat(tool, F.lit(": "), what))


def response_size(response: Column) -> Column:
    return F.coalesce(F.length(response), F.lit(0))


def response_ok(response: Column) -> Column:
    """False if the response says that it is an error."""
    return ~F.coalesce(F.try_variant_get(F.try_parse_json(response), "$.is_error", "boolean"), F.lit(False))


def prompt_paths(prompt: Column, cap: int = 3) -> Column:
    """The first paths of files named in a prompt."""
    return F.slice(F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z]{1,5}"), F.lit(0))), 1, cap)


def prompt_classes(prompt: Column, cap: int = 3) -> Column:
    """The first names in CamelCase of a prompt."""
    return F.slice(F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"), F.lit(0))), 1, cap)


#: The tags of comments that give reasons.
RATIONALE_TAGS = ("WHY", "HACK", "NOTE", "TODO", "FIXME", "XXX", "BUG", "WARNING", "OPTIMIZE", "DEPRECATED")


def rationale(text: Column) -> Column:
    """Array of (tag, text), one per commented line with a tag: upper-case tags anywhere in it, and @deprecated in any case first."""
    comments = F.filter(F.regexp_extract_all(text, F.lit(r"(?m)(?:^[ \t]*\*|//|/\*|(?:^|[ \t])#(?![\[\w]))([^\n]*)"), F.lit(1)), lambda line: F.trim(line) != "")
    bare = rf"\b({'|'.join(RATIONALE_TAGS)})\b(.*)"

    def tagged(line: Column) -> Column:
        old = line.rlike(r"(?i)@deprecated\b")
        tag = F.when(old, "DEPRECATED").otherwise(F.nullif(F.regexp_extract(line, bare, 1), F.lit("")))
        rest = F.when(old, F.regexp_extract(line, r"(?i)@deprecated\b(.*)", 1)).otherwise(F.regexp_extract(line, bare, 2))
        rest = F.regexp_replace(F.regexp_replace(rest, r"\*/\s*$", ""), r"^[ :\t-]+|\s+$", "")
        return F.struct(tag.alias("tag"), F.substring(rest, 1, 240).alias("text"))

    return F.filter(F.transform(comments, tagged), lambda r: r["tag"].isNotNull())


def open_work(text: Column, heading: str = "Open Questions") -> Column:
    """What stands under the heading, null if absent or only a marker of nothing."""
    rest = F.regexp_replace(F.regexp_extract(text, rf"(?ms)^##+ {heading}[^\n]*\n(.*)\z", 1), r"(?ms)^##+ .*\z", "")
    body = F.regexp_replace(rest, r"\A\s+|\s+\z", "")
    return F.when(F.lower(body).isin("", "none", "- none", "n/a", "-", "(none)"), F.lit(None)).otherwise(body)


def validated_list(reply: Column, cap: int = 10, width: int = 500) -> Column:
    """The strings of a JSON list in a reply, fenced or not: at most ``cap``, each clipped, blanks dropped."""
    from siltstone.functions.text import unfenced_json

    items = F.try_variant_get(F.try_parse_json(unfenced_json(reply)), "$", "array<string>")
    kept = F.filter(F.transform(items, lambda x: F.substring(F.trim(x), 1, width)), lambda x: F.length(x) > 0)
    return F.slice(F.coalesce(kept, F.array().cast("array<string>")), 1, cap)
