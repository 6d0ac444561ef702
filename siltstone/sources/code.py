"""Source-code scanners: one file in, rows of symbols, edges, routes, templates or chunks out.

Regular structure is read with Column expressions; what depends on nesting (methods of a
class, chunks of declarations) goes through one Arrow pass per file with a small brace
scanner.  Null and empty files give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.events import RATIONALE_TAGS

PHP_SYMBOL = r"\b(?:class|interface|trait|enum|function)\s+([A-Za-z_]\w*)"
#: Kinds of files by their path, first match wins.
PATH_KINDS = (
    ("MessageHandler", "handler"), ("Message", "message"), ("Controller", "controller"), ("Service", "service"), ("Entity", "entity"), ("Repository", "repository"),
    ("Command", "command"), ("EventSubscriber", "subscriber"), ("Form", "form"), ("Validator", "validator"), ("Enum", "enum"), ("DTO", "dto"),
    ("Security", "security"), ("Twig", "twig_extension"), ("DataFixtures", "fixture"), ("Exception", "exception"),
)


def _all(pattern: str, group: int = 1, text: str = "text") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))


def php_nodes(files: DataFrame) -> DataFrame:
    """(path, namespace, class, type, imports) of PHP files (path, text)."""
    ns = F.nullif(F.regexp_extract("text", r"(?m)^namespace\s+([\w\\]+)\s*;", 1), F.lit(""))
    cls = F.nullif(F.regexp_extract("text", r"(?m)^(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(\w+)", 1), F.lit(""))
    kind = None
    for part, name in PATH_KINDS:
        here = F.replace("path", F.lit("\\"), F.lit("/")).contains(f"/{part}/")
        kind = F.when(here, name) if kind is None else kind.when(here, name)
    return files.where("text is not null").select("path", ns.alias("namespace"), cls.alias("class"), kind.otherwise("other").alias("type"), F.array_distinct(_all(r"(?m)^use\s+([\w\\]+)(?:\s+as\s+\w+)?\s*;")).alias("imports"))


def php_edges(nodes: DataFrame, prefix: str = "App", root: str = "src") -> DataFrame:
    """(src, dst): files that import another file of the tree, by the path the class name implies."""
    name = F.explode("imports")
    dst = F.concat(F.lit(root + "/"), F.replace(F.substring_index("import", prefix + "\\", -1), F.lit("\\"), F.lit("/")), F.lit(".php"))
    e = nodes.select(F.col("path").alias("src"), name.alias("import")).where(F.col("import").startswith(prefix + "\\")).select("src", dst.alias("dst"))
    return e.join(nodes.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def twig_templates(files: DataFrame) -> DataFrame:
    """(path, extends, includes, controllers) of Twig files."""
    includes = F.array_distinct(F.concat(_all(r"\{%-?\s*(?:include|embed|import|from)\s+['\"]([^'\"]+)['\"]"), _all(r"include\(\s*['\"]([^'\"]+)['\"]")))
    extends = F.nullif(F.regexp_extract("text", r"\{%-?\s*extends\s+['\"]([^'\"]+)['\"]", 1), F.lit(""))
    used = F.array_distinct(F.concat(_all(r"stimulus_controller\(\s*['\"]([^'\"]+)['\"]"), F.flatten(F.transform(_all(r"data-controller=['\"]([^'\"]+)['\"]"), lambda x: F.split(F.trim(x), r"\s+")))))
    return files.where("text is not null").select("path", extends.alias("extends"), includes.alias("includes"), used.alias("controllers"))


def included_by(templates: DataFrame) -> DataFrame:
    """(path, n_users): how many templates extend or include each one."""
    used = templates.select("path", F.explode(F.array_union("includes", F.array_compact(F.array("extends")))).alias("used"))
    return used.groupBy(F.col("used").alias("path")).agg(F.countDistinct("path").alias("n_users"))


def stimulus_controllers(scripts: DataFrame, templates: DataFrame) -> DataFrame:
    """(name, file, used_in, state, values, targets, outlets): used, orphan (in no template) or missing (no file)."""
    name = F.replace(F.replace(F.regexp_extract("path", r"controllers/(.+?)_controller\.[jt]s$", 1), F.lit("/"), F.lit("--")), F.lit("_"), F.lit("-"))
    inside = lambda kind, ends: F.regexp_extract(F.coalesce("text", F.lit("")), rf"static\s+{kind}\s*=\s*{ends[0]}([^{ends[1]}]*){ends[1]}", 1)
    keys = F.array_distinct(F.regexp_extract_all(inside("values", ("\\{", "\\}")), F.lit(r"(\w+)\s*:"), F.lit(1)))
    quoted = lambda kind: F.array_distinct(F.regexp_extract_all(inside(kind, ("\\[", "\\]")), F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1)))
    have = scripts.select(name.alias("name"), F.col("path").alias("file"), keys.alias("values"), quoted("targets").alias("targets"), quoted("outlets").alias("outlets")).where("name <> ''")
    use = templates.select("path", F.explode("controllers").alias("name")).groupBy("name").agg(F.countDistinct("path").alias("used_in"))
    state = F.when(F.col("file").isNull(), "missing").when(F.col("used_in").isNull(), "orphan").otherwise("used")
    return have.join(use, "name", "full_outer").select("name", "file", F.coalesce("used_in", F.lit(0)).alias("used_in"), state.alias("state"), "values", "targets", "outlets")


def js_symbols(scripts: DataFrame) -> DataFrame:
    """(symbol, path) of the functions and methods of JS files, named ``js:path::name``."""
    pattern = r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:static\s+)?(?:async\s+)?(?:function\s+)?(?!(?:if|for|while|switch|catch|return|function)\b)(\w+)\s*\([^)\n]*\)\s*\{"
    each = scripts.where("text is not null").select("path", F.explode(F.array_distinct(_all(pattern))).alias("name"))
    return each.select(F.concat(F.lit("js:"), "path", F.lit("::"), "name").alias("symbol"), "path")


def fetches(scripts: DataFrame) -> DataFrame:
    """(src, method, url) of fetch calls of JS files; template parts of a URL become *."""
    call = r"fetch\(\s*[`'\"]([^`'\"]+)[`'\"](?:\s*,\s*\{[^}]*?method\s*:\s*['\"](\w+)['\"])?"
    z = F.arrays_zip(_all(call, 1), _all(call, 2))
    e = scripts.where("text is not null").select(F.concat(F.lit("js:"), "path").alias("src"), F.explode(z).alias("c"))
    return e.select("src", F.upper(F.coalesce(F.nullif(F.col("c.1"), F.lit("")), F.lit("GET"))).alias("method"), F.regexp_replace(F.regexp_replace("c.0", r"\$\{[^}]*\}", "*"), r"\?.*$", "").alias("url"))


def match_fetches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``calls`` with the action of the first route (by path, file) that their method and URL name, else null."""
    r = routes.select(F.regexp_replace("path", r"\{[^}]*\}", "*").alias("url"), F.explode("methods").alias("method"), F.struct("path", "file", "action").alias("r"))
    first = r.groupBy("url", "method").agg(F.min("r").alias("r"))
    return calls.join(first, ["url", "method"], "left").select("src", "method", "url", F.col("r.action").alias("action"))


# --- nesting -------------------------------------------------------------------------------

_DECL = re.compile(r"^[ \t]*(?:(?:abstract|final|readonly|export|default|async)\s+)*(class|interface|trait|enum|function)\s+(\w+)", re.M)
_METHOD = re.compile(r"^[ \t]*(?:(?:public|protected|private|static|abstract|final)\s+)+function\s+(\w+)", re.M)
_TAG = re.compile(rf"\b({'|'.join(RATIONALE_TAGS)})\b(.*)")
_DEPRECATED = re.compile(r"@deprecated\b(.*)", re.I)
_ATTRIBUTE = re.compile(r"#\[Route\(\s*['\"]([^'\"]*)['\"](.*?)\)\]", re.S)
_BLANKED = re.compile(r"/\*.*?\*/|//[^\n]*|#(?!\[)[^\n]*|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", re.S)


def blanked(code: str) -> str:
    """The code with comments and strings blanked, at the same length."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)


def _block_end(code: str, at: int) -> int:
    """Where the braces that open at or after ``at`` close; a body-less declaration ends at its semicolon."""
    opened = code.find("{", at)
    semicolon = code.find(";", at)
    if opened < 0 or 0 <= semicolon < opened:
        return semicolon + 1 if semicolon >= 0 else len(code)
    depth = 0
    for i in range(opened, len(code)):
        if code[i] == "{":
            depth += 1
        elif code[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
    return len(code)


def parse_php(path: str, text: str) -> dict[str, list[tuple]]:
    """Symbols, call edges, classes, routes and rationale of one file."""
    code = blanked(text)
    line = lambda at: text.count("\n", 0, at) + 1
    ns = re.search(r"^namespace\s+([\w\\]+)", code, re.M)
    prefix = ns.group(1) + "\\" if ns else ""
    uses = {m.group(2) or m.group(1).rsplit("\\", 1)[-1]: m.group(1) for m in re.finditer(r"^use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", code, re.M)}
    full = lambda name: name.lstrip("\\") if name.startswith("\\") else uses.get(name, prefix + name)
    out: dict[str, list[tuple]] = {"symbol": [], "edge": [], "class": [], "route": [], "rationale": []}
    for c in re.finditer(r"^(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(\w+)(?:[^{]*?\bextends\s+([\w\\]+))?", code, re.M):
        name, end = full("\\" + prefix + c.group(1)), _block_end(code, c.end())
        out["class"].append((name, full(c.group(2)) if c.group(2) else None, line(c.start()), line(end - 1)))
        # the attributes before the class, as far as the declaration or block before it
        head = text[max(code.rfind(";", 0, c.start()), code.rfind("}", 0, c.start())) + 1 : c.start()]
        base = (m := list(_ATTRIBUTE.finditer(head))) and m[-1].group(1) or ""
        types = {m.group(2): full(m.group(1)) for m in re.finditer(r"([A-Z\\][\w\\]*)\s+\$(\w+)", code[c.start() : end])}
        for f in _METHOD.finditer(code, c.end(), end):
            stop = _block_end(code, f.end())
            symbol = f"{name}::{f.group(1)}"
            visibility = next((v for v in ("private", "protected") if v in f.group(0)), "public")
            out["symbol"].append((symbol, line(f.start(1)), line(stop - 1), "method", visibility))
            body, raw = code[f.end() : stop], text[f.end() : stop]
            for m in re.finditer(r"\$this->(?:(\w+)->)?(\w+)\s*\(", body):
                target = (types.get(m.group(1)), m.group(2)) if m.group(1) else (name, m.group(2))
                if m.group(2) == "render" and not m.group(1):
                    if t := re.match(r"\s*['\"]([^'\"]+)['\"]", raw[m.end() :]):
                        out["edge"].append((symbol, f"template:{t.group(1)}", "render", 1.0, line(f.end() + m.start())))
                elif target[0]:
                    out["edge"].append((symbol, f"{target[0]}::{target[1]}", "call", 1.0, line(f.end() + m.start())))
            for m in re.finditer(r"(?<![\w$>\\])(self|static|parent|[A-Z\\][\w\\]*)::(\w+)\s*\(", body):
                parent = full(c.group(2)) if c.group(2) else name
                owner = name if m.group(1) in ("self", "static") else parent if m.group(1) == "parent" else full(m.group(1))
                out["edge"].append((symbol, f"{owner}::{m.group(2)}", "call", 1.0, line(f.end() + m.start())))
            for m in re.finditer(r"(?<!this)(?<!\w)\$(\w+)->(\w+)\s*\(", body):
                if m.group(1) != "this" and m.group(1) in types:
                    out["edge"].append((symbol, f"{types[m.group(1)]}::{m.group(2)}", "call", 0.7, line(f.end() + m.start())))
            # the attributes before the method, as far as the member before it
            begin = max(c.end(), code.rfind(";", 0, f.start()) + 1, code.rfind("}", 0, f.start()) + 1)
            attributes = list(_ATTRIBUTE.finditer(text[begin : f.start()]))
            for m in attributes:
                methods = re.findall(r"['\"](GET|POST|PUT|PATCH|DELETE)['\"]", m.group(2)) or ["GET"]
                template = re.search(r"render\(\s*['\"]([^'\"]+)['\"]", raw[:4096])
                named = re.search(r"name:\s*['\"]([^'\"]+)['\"]", m.group(2))
                out["route"].append(((base.rstrip("/") + "/" + m.group(1).lstrip("/")).rstrip("/") or "/", named.group(1) if named else None, ",".join(methods), symbol, template.group(1) if template else None))
    for i, raw_line in enumerate(text.splitlines(), 1):
        if not (comment := re.search(r"(?://|#(?!\[)|/\*|^\s*\*)(.*)$", raw_line)):
            continue
        if m := _DEPRECATED.search(comment.group(1)) or _TAG.search(comment.group(1)):
            tag, rest = (m.group(1), m.group(2)) if m.re is _TAG else ("DEPRECATED", m.group(1))
            out["rationale"].append((tag, re.sub(r"\*/\s*$", "", rest).lstrip(" :\t-").strip()[:240], i))
    return out


#: All kinds of facts.
FACT_KINDS = ("symbol", "edge", "class", "route", "rationale")
_CODE = "path string, kind string, a string, b string, c string, d string, first_line int, last_line int, confidence double"


def php_facts(files: DataFrame) -> DataFrame:
    """All facts of PHP files in one table: kind is symbol, edge, class, route or rationale.

    symbol: a id, b kind, c visibility; edge: a from, b to, c kind; class: a name, b parent;
    route: a path, b action, c methods, d template; rationale: a tag, b text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = parse_php(path, text)
                rows += [(path, "symbol", s, k, v, None, a, b, None) for s, a, b, k, v in f["symbol"]]
                rows += [(path, "edge", s, t, k, None, at, at, sure) for s, t, k, sure, at in f["edge"]]
                rows += [(path, "class", n, p, None, None, a, b, None) for n, p, a, b in f["class"]]
                rows += [(path, "route", p, action, methods, template, None, None, None) for p, _, methods, action, template in f["route"]]
                rows += [(path, "rationale", tag, t, None, None, at, at, None) for tag, t, at in f["rationale"]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = (pa.string(),) * 6 + (pa.int32(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "kind", "a", "b", "c", "d", "first_line", "last_line", "confidence"])

    return files.where("text is not null").select("path", "text").mapInArrow(scan, _CODE)


def assign_rationale(rationale: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, symbol): the smallest span that holds the comment, else one that starts 1-3 lines below; else dropped.

    Both meet per file; files are small against the table.
    """
    from pyspark.sql import Window

    j = rationale.select("path", F.col("first_line").alias("line")).join(symbols.select("path", F.col("a").alias("symbol"), "first_line", "last_line"), "path")
    inside = F.col("line").between(F.col("first_line"), F.col("last_line"))
    below = (F.col("first_line") - F.col("line")).between(1, 3)
    w = Window.partitionBy("path", "line").orderBy(F.when(inside, 0).otherwise(1), F.col("last_line") - F.col("first_line"), "first_line", "symbol")
    return j.where(inside | below).withColumn("n", F.row_number().over(w)).where("n = 1").select("path", "line", "symbol")


def code_chunks(text: str, most: int = 400, window: int = 150, overlap: int = 30, least: int = 5) -> list[tuple[int, int]]:
    """(first, last) lines of chunks: top-level declarations with what stands before them; large ones by methods.

    A part above ``window`` lines without declarations is cut into windows; chunks under
    ``least`` lines join the one before (the first joins the next).
    """
    code = blanked(text)
    total = text.count("\n") + 1
    line = lambda at: text.count("\n", 0, at) + 1

    def windows(a: int, b: int) -> list[tuple[int, int]]:
        out, at = [], a
        while True:
            out.append((at, min(at + window - 1, b)))
            if at + window - 1 >= b:
                return out
            at += window - overlap

    def tile(a: int, b: int, spans: list[tuple[int, int]], inner) -> list[tuple[int, int]]:  # noqa: ANN001
        out, at = [], a
        for s, e in spans:
            if s > at:
                out += [(at, s - 1)] if s - at <= most else windows(at, s - 1)
            out += inner(max(s, at), e)
            at = e + 1
        if at <= b:
            out += [(at, b)] if b - at < most else windows(at, b)
        return out

    def top(limit_from: int, pattern: re.Pattern, lo: int, hi: int) -> list[tuple[int, int]]:
        spans, at = [], lo
        for m in pattern.finditer(code, lo, hi):
            if m.start() < at:
                continue
            end = _block_end(code, m.end())
            spans.append((line(m.start() + len(m.group()) - len(m.group().lstrip())), line(end - 1)))
            at = end
        return spans

    offsets = [0] + [m.end() for m in re.finditer("\n", text)] + [len(text) + 1]

    def declaration(s: int, e: int) -> list[tuple[int, int]]:
        if e - s + 1 <= most:
            return [(s, e)]
        methods = top(s, _METHOD, offsets[s - 1] + 1, offsets[e])
        return tile(s, e, methods, lambda a, b: [(a, b)] if b - a + 1 <= most else windows(a, b)) if methods else windows(s, e)

    spans = top(1, _DECL, 0, len(code))
    chunks = tile(1, total, spans, declaration) if spans else windows(1, total)
    merged: list[tuple[int, int]] = []
    for c in chunks:
        if merged and (c[1] - c[0] + 1 < least or merged[-1][1] - merged[-1][0] + 1 < least and len(merged) == 1) and c[0] == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], c[1])
        else:
            merged.append(c)
    return merged


def chunk_files(files: DataFrame) -> DataFrame:
    """(path, chunk_no, first_line, last_line, symbols, chunk) of code files (path, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.split("\n")
                for i, (a, b) in enumerate(code_chunks(text)):
                    chunk = "\n".join(lines[a - 1 : b])
                    rows.append((path, i, a, b, re.findall(PHP_SYMBOL, chunk), chunk))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "chunk_no", "first_line", "last_line", "symbols", "chunk"])

    return files.where("text <> ''").select("path", "text").mapInArrow(scan, "path string, chunk_no int, first_line int, last_line int, symbols array<string>, chunk string")
