"""Queries over a code base and its history.

The driver has no source files, so their texts are written from its tables: every part is
a class that calls two others (a tree), every supplier a controller with a route that
enters the tree, every nation a template and a script, every order a commit over the
files of its parts.  The readers then see nothing but these texts, and the SQL works
from the tables, so each query checks a reader and an operator end to end, at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import codegraph
from siltstone.session import held, materialize, spread, table
from siltstone.sources import code, files

TODAY = "2001-08-02"


def _folder(p: str) -> str:
    return f"element_at(array('Service', 'Repository', 'Message', 'Entity'), cast({p} % 4 + 1 as int))"


def _class(p: str) -> str:
    return f"concat('App\\\\', {_folder(p)}, '\\\\P', {p})"


#: The lines of a part's file; ``n`` is the number of parts.
_PART_LINES = [
    "'<?php'",
    f"concat('namespace App\\\\', {_folder('p')}, ';')",
    f"if(2 * p <= n, concat('use ', {_class('2 * p')}, ';'), '')",
    f"if(2 * p + 1 <= n, concat('use ', {_class('(2 * p + 1)')}, ';'), '')",
    "''",
    f"concat('class P', p, if(p % 3 = 0, concat(' extends \\\\', {_class('(p - 1)')}), ''))",
    "'{'",
    "concat('    public function __construct(', concat_ws(', ', if(2 * p <= n, concat('private P', 2 * p, ' $left'), null), if(2 * p + 1 <= n, concat('private P', 2 * p + 1, ' $right'), null)), ') {}')",
    "''",
    "case when p % 5 = 0 then concat('    // TODO: tidy P', p) when p % 7 = 0 then '    /** Old. @Deprecated use P1 */' else '' end",
    "'    public function run()'",
    "'    {'",
    "if(2 * p <= n, '        $this->left->run();', '')",
    "if(2 * p + 1 <= n, '        $this->right->run();', '')",
    "'        $this->getName();'",
    "'    }'",
    "''",
    "'    public function getName()'",
    "'    {'",
    "if(p % 4 = 3, '        return $this->name;', '        return self::make();')",
    "'    }'",
    "''",
    "if(p % 6 = 0, '    private static function tidy()', '    private static function make()')",
    "'    {'",
    "'        return 1;'",
    "'    }'",
    "'}'",
]
_CONTROLLER_LINES = [
    "'<?php'",
    "'namespace App\\\\Controller;'",
    f"concat('use ', {_class('s')}, ';')",
    "''",
    "concat('#[Route(\\'/n', k, '\\')]')",
    "concat('class S', s, 'Controller')",
    "'{'",
    "concat('    public function __construct(private P', s, ' $entry) {}')",
    "''",
    "if(s % 2 = 0, concat('    #[Route(\\'/s', s, '/{id}\\', name: \\'s', s, '\\', methods: [\\'GET\\', \\'POST\\'])]'), concat('    #[Route(\\'/s', s, '\\')]'))",
    "'    public function show()'",
    "'    {'",
    "'        $this->entry->run();'",
    "concat('        return $this->render(\\'s/', k, '.html.twig\\');')",
    "'    }'",
    "'}'",
]


def _text(lines: list[str]) -> str:
    return f"concat_ws('\\n', {', '.join(lines)})"


def php_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the classes and controllers."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("p"))  # keys count from 0
    n = p.agg(F.max("p")).first()[0] or 0  # one number
    parts = spread(p).withColumn("n", F.lit(n)).select(F.expr(f"concat('src/', {_folder('p')}, '/P', p, '.php')").alias("path"), F.expr(_text(_PART_LINES)).alias("text"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("s"), F.col("s_nationkey").alias("k"))
    return parts.unionByName(s.select(F.expr("concat('src/Controller/S', s, 'Controller.php')").alias("path"), F.expr(_text(_CONTROLLER_LINES)).alias("text")))


def twig_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the templates."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    text = "concat('{% extends \\'r/', n_regionkey, '.html.twig\\' %}\\n{% include \\'menu.html.twig\\' %}\\n<div data-controller=\"c', n_nationkey, ' shared\">{{ stimulus_controller(\\'r', n_regionkey, '\\') }}</div>')"
    one = n.select(F.expr("concat('templates/s/', n_nationkey, '.html.twig')").alias("path"), F.expr(text).alias("text"))
    return one.unionByName(r.select(F.expr("concat('templates/r/', r_regionkey, '.html.twig')").alias("path"), F.expr("concat('<p>', r_regionkey, '</p>')").alias("text")))


def js_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the scripts."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    s = table(spark, sf_dir, "supplier").withColumn("s_suppkey", F.col("s_suppkey") + 1)
    body = lambda call: f"concat('export default class extends Controller {{\\n  static values = {{ url: String, n: Number }}\\n  static targets = [\\'list\\', \"row\"]\\n\\n  async load() {{\\n    ', {call}, '\\n  }}\\n}}\\n')"
    one = n.select(F.expr("concat('assets/controllers/c', n_nationkey, '_controller.js')").alias("path"), F.expr(body("concat('fetch(\\'/n', n_nationkey, '/none?x=1\\')')")).alias("text"))
    call = "if(s_suppkey % 2 = 0, concat('fetch(`/n', s_nationkey, '/s', s_suppkey, '/$', '{this.id}`, { method: \\'POST\\' })'), concat('fetch(\\'/n', s_nationkey, '/s', s_suppkey, '\\')'))"
    return one.unionByName(s.select(F.expr("concat('assets/controllers/s', s_suppkey, '_controller.js')").alias("path"), F.expr(body(call)).alias("text")))


#: What commits say, by the last digit of the order.
MESSAGES = ("Extract the parser", "Migrate to the new store", "Replace the lock", "Remove old code", "Rewrite the index", "Introduce a cache", "add a new module for search", "Bump version", "chore: extract tests", "Fix a typo")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_no, value): the history as numbered lines of ``git log --numstat``, one file per commit."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumn("l_partkey", F.col("l_partkey") + 1)
    # keyed by the path of the log from the start, so that the lines stay where its header is carried to them; they become text there
    log = lambda key: F.concat(F.lit("log/"), key).alias("path")
    f = li.select(log("l_orderkey"), F.col("l_quantity").cast("int").alias("n"), F.col("l_partkey").alias("p")).repartition("path")
    line = f"concat(x.n, '\\t1\\tsrc/', {_folder('x.p')}, '/P', x.p, '.php')"
    changed = f.groupBy("path").agg(F.expr(f"array_sort(array_compact(transform(collect_list(struct(n, p)), x -> {line})))").alias("lines"))  # the lines of one order
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    head = F.concat_ws("\t", F.lit("commit"), F.concat(F.lit("c"), "o_orderkey"), F.concat(F.lit("a"), "o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), message)
    whole = o.select(log("o_orderkey"), head.alias("head")).join(changed.hint("merge"), "path").select("path", F.concat(F.array("head"), "lines").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("line_no", "value"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.git_log(log_lines(spark, sf_dir))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff that touches the body of ``run`` in every fiftieth part and deletes a line between methods in others."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("p")).where("p % 50 in (0, 1)")
    hunk = "array(concat('+++ b/src/', {f}, '/P', p, '.php'), if(p % 50 = 0, '@@ -13 +13 @@ class', '@@ -17,2 +17,0 @@'), concat('+++ b/docs/p', p, '.md'), '@@ -1,3 +1,9 @@')".format(f=_folder("p"))
    return p.select(F.concat(F.lit("diff/"), "p").alias("path"), F.posexplode(F.expr(hunk)).alias("line_no", "value"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.php_facts(php_files(spark, sf_dir))


def _held_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(_facts(spark, sf_dir), "kind", code.FACT_KINDS)


_INT = lambda c: F.col(c).cast("bigint").alias(c)


def s17_php_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = code.php_nodes(php_files(spark, sf_dir))
    return n.select("path", "namespace", "class", "type", F.array_join("imports", ",").alias("imports"))


def j14_php_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.php_edges(code.php_nodes(php_files(spark, sf_dir)))


def s18_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = codegraph.routes(_facts(spark, sf_dir))
    return r.select("path", F.array_join("methods", ",").alias("methods"), "action", "file", "template")


def s19_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = code.twig_templates(twig_files(spark, sf_dir))
    return t.select("path", "extends", F.array_join("includes", ",").alias("includes"), F.array_join(F.array_sort("controllers"), ",").alias("controllers"))


def j25_included_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.included_by(code.twig_templates(twig_files(spark, sf_dir)))


def s20_stimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controllers in scripts and in templates, matched from both sides."""
    c = code.stimulus_controllers(js_files(spark, sf_dir), code.twig_templates(twig_files(spark, sf_dir)))
    return c.select("name", "file", "used_in", "state", F.array_join("values", ",").alias("values"), F.array_join("targets", ",").alias("targets"))


def s21_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("kind = 'symbol'").select("path", F.col("a").alias("symbol"), F.col("c").alias("visibility"), _INT("first_line"), _INT("last_line"))


def s21_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and renders, inherited methods put to the class that has them."""
    return codegraph.calls(held(_facts(spark, sf_dir)))


def s22_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch calls of scripts with the action of the route they name (J15)."""
    return code.match_fetches(code.fetches(js_files(spark, sf_dir)), codegraph.routes(_facts(spark, sf_dir)))


def s22_js_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.js_symbols(js_files(spark, sf_dir))


def j13_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged comments with the method that each belongs to."""
    f = _facts(spark, sf_dir)
    why = f.where("kind = 'rationale'")
    at = code.assign_rationale(why, f.where("kind = 'symbol'"))
    return why.select("path", F.col("first_line").alias("line"), F.col("a").alias("tag"), F.col("b").alias("text")).join(at, ["path", "line"]).select("path", _INT("line"), "tag", "text", "symbol")


def g16_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of one tag whose text holds a word."""
    return _facts(spark, sf_dir).where("kind = 'rationale' and a = upper('todo') and contains(b, 'P1')").select("path", F.col("b").alias("text"))


def a28_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("kind = 'rationale'").groupBy(F.col("a").alias("tag")).agg(F.count("*").alias("n"))


def s14_git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, files and changed lines per author, read from the log's text."""
    return commits(spark, sf_dir).groupBy("author").agg(F.countDistinct("sha").alias("commits"), F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def s15_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.diff_hunks(diff_lines(spark, sf_dir)).select("file", _INT("start"), _INT("end"))


def a12_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits whose message tells a decision, with its kind and files."""
    return codegraph.decisions(commits(spark, sf_dir)).select("sha", "date", "kind", "message", F.array_join("files", ",").alias("files"))


def g12_trace_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call trees of every route for GET and of an unknown one, four steps deep."""
    f = _held_facts(spark, sf_dir)
    r = materialize(codegraph.routes(f))
    asked = r.select(F.lit("get").alias("method"), "path").unionByName(spark.createDataFrame([("GET", "/none"), ("DELETE", "/n0/none")], "method string, path string"))
    asked = asked.unionByName(r.where("array_contains(methods, 'POST')").select(F.lit("DELETE").alias("method"), "path"))
    return codegraph.trace_routes(asked, r, f, 4)


def g13_impact_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and scripts that reach the methods a diff changed, with their risk by the history's hotspots."""
    f = _held_facts(spark, sf_dir)
    r = materialize(codegraph.routes(f))
    hot = codegraph.hotspots(commits(spark, sf_dir), TODAY)
    return codegraph.impact(files.diff_hunks(diff_lines(spark, sf_dir)), f, r, hot, code.match_fetches(code.fetches(js_files(spark, sf_dir)), r))


def g14_file_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every PHP file with its kind, imports, degrees, routes, reasons and hotspot score."""
    f, nodes = _facts(spark, sf_dir), code.php_nodes(php_files(spark, sf_dir))
    return codegraph.file_deps(nodes, code.php_edges(nodes), codegraph.routes(f), codegraph.hotspots(commits(spark, sf_dir), TODAY), f.where("kind = 'rationale'").select("path"))


def j18_rendered_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.rendered_by(code.twig_templates(twig_files(spark, sf_dir)), codegraph.routes(_facts(spark, sf_dir)))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "agjs" and k[1:3].isdigit()}

_F = lambda p: f"(['Service', 'Repository', 'Message', 'Entity'])[{p} % 4 + 1]"
_C = lambda p: f"'App\\' || {_F(p)} || '\\P' || ({p})"
_FILE = lambda p: f"'src/' || {_F(p)} || '/P' || ({p}) || '.php'"
_BASE = "p as (select p_partkey + 1 p, (select max(p_partkey) + 1 from part) n from part), s as (select s_suppkey + 1 s, s_nationkey k from supplier)"
_ROUTE = "'/n' || k || '/s' || s || case when s % 2 = 0 then '/{id}' else '' end"
_ACTION = "'App\\Controller\\S' || s || 'Controller::show'"
_IMPORTS = f"select p, 2 * p q from p where 2 * p <= n union all select p, 2 * p + 1 from p where 2 * p + 1 <= n"
_MESSAGE = "(['" + "', '".join(MESSAGES) + "'])[o_orderkey % 10 + 1]"
_HOT = f"hot as (select l_partkey + 1 p, round(sum(exp(-date_diff('day', o_orderdate::date, date '{TODAY}') / 180.0)), 4) score from lineitem join orders on l_orderkey = o_orderkey group by 1)"
_CALLS = f"""e as (select {_C('p')} || '::run' src, {_C('q')} || '::run' dst, 'call' kind from ({_IMPORTS})
 union all select {_C('p')} || '::run', {_C('p')} || '::getName', 'call' from p
 union all select {_C('p')} || '::getName', case when p % 6 = 0 then {_C('(p - 1)')} else {_C('p')} end || '::make', 'call' from p where p % 4 <> 3
 union all select {_ACTION}, {_C('s')} || '::run', 'call' from s union all select {_ACTION}, 'template:s/' || k || '.html.twig', 'render' from s)"""
ORACLES = {
    "s17_php_nodes": f"with {_BASE}, i as ({_IMPORTS}) select {_FILE('p')} path, 'App\\' || {_F('p')} \"namespace\", 'P' || p \"class\", lower({_F('p')}) \"type\", coalesce((select string_agg({_C('q')}, ',' order by q) from i where i.p = p.p), '') imports from p union all select 'src/Controller/S' || s || 'Controller.php', 'App\\Controller', 'S' || s || 'Controller', 'controller', {_C('s')} from s",
    "j14_php_edges": f"with {_BASE}, i as ({_IMPORTS}) select {_FILE('p')} src, {_FILE('q')} dst from i union all select 'src/Controller/S' || s || 'Controller.php', {_FILE('s')} from s",
    "s18_routes": f"with {_BASE} select {_ROUTE} path, case when s % 2 = 0 then 'GET,POST' else 'GET' end methods, {_ACTION} \"action\", 'src/Controller/S' || s || 'Controller.php' file, 's/' || k || '.html.twig' \"template\" from s",
    "s19_templates": "select 'templates/s/' || n_nationkey || '.html.twig' path, 'r/' || n_regionkey || '.html.twig' extends, 'menu.html.twig' includes, 'c' || n_nationkey || ',r' || n_regionkey || ',shared' controllers from nation union all select 'templates/r/' || r_regionkey || '.html.twig', null, '', '' from region",
    "j25_included_by": "select 'r/' || n_regionkey || '.html.twig' path, count(*) n_users from nation group by 1 union all select 'menu.html.twig', count(*) from nation",
    "s20_stimulus": """with u as (select 'c' || n_nationkey name, 1 n from nation union all select 'shared', count(*) from nation union all select 'r' || n_regionkey, count(*) from nation group by n_regionkey),
 h as (select 'c' || n_nationkey name, 'assets/controllers/c' || n_nationkey || '_controller.js' file from nation where n_nationkey % 3 <> 0 union all select 's' || (s_suppkey + 1), 'assets/controllers/s' || (s_suppkey + 1) || '_controller.js' from supplier)
 select coalesce(u.name, h.name) name, file, coalesce(n, 0) used_in, case when file is null then 'missing' when n is null then 'orphan' else 'used' end state, case when file is not null then 'url,n' end "values", case when file is not null then 'list,row' end targets from u full join h on u.name = h.name""",
    "s21_symbols": f"""with {_BASE}, m as (select * from (values ('__construct', 8, 8, 'public'), ('run', 11, 16, 'public'), ('getName', 18, 21, 'public'), ('make', 23, 26, 'private')) v(m, a, b, v))
 select {_FILE('p')} path, {_C('p')} || '::' || case when m = 'make' and p % 6 = 0 then 'tidy' else m end symbol, v visibility, a first_line, b last_line from p, m
 union all select 'src/Controller/S' || s || 'Controller.php', 'App\\Controller\\S' || s || 'Controller::' || m, v, a, b from s, (values ('__construct', 8, 8, 'public'), ('show', 11, 15, 'public')) w(m, a, b, v)""",
    "s21_calls": f"with {_BASE}, {_CALLS} select distinct src, dst, kind from e",
    "s22_fetches": f"with {_BASE} select 'js:assets/controllers/s' || s || '_controller.js' src, case when s % 2 = 0 then 'POST' else 'GET' end \"method\", '/n' || k || '/s' || s || case when s % 2 = 0 then '/*' else '' end url, {_ACTION} \"action\" from s union all select 'js:assets/controllers/c' || n_nationkey || '_controller.js', 'GET', '/n' || n_nationkey || '/none', null from nation where n_nationkey % 3 <> 0",
    "s22_js_symbols": "select 'js:' || path || '::load' symbol, path from (select 'assets/controllers/c' || n_nationkey || '_controller.js' path from nation where n_nationkey % 3 <> 0 union all select 'assets/controllers/s' || (s_suppkey + 1) || '_controller.js' from supplier)",
    "j13_rationale": f"with {_BASE} select {_FILE('p')} path, 10 line, case when p % 5 = 0 then 'TODO' else 'DEPRECATED' end tag, case when p % 5 = 0 then 'tidy P' || p else 'use P1' end \"text\", {_C('p')} || '::run' symbol from p where p % 5 = 0 or p % 7 = 0",
    "g16_rationale": f"with {_BASE} select {_FILE('p')} path, 'tidy P' || p \"text\" from p where p % 5 = 0 and p::varchar like '1%'",
    "a28_tags": "select case when p % 5 = 0 then 'TODO' else 'DEPRECATED' end tag, count(*) n from (select p_partkey + 1 p from part) where p % 5 = 0 or p % 7 = 0 group by 1",
    "s14_git_log": "select 'a' || o_custkey author, count(distinct o_orderkey) commits, count(*) files, sum(l_quantity::int) added, count(*) deleted from orders join lineitem on l_orderkey = o_orderkey group by 1",
    "s15_hunks": f"with {_BASE} select {_FILE('p')} file, case when p % 50 = 0 then 13 else 17 end \"start\", case when p % 50 = 0 then 13 else 17 end \"end\" from p where p % 50 in (0, 1)",
    "a12_decisions": f"""select 'c' || o_orderkey sha, strftime(o_orderdate, '%Y-%m-%d') "date", (['extraction', 'migration', 'replacement', 'removal', 'refactor', 'introduction', 'introduction'])[o_orderkey % 10 + 1] kind, any_value({_MESSAGE}) message, string_agg(distinct {_FILE('(l_partkey + 1)')}, ',' order by {_FILE('(l_partkey + 1)')}) files
 from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 10 < 7 group by o_orderkey, o_orderdate""",
    "g12_trace_routes": f"""with recursive {_BASE}, {_CALLS}, t as (select {_ACTION} root, {_ACTION} at_, [{_ACTION}] trail, 0 d from s union all select root, e.dst, list_append(trail, e.dst), d + 1 from t join e on e.src = at_ where d < 4),
 l as (select root, trail, at_, d, exists (select 1 from e where e.src = at_) calls from t), f as (select * from l where not calls or d = 4),
 c as (select root, not calls and contains(split_part(at_, '::', 1), '\\Entity\\') and regexp_matches(split_part(at_, '::', 2), '^(?:get|set|is|has|add|remove)[A-Z0-9_]') acc, calls, trail from f),
 g as (select root, case when acc then array_to_string(trail[:-2], ' > ') else array_to_string(trail, ' > ') end trail, case when acc then 'accessors' when calls then 'depth' else 'end' end leaf, count(*) n from c group by 1, 2, 3)
 select 'GET' \"method\", {_ROUTE} path, null error, trail, leaf, n from s join g on root = {_ACTION}
 union all select m, path, 'no such route', null, null, null from (values ('GET', '/none'), ('DELETE', '/n0/none')) v(m, path)
 union all select 'DELETE', {_ROUTE}, 'handles GET, POST', null, null, null from s where s % 2 = 0""",
    "g13_impact_routes": f"""with {_BASE}, {_HOT}, w as (select p.p, d, p.p >> d::int s, coalesce(score, 1.0) score from p left join hot using (p), range(0, 6) r(d) where p.p % 50 = 0 and p.p >> d::int > 0), m as (select w.*, s.k from w join s using (s))
 select 'route' kind, {_ROUTE} name, count(*) reaches, min(d) + 1 least_depth, round(sum(score / (d + 1)), 2) risk from m group by s, k
 union all select 'script', 'js:assets/controllers/s' || s || '_controller.js', count(*), min(d) + 2, null from m where d < 5 group by s""",
    "g14_file_deps": f"""with {_BASE}, {_HOT}, i as ({_IMPORTS}), o as (select p, count(*) c from i group by 1), b as (select q p, count(*) c from (select q from i union all select s from s) group by 1)
 select {_FILE('p.p')} path, lower({_F('p.p')}) \"type\", coalesce(o.c, 0) imports, coalesce(b.c, 0) in_degree, coalesce(o.c, 0) out_degree, 0 routes, case when p.p % 5 = 0 or p.p % 7 = 0 then 1 else 0 end reasons, score from p left join o on o.p = p.p left join b on b.p = p.p left join hot on hot.p = p.p
 union all select 'src/Controller/S' || s || 'Controller.php', 'controller', 1, 0, 1, 1, 0, null from s""",
    "j18_rendered_by": f"with {_BASE} select 'templates/s/' || k || '.html.twig' \"template\", {_ROUTE} route, {_ACTION} \"action\" from s join nation on n_nationkey = k",
}
