"""Queries over timestamps in mixed formats and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.timestamps import to_instant
from siltstone.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's start and every article's update that names an instant, in UTC."""
    sources = (("agent_sessions", "import_id", "started_at"), ("articles", "article_id", "updated"))
    rows = [
        table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).alias("row_id"), F.col(value).alias("value"), "host_tz")
        for name, key, value in sources
    ]
    found = to_instant(rows[0].unionByName(rows[1]), "value", "host_tz")
    return found.where("utc_us is not null").select("source_table", "row_id", "utc_us")


#: Minutes east of UTC of the abbreviations that the values hold, as the SQL has them.
_ABBR = "map {'UTC': 0, 'GMT': 0, 'CET': 60, 'CEST': 120, 'BST': 60, 'IST': 330, 'JST': 540, 'AEST': 600, 'AEDT': 660, 'EST': -300, 'EDT': -240, 'PST': -480, 'PDT': -420}"
_FORMATS = [
    "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S", "%Y%m%d", "%Y/%m/%d",
    "%d.%m.%Y %H:%M:%S", "%d.%m.%Y", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y", "%d %b %Y, %H:%M", "%d %b %Y", "%a, %d %b %Y %H:%M:%S", "%B %d, %Y", "%b %d, %Y", "%b %d, %Y %I:%M:%S %p",
]
QUERIES = {"p2_found": p2_found}
# formats by the parser of the other engine, zones by its calendar: of two instants with one local time the earlier is kept
ORACLES: dict[str, str] = {
    "p2_found": f"""with r as (select 'agent_sessions' source_table, import_id row_id, trim(started_at) v, host_tz from agent_sessions union all select 'articles', article_id, trim(updated), host_tz from articles),
 a as (select *, regexp_extract(v, '[0-9] ?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})(?:\\[[^\\]]*\\])?$', 1) o from r where v is not null),
 b as (select *, case when o = '' then v else regexp_replace(v, ' ?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})(?:\\[[^\\]]*\\])?$', '') end w from a),
 c as (select *, regexp_extract(w, ' ([A-Z]{{3,5}}|[A-Za-z]+/[A-Za-z_]+)$', 1) z from b),
 d as (select *, try_strptime(regexp_replace(regexp_replace(regexp_replace(w, ' (?:[A-Z]{{3,5}}|[A-Za-z]+/[A-Za-z_]+)$', ''), '([0-9]{{2}}),([0-9]+)$', '\\1.\\2'), '(\\.[0-9]{{6}})[0-9]+$', '\\1'), {_FORMATS}) l, case when regexp_full_match(v, '[0-9]{{10}}(?:\\.[0-9]+)?') then (v::decimal(28, 6) * 1000000)::bigint when regexp_full_match(v, '[0-9]{{13}}') then v::bigint * 1000 when regexp_full_match(v, '[0-9]{{16}}') then v::bigint end n from c),
 e as (select *, case when o = 'Z' then 0 when o <> '' then (case when o[1] = '-' then -1 else 1 end) * (o[2:3]::int * 60 + right(o, 2)::int) else {_ABBR}[z] end m, case when z like '%/%' then z else host_tz end tz from d),
 f as (select *, case when n is null and m is null and l is not null then epoch_us(timezone(tz, l)) end u from e)
 select source_table, row_id, coalesce(n, epoch_us(l) - m::bigint * 60000000, list_min(list_filter([u, u - 1800000000, u - 3600000000], lambda x: x = u or timezone(tz, make_timestamptz(x)) = l))) utc_us from f where coalesce(n, epoch_us(l)) is not null""",
}
