"""Instants out of timestamps in mixed formats, precisions and time zones.

Method: each value is parsed into a *local* wall-clock time plus whatever names its
zone.  A zone given as an offset or a fixed abbreviation needs no lookup.  All
other local times are as-of joined to a table of zone-offset intervals, exploded to
one bucket per (zone, four years): two matching intervals mean the local time is ambiguous
(the earlier instant is taken), none means it was skipped by a change (the offset
before the change is used), one gives the offset directly.

The interval table depends on the time-zone database only, never on the data: its
size is bounded by zones x years, and it is joined by broadcast for that reason.  One
bucket holds all changes before FIRST_YEAR; a later year than LAST_YEAR is looked up in
one of the last 28 with the same calendar, as only yearly rules are left by then.

Defined results for odd input: a null, blank, unparsable or impossible value (31
November, hour 27, all zeros) gives a null instant; an unknown zone name gives a
null instant; finer digits than microseconds are cut off.
"""

from __future__ import annotations

import datetime as dt
import importlib.resources
import io
import pathlib
import zoneinfo
from functools import lru_cache
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Zone abbreviations with one meaning here, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Month names by their first three letters.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

FIRST_YEAR, LAST_YEAR = 1970, 2128
#: Years of one bucket: fewer rows for the driver against more intervals to look through.
SPAN = 4
#: Seconds of a time before any change in the database (1800).
EARLIEST = -5_364_662_400


def _listed(zone: str) -> tuple[np.ndarray, np.ndarray, str]:
    """(changes, offsets before, between and after them, rule from then on) as the zone's file says, in seconds."""
    places = [pathlib.Path(root, zone) for root in zoneinfo.TZPATH]
    data = next((p.read_bytes() for p in places if p.is_file()), None)
    if data is None:
        data = importlib.resources.files("tzdata").joinpath("zoneinfo", zone).read_bytes()
    width, at = 4, 0
    isut, isstd, leap, times, types, chars = unpack(">6l", data[20:44])
    if data[4:5] >= b"2":  # the block of 64 bits follows that of 32
        width, at = 8, 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
        isut, isstd, leap, times, types, chars = unpack(">6l", data[at + 20 : at + 44])
    at += 44
    changes = np.frombuffer(data, f">i{width}", times, at).astype(np.int64)
    kinds = np.frombuffer(data, "u1", times, at + times * width)
    at += times * (width + 1)
    off = np.array([unpack(">l", data[at + 6 * i : at + 6 * i + 4])[0] for i in range(types)], np.int64)
    end = at + types * 6 + chars + leap * (width + 4) + isstd + isut
    return changes, np.r_[off[:1], off[kinds]], data[end:].strip().decode() if width == 8 else ""


@lru_cache(maxsize=512)
def _ruled(rule: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(changes, offsets after them) of a yearly rule from ``lo`` to ``hi``; its periods last far longer than eight days."""
    if "," not in rule:
        return np.array([], np.int64), np.array([], np.int64)
    head = lambda types: b"TZif2" + bytes(15) + pack(">6l", 0, 0, 0, 0, types, types)
    zone = zoneinfo.ZoneInfo.from_file(io.BytesIO(head(1) + bytes(7) + head(1) + bytes(7) + f"\n{rule}\n".encode()))
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    offset = lambda t: int((epoch + dt.timedelta(seconds=int(t))).astimezone(zone).utcoffset().total_seconds())
    samples = np.append(np.arange(lo, hi, 8 * 86400), hi)
    at = np.array([offset(t) for t in samples])
    changes = []
    for i in np.flatnonzero(at[1:] != at[:-1]):
        a, b = samples[i], samples[i + 1]
        while b - a > 1:
            m = (a + b) // 2
            a, b = (m, b) if offset(m) == at[i] else (a, m)
        changes.append(b)
    return np.array(changes, np.int64), at[1:][at[1:] != at[:-1]]


@lru_cache(maxsize=4)
def zone_intervals(first: int = FIRST_YEAR, last: int = LAST_YEAR) -> pa.Table:
    """(zone_key, utc_start, utc_end, off), in seconds, for every zone of the database.

    Changes come from the zone's file, which lists them one by one up to where a yearly rule takes over.
    """
    epoch = lambda y: int(np.datetime64(f"{y}-01-01", "s").astype(np.int64))
    lo, hi = epoch(first - 1), epoch(last + 2)
    names, starts, ends, offsets = [], [], [], []
    for zone in sorted(zoneinfo.available_timezones()):
        if zone in ("localtime", "Factory") or zone.startswith(("posix/", "right/")):
            continue
        listed, off, rule = _listed(zone)
        ruled, after = _ruled(rule, lo, hi)
        later = ruled > (listed[-1] if len(listed) else EARLIEST)
        at, off = np.r_[listed, ruled[later]], np.r_[off, after[later]]
        a, b = np.searchsorted(at, EARLIEST, side="right"), np.searchsorted(at, hi)
        at, off = at[a:b], off[a : b + 1]
        moved = off[1:] != off[:-1]
        cuts = np.r_[EARLIEST, at[moved], hi]
        names += [zone.lower()] * (len(cuts) - 1)
        starts.append(cuts[:-1]), ends.append(cuts[1:]), offsets.append(np.r_[off[:1], off[1:][moved]])
    return pa.table({"zone_key": names, "utc_start": np.concatenate(starts), "utc_end": np.concatenate(ends), "off": np.concatenate(offsets)})


@lru_cache(maxsize=4)
def _bucket_table(first: int, last: int) -> pa.Table:
    flat = zone_intervals(first, last)
    zones = flat["zone_key"].to_numpy(zero_copy_only=False)
    start, end, off = (flat[c].to_numpy() for c in ("utc_start", "utc_end", "off"))
    years = np.arange(first - 1, last + 1, SPAN)
    edge = lambda y: np.array([np.datetime64(f"{x}-01-01", "s").astype(np.int64) for x in y])
    begins, stops = edge(years - 1), edge(years + SPAN + 1)
    head = np.flatnonzero(np.r_[True, zones[1:] != zones[:-1]])
    keys, counts, members = [], [], []
    for a, b in zip(head, np.r_[head[1:], len(zones)], strict=True):
        # the intervals that touch the years or their neighbours stand together
        lo = a + np.searchsorted(end[a:b], begins, side="right")
        hi = a + np.searchsorted(start[a:b], stops, side="left")
        lo[0] = a  # the first bucket holds all before
        n = hi - lo
        keys += [zones[a]] * len(years)
        counts.append(n)
        members.append(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    at = np.concatenate(members)
    structs = pa.StructArray.from_arrays([pa.array(start[at] + off[at]), pa.array(end[at] + off[at]), pa.array(off[at])], ["lo", "hi", "off"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)), structs)
    return pa.table({"zone_key": keys, "bucket": pa.array(np.tile(np.arange(len(years)), len(head)).astype(np.int32)), "intervals": lists})


def interval_buckets(spark: SparkSession, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """One row per (zone, bucket of years): the intervals in local time that touch the years or their neighbours, in order.

    The first bucket stands for all earlier years too.
    """
    return spark.createDataFrame(_bucket_table(first, last))


# --- parsing ---------------------------------------------------------------------------------

_ZONE = r"\s*(Z|z|[+-]\d{2}:?\d{2}(?::\d{2})?|[A-Za-z]{1,5}|[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)?(?:\[([A-Za-z0-9_+\-/]+)\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?" + _ZONE
_TIME = rf"(?:(?:[Tt]|\s*,\s*|\s+){_CLOCK})?"
#: name -> (pattern, groups of year, month, day); the clock's groups follow the last of them.
_PATTERNS = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_TIME}$", 1, 2, 3),
    "ymd_slash": (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_TIME}$", 1, 2, 3),
    "ymd_dot": (rf"^(\d{{4}})\.(\d{{1,2}})\.(\d{{1,2}}){_TIME}$", 1, 2, 3),
    "us": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TIME}$", 3, 1, 2),
    "dots": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_TIME}$", 3, 2, 1),
    "day_first": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3,9}})\.?,?[\s-](\d{{4}}){_TIME}$", 3, 2, 1),
    "month_first": (rf"^(?:[A-Za-z]{{6,9}},?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_TIME}$", 3, 1, 2),
}
_COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?" + _ZONE + "$"


def _group(value: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def _whole(text: Column) -> Column:
    return text.try_cast("int")


def _micros(digits: Column) -> Column:
    """The first six of the digits behind the point, as microseconds."""
    return F.coalesce(F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("bigint"), F.lit(0))


def _parts(value: Column) -> Column:
    """Struct of the date's and the clock's texts, by the first pattern that matches."""
    names = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "region")

    def struct(pattern: str, groups: list[int | None]) -> Column:
        return F.struct(*[(_group(value, pattern, g) if g else F.lit(None).cast("string")).alias(n) for n, g in zip(names, groups, strict=True)])

    out = F.when(value.rlike(_COMPACT), struct(_COMPACT, [1, 2, 3, 4, 5, 6, 7, None, 8, 9]))
    for pattern, y, m, d in _PATTERNS.values():
        out = out.when(value.rlike(pattern), struct(pattern, [y, m, d, 4, 5, 6, 7, 8, 9, 10]))
    return out


def _number_micros(value: Column) -> Column:
    """Microseconds since 1970 of a bare number, in the unit that its number of digits implies."""
    whole = F.regexp_extract(value, r"^(-?\d+)", 1)
    digits = F.length(F.regexp_replace(whole, "-", ""))
    n = whole.try_cast("bigint")
    fraction = _micros(_group(value, r"^-?\d+[.,](\d+)$", 1))
    return (
        F.when(digits.between(9, 11), n * 1_000_000 + fraction)
        .when(digits.between(12, 14), n * 1000 + F.floor(fraction / 1000))
        .when(digits.between(15, 17), n)
        .when(digits.between(18, 19), F.floor(F.try_divide(n.cast("decimal(20,0)"), F.lit(1000))).cast("bigint"))
    )


def parse_local(df: DataFrame, value: str, host_zone: str | None, prefix: str = "_ts_") -> DataFrame:
    """Adds ``{prefix}utc`` (instant already known), ``{prefix}local`` (wall clock, microseconds)
    and ``{prefix}zone`` (zone whose offset has to be looked up)."""
    v = F.regexp_replace(F.col(value), r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$", "")
    out = df.withColumn(f"{prefix}v", F.regexp_replace(v, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    out = out.withColumn(f"{prefix}p", _parts(F.col(f"{prefix}v")))
    p = lambda name: F.col(f"{prefix}p.{name}")
    month_name = F.create_map(*[x for m, i in MONTHS.items() for x in (F.lit(m), F.lit(i))])
    month = F.coalesce(_whole(p("month")), F.try_element_at(month_name, F.lower(F.substring(p("month"), 1, 3))))
    date = F.try_to_date(F.format_string("%s-%02d-%02d", p("year"), month, _whole(p("day"))), "yyyy-MM-dd")
    hour = F.coalesce(_whole(p("hour")), F.lit(0))
    half = F.lower(p("half"))
    hour = (
        F.when(half.isNull(), hour)
        .when(~hour.between(1, 12), F.lit(99))
        .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    minute, second = F.coalesce(_whole(p("minute")), F.lit(0)), F.coalesce(_whole(p("second")), F.lit(0))
    ok = (hour < 24) & (minute < 60) & (second < 60) & (_whole(p("year")) > 0)
    local = F.when(ok, ((F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second) * 1_000_000) + _micros(p("fraction")))
    fixed = F.create_map(*[x for a, m in ABBREVIATIONS.items() for x in (F.lit(a), F.lit(m * 60))])
    sign = F.when(F.substring(p("zone"), 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(p("zone"), "[^0-9]", "")
    named = F.when(p("zone").rlike("^[+-]"), sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60 + F.coalesce(F.nullif(F.substring(digits, 5, 2), F.lit("")).try_cast("int"), F.lit(0)))).otherwise(
        F.try_element_at(fixed, F.upper(p("zone")))
    )
    host = F.col(host_zone) if host_zone else F.lit("UTC")
    number = F.col(f"{prefix}v").rlike(r"^-?\d{9,19}(?:[.,]\d+)?$")
    out = out.withColumn(f"{prefix}local", local).withColumn(f"{prefix}off", named)
    out = out.withColumn(
        f"{prefix}utc",
        F.when(number, _number_micros(F.col(f"{prefix}v"))).otherwise(F.col(f"{prefix}local") - F.col(f"{prefix}off").cast("bigint") * 1_000_000),
    )
    zone = F.when(F.col(f"{prefix}off").isNotNull(), F.lit(None)).otherwise(F.coalesce(p("region"), p("zone"), F.trim(host)))
    return out.withColumn(f"{prefix}zone", F.lower(zone)).drop(f"{prefix}v", f"{prefix}p", f"{prefix}off")


def lookup_utc(local: Column, intervals: Column) -> Column:
    """The instant of a wall-clock time, out of the ordered offset intervals near it (microseconds)."""
    second = F.floor(local / 1_000_000).cast("bigint")
    hits = F.filter(intervals, lambda x: (x["lo"] <= second) & (second < x["hi"]))
    before = F.filter(intervals, lambda x: x["hi"] <= second)
    most = F.array_max(F.transform(hits, lambda x: x["off"]))  # the largest offset gives the earlier instant
    last = F.element_at(before, -1)["off"]
    first = F.try_element_at(intervals, F.lit(1))["off"]  # before any change
    return local - F.when(F.size(hits) > 0, most).when(F.size(before) > 0, last).otherwise(first).cast("bigint") * 1_000_000


def _bucket_time(local: Column) -> Column:
    """The wall-clock time itself, or beyond LAST_YEAR the same time of a bucketed year with the same calendar."""
    day = lambda y: np.datetime64(f"{y}-01-01", "D").astype(int)
    like = {(int(day(y)) % 7, int(day(y + 1) - day(y)) == 366): int(day(y)) for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    starts = F.array(*[F.lit(like[w, leap]) for w in range(7) for leap in (False, True)])
    date = F.date_from_unix_date(F.floor(local / 86_400_000_000).cast("int"))
    start, end = (F.unix_date(F.make_date(F.year(date) + n, F.lit(1), F.lit(1))) for n in (0, 1))
    shift = F.get(starts, start % 7 * 2 + (end - start - 365)) - start
    return F.when(F.year(date) > LAST_YEAR, local + shift.cast("bigint") * 86_400_000_000).otherwise(local)


def to_instant(df: DataFrame, value: str, host_zone: str | None = None, out: str = "utc_us") -> DataFrame:
    """``df`` with the bigint column ``out``: the instant that ``value`` names, null if it names none.

    ``df`` may hold columns of any names.  ``host_zone``: the column of the zone used where a value names none (UTC if omitted);
    a null or unknown host zone gives null for such values.  Rows are kept one to one; a
    column called ``out`` is replaced, helper columns are prefixed and dropped.
    """
    # broadcast: bounded by the time-zone database (zones x years), independent of the data
    buckets = F.broadcast(interval_buckets(df.sparkSession))
    p = "_ts_"
    while any(c.startswith(p) for c in df.columns):
        p = "_" + p
    parsed = parse_local(df, value, host_zone, p)
    year = F.year(F.date_from_unix_date(F.floor(F.col(f"{p}near") / 86_400_000_000).cast("int")))
    parsed = parsed.withColumn(f"{p}near", _bucket_time(F.col(f"{p}local")))
    nth = F.floor((F.greatest(year, F.when(year.isNotNull(), F.lit(FIRST_YEAR - 1))) - (FIRST_YEAR - 1)) / SPAN).cast("int")
    joined = parsed.withColumn(f"{p}nth", nth).join(
        buckets.select(F.col("zone_key").alias(f"{p}zone_key"), F.col("bucket").alias(f"{p}bucket"), F.col("intervals").alias(f"{p}intervals")),
        (F.col(f"{p}zone") == F.col(f"{p}zone_key")) & (F.col(f"{p}nth") == F.col(f"{p}bucket")),
        "left",
    )
    looked_up = lookup_utc(F.col(f"{p}near"), F.col(f"{p}intervals")) + F.col(f"{p}local") - F.col(f"{p}near")
    found = F.coalesce(F.col(f"{p}utc"), looked_up)
    helpers = [c for c in joined.columns if c.startswith(p)]
    return joined.withColumn(out, found).drop(*helpers)
