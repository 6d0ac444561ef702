import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from siltstone.operators.timestamps import to_instant

UTC = dt.UTC


def us(*args, zone=UTC, fold=0, micros=0):
    t = dt.datetime(*args, tzinfo=zone, fold=fold).astimezone(UTC)
    return int((t - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + micros


BERLIN, NEW_YORK = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("2024-01-08T05:57:54.152Z", "Europe/Berlin", us(2024, 1, 8, 5, 57, 54, micros=152000)),
    ("2024-04-23T15:11:08.774589999Z", "UTC", us(2024, 4, 23, 15, 11, 8, micros=774589)),
    ("2024-01-10T19:58:58-05:00", "UTC", us(2024, 1, 11, 0, 58, 58)),
    ("2024-01-10T19:58:58-0530", "UTC", us(2024, 1, 11, 1, 28, 58)),
    ("2024-01-12 00:29:51 CET", "UTC", us(2024, 1, 11, 23, 29, 51)),
    ("2025-04-21 08:24:13 America/New_York", "UTC", us(2025, 4, 21, 8, 24, 13, zone=NEW_YORK)),
    ("2025-05-16T18:29:05.456+02:00[Europe/Berlin]", "UTC", us(2025, 5, 16, 16, 29, 5, micros=456000)),
    ("20240108T122344Z", "Asia/Tokyo", us(2024, 1, 8, 12, 23, 44)),
    ("20240108", "Europe/Berlin", us(2024, 1, 7, 23)),
    ("12/29/2024 04:21:13 AM", "UTC", us(2024, 12, 29, 4, 21, 13)),
    ("12/29/2024 12:21:13 AM", "UTC", us(2024, 12, 29, 0, 21, 13)),
    ("1/2/2025", "UTC", us(2025, 1, 2)),
    ("01.02.2026 10:16:47", "UTC", us(2026, 2, 1, 10, 16, 47)),
    ("2024/01/15", "UTC", us(2024, 1, 15)),
    ("10 Feb 2025, 07:45", "UTC", us(2025, 2, 10, 7, 45)),
    ("April 10, 2024", "Europe/Berlin", us(2024, 4, 9, 22)),
    ("Fri, 01 Aug 2025 19:22:57 +0530", "UTC", us(2025, 8, 1, 13, 52, 57)),
    ("Apr 11, 2024 03:05:51 PM CEST", "UTC", us(2024, 4, 11, 13, 5, 51)),
    ("1704906598", "Asia/Tokyo", 1704906598000000),
    ("1705589329.794", "Asia/Tokyo", 1705589329794000),
    ("1704936042153", "Asia/Tokyo", 1704936042153000),
    ("1705148630494089", "Asia/Tokyo", 1705148630494089),
    ("1705148630494089123", "Asia/Tokyo", 1705148630494089),
    # twice: the earlier instant; skipped: the offset before the change
    ("2024-10-27 02:30:00", "Europe/Berlin", us(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "Europe/Berlin", us(2024, 3, 31, 1, 30)),
    ("2024-11-03 01:30:00", "America/New_York", us(2024, 11, 3, 5, 30)),
    (" 2024-05-20 03:10:42 ", "America/Los_Angeles", us(2024, 5, 20, 10, 10, 42)),
] + [(v, "UTC", None) for v in ("", "-", None, "TBD", "last sprint", "0000-00-00 00:00:00", "2025-02-30T10:00:00Z", "2025-06-17T27:10:00Z", "2025-13-04", "99", "2024-01-01 10:00:00 Nowhere/City")] + [("2024-01-01 10:00:00", None, None), ("2024-01-01 10:00:00", "Mars/Base", None)]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, v, z, "kept", 7) for i, (v, z, _) in enumerate(CASES)], "i int, value string, host_tz string, _ts_v string, zone_key int")
    out = to_instant(df, "value", "host_tz")
    assert out.columns == ["i", "value", "host_tz", "_ts_v", "zone_key", "utc_us"]
    rows = out.collect()
    assert len(rows) == len(CASES) and {r["_ts_v"] for r in rows} == {"kept"}
    return {r["i"]: r["utc_us"] for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_instant(found, i):
    assert found[i] == CASES[i][2], CASES[i]


def test_every_hour_around_changes(spark):
    """Against the standard library, over changes in both directions and a zone with half hours."""
    rows = []
    for zone in ("Europe/London", "America/New_York", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kolkata"):
        for day in ("2024-03-31", "2024-10-27", "2024-03-10", "2024-11-03", "2024-04-07", "2024-10-06"):
            rows += [(f"{day} {h:02d}:{m:02d}:07", zone) for h in range(5) for m in (0, 15, 30, 59)]
    got = to_instant(spark.createDataFrame(rows, "value string, host_tz string"), "value", "host_tz").collect()
    epoch = dt.datetime(1970, 1, 1, tzinfo=UTC)
    for r in got:
        local = dt.datetime.strptime(r["value"], "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(r["host_tz"]))
        # fold 0 is the earlier of two instants, and the offset before the change in a gap
        assert r["utc_us"] == int((local.astimezone(UTC) - epoch).total_seconds()) * 1_000_000, r


def test_empty_table(spark):
    assert to_instant(spark.createDataFrame([], "value string, host_tz string"), "value", "host_tz").collect() == []


def test_short_interval_of_the_zone_database(spark):
    """Gaza has an interval of six days, 2040-10-20 to 2040-10-26."""
    rows = [(f"2040-10-{d} 12:00:00", z) for d in range(18, 31) for z in ("Asia/Gaza", "Asia/Hebron")]
    for r in to_instant(spark.createDataFrame(rows, "value string, host_tz string"), "value", "host_tz").collect():
        assert r["utc_us"] == us(2040, 10, int(r["value"][8:10]), 12, zone=ZoneInfo(r["host_tz"])), r


def test_years_outside_the_buckets(spark):
    years = (1700, 1883, 1900, 1945, 1968, 1969, 1970, 2100, 2101, 2128, 2129, 2150, 2200, 2399, 2400, 9998)
    rows = [(f"{y}-{m:02d}-{d} 16:00:00", z) for y in years for m in (1, 3, 7, 10, 12) for d in (13, 31) for z in ("America/Los_Angeles", "Europe/Berlin", "Australia/Sydney")]
    got = to_instant(spark.createDataFrame(rows, "value string, host_tz string"), "value", "host_tz").collect()
    epoch = dt.datetime(1970, 1, 1, tzinfo=UTC)
    for r in got:
        local = dt.datetime.strptime(r["value"], "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(r["host_tz"]))
        assert r["utc_us"] == int((local.astimezone(UTC) - epoch).total_seconds()) * 1_000_000, r
    assert len(got) == len(rows) and {r["utc_us"] for r in got if r["value"] == "1969-12-31 16:00:00" and "Los" in r["host_tz"]} == {0}
