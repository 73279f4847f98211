"""Written times against the zone rules of the standard library."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from graphmere.operators.times import _zone_years, epoch_seconds, normalise_times

SCHEMA = "item_seq long, write_actor string, authored string, freshness string, zone string, key string"
ACTORS = [("ny", "America/New_York"), ("syd", "Australia/Sydney"), ("none", None), ("bad", "Mars/Phobos")]


def us(*parts, micro=0):
    return (datetime(*parts, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) + micro


CASES = [
    ("ny", "2024-03-05", us(2024, 3, 5), "offset"),
    ("ny", " '2024-03-05T10:00:00Z'\n", us(2024, 3, 5, 10), "offset"),
    ("ny", "2024-03-05t10:00:00.123456789z", us(2024, 3, 5, 10, micro=123456), "offset"),
    ("ny", "2024-03-05 10:00:00,5 +0545", us(2024, 3, 5, 4, 15, micro=500000), "offset"),
    ("ny", "2024-03-05T10:00:00-03", us(2024, 3, 5, 13), "offset"),
    ("ny", "20240305T100000Z", us(2024, 3, 5, 10), "offset"),
    ("ny", "20240305", us(2024, 3, 5), "offset"),
    ("ny", "2024-01-05 10:00", us(2024, 1, 5, 15), "zone"),
    ("none", "2024-01-05 10:00", us(2024, 1, 5, 10), "utc"),
    ("bad", "2024-01-05 10:00", us(2024, 1, 5, 10), "utc"),
    (None, "2024-01-05 10:00", us(2024, 1, 5, 10), "utc"),
    ("nobody", "2024-01-05 10:00", us(2024, 1, 5, 10), "utc"),
    ("ny", "2023-11-05 01:30", us(2023, 11, 5, 5, 30), "ambiguous"),
    ("ny", "2024-03-10 02:30", us(2024, 3, 10, 7, 30), "nonexistent"),
    ("syd", "2024-04-07 02:30", us(2024, 4, 6, 15, 30), "ambiguous"),
    ("syd", "5.1.2024 16:34", us(2024, 1, 5, 5, 34), "zone"),
    ("syd", "01/05/2024 12:30 am", us(2024, 1, 4, 13, 30), "zone"),
    ("syd", "01/05/2024 12:30 PM", us(2024, 1, 5, 1, 30), "zone"),
    ("syd", "Fri, 05 Jan 2024 10:00:00 EST", us(2024, 1, 5, 15), "offset"),
    ("syd", "Jan 5, 2024 3:00:01 PM CEST", us(2024, 1, 5, 13, 0, 1), "offset"),
    ("syd", "5 January 2024", us(2024, 1, 5), "offset"),
    ("syd", "2024-07-05T10:00:00[Europe/Berlin]", us(2024, 7, 5, 8), "zone"),
    ("syd", "2024-07-05 10:00:00 Asia/Kathmandu", us(2024, 7, 5, 4, 15), "zone"),
    ("ny", "2150-07-05 10:00", us(2150, 7, 5, 14), "zone"),
    ("ny", "1850-07-05 10:00", us(1850, 7, 5, 14, 56, 2), "zone"),
    ("ny", "9999-12-31 23:00", us(9999, 12, 31, 23) + 5 * 3_600_000_000, "zone"),
    ("syd", "0001-01-01 00:30", us(1, 1, 1, 0, 30) - 36_292_000_000, "zone"),
    ("syd", "1700000000", 1_700_000_000_000_000, "offset"),
    ("syd", "1700000000.25", 1_700_000_000_250_000, "offset"),
    ("syd", "1700000000123", 1_700_000_000_123_000, "offset"),
    ("syd", "1700000000123456", 1_700_000_000_123_456, "offset"),
    *[("ny", x, None, "invalid") for x in ("2025-02-30", "2024-13-05T10:00:00Z", "2025-06-14T25:10:00Z", "13/01/2024 1:00 pm", "01/05/2024 13:00 PM", "31.11.2024 10:15", "0000-00-00", "", "soon", "Q3 2025", "T12:30:00Z", "12345", "2024-05-05T10:00:00[Mars/Phobos]", "2024-05-05 10:00:00 XYZ", "x" * 5000, "2024-05-05T10:00:60Z")],
]


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, a, t, None, "clash", "clash") for i, (a, t, _, _) in enumerate(CASES)]
    out = normalise_times(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ACTORS, "write_actor string, home_zone string"))
    return {r["item_seq"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(result, i):
    assert (result[i]["utc_us"], result[i]["status"]) == CASES[i][2:], CASES[i]


def test_empty_and_repeated(spark):
    actors = spark.createDataFrame(ACTORS + ACTORS, "write_actor string, home_zone string")
    assert normalise_times(spark.createDataFrame([], SCHEMA), actors).count() == 0
    rows = [(1, "ny", "2024-01-05 10:00", "2024-01-05", None, None)] * 2 + [(2, None, None, None, None, None)]
    out = normalise_times(spark.createDataFrame(rows, SCHEMA), actors)
    assert sorted((r["item_seq"], r["field"]) for r in out.collect()) == [(1, "authored")] * 2 + [(1, "freshness")] * 2
    assert normalise_times(spark.createDataFrame(rows, SCHEMA), actors.limit(0)).filter(F.col("status") == "zone").count() == 0


def test_every_hour_of_a_year_of_changes(spark):
    zone = ZoneInfo("America/Sao_Paulo")
    hours = [datetime(2018, 1, 1) + timedelta(hours=7 * h, minutes=13) for h in range(1250)] + [datetime(2018, 11, 4, 0, m) for m in range(0, 60, 9)] + [datetime(2018, 2, 17, 23, m) for m in range(0, 60, 9)]
    rows = [(i, "br", t.strftime("%Y-%m-%d %H:%M"), None, None, None) for i, t in enumerate(hours)]
    out = normalise_times(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("br", "America/Sao_Paulo")], "write_actor string, home_zone string"))
    got = {r["item_seq"]: r["utc_us"] for r in out.collect()}
    for i, t in enumerate(hours):
        want = (t.replace(tzinfo=zone, fold=0).astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        assert got[i] == want, t


def test_seconds_of_headers(spark):
    rows = [("2024-03-05",), ("2024-03-05 10:00",), ("2024-03-05T10:00:00.5+02:00",), ("1700000000",), ("soon",), (None,), ("2024-03-05 10:00 Europe/Berlin",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(epoch_seconds(F.col("t"))).collect()]
    assert got == [us(2024, 3, 5) / 1e6, us(2024, 3, 5, 10) / 1e6, us(2024, 3, 5, 8) / 1e6 + 0.5, 1.7e9, None, None, None]


def test_worker_without_zone_database(monkeypatch):
    import pandas as pd

    monkeypatch.setattr("zoneinfo.available_timezones", set)
    with pytest.raises(RuntimeError):
        list(_zone_years(iter([pd.DataFrame({"zone": ["Europe/Berlin"], "year": [2024]})])))
