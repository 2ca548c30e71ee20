import datetime as dt

import pandas as pd
import pytest
from helpers import rows, utc
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal

HOUR = "%Y-%m-%d-%H"


def hour(text):
    return dt.datetime.strptime(text, HOUR)


def previous_by_hand(code, at):
    """Period before the one that holds ``at``: start, last hour and label."""
    day = at.replace(hour=0)
    if code == "D":
        start, nxt = day - dt.timedelta(days=1), day
    elif code == "M":
        nxt = day.replace(day=1)
        start = (nxt - dt.timedelta(days=1)).replace(day=1)
    else:
        nxt = day - dt.timedelta(days=day.weekday())
        start = nxt - dt.timedelta(days=7)
    label = start + dt.timedelta(days=6) if code == "W-SUN" else start
    return start, nxt - dt.timedelta(hours=1), label


@pytest.mark.parametrize("code", ["D", "M", "W-SUN"])
def test_previous_period(spark, code):
    times = [dt.datetime(2027, 12, 30) + dt.timedelta(hours=17 * k) for k in range(90)]
    keys = spark.createDataFrame([(t.replace(tzinfo=dt.timezone.utc),) for t in times], "t TIMESTAMP")
    previous = cal.previous_period(F.col("t"), cal.frequency_of_code(code))
    found = keys.select("t", previous.alias("p")).select("t", "p.start", "p.last_hour", "p.ds")
    found = {r[0]: tuple(r[1:]) for r in rows(found)}
    assert found == {t: previous_by_hand(code, t) for t in times}


# Horizon and code by frequency.
@pytest.mark.parametrize(
    "name,h,code", [("hourly", 24, "h"), ("daily", 7, "D"), ("weekly", 1, "W-SUN"), ("monthly", 1, "MS")]
)
def test_frequency(name, h, code):
    f = cal.frequency(name)
    assert (f.h, f.code) == (h, code)
    assert cal.frequency_of_code(code) == f


@pytest.mark.parametrize("name", ["yearly", "HOURLY", "Monthly", "days", " daily", "D"])
def test_invalid_frequency(name):
    with pytest.raises(ValueError):
        cal.frequency(name)


def test_unknown_code():
    with pytest.raises(ValueError):
        cal.frequency_of_code("Q")


def test_parse_cutoff(spark):
    moment = dt.datetime(2031, 11, 9, 23, 5, 7)
    shapes = {"%Y-%m-%d-%H": {"minute": 0, "second": 0}, "%Y-%m-%d": {"hour": 0, "minute": 0, "second": 0}, "%Y-%m-%d %H:%M:%S": {}}
    wanted = {moment.strftime(shape): moment.replace(**cut) for shape, cut in shapes.items()} | {"09.11.2031": None, "": None}
    df = spark.createDataFrame([(t,) for t in wanted], "t STRING")
    assert dict(rows(df.select("t", cal.parse_cutoff(F.col("t"))))) == wanted
    for text, value in wanted.items():
        if value is None:
            with pytest.raises(ValueError):
                cal.cutoff_value(text)
        else:
            assert cal.cutoff_value(text) == value.replace(tzinfo=dt.timezone.utc)


def test_hour_grids(spark):
    first = dt.datetime(2028, 2, 28, 22)
    leap = [first + dt.timedelta(hours=k) for k in range(30)]
    assert [r[0] for r in rows(cal.hours_between(spark, "2028-02-28-22", "2028-03-01-03"))] == leap
    before = [r[0] for r in rows(cal.previous_hours(spark, 5, utc("2028-03-01T01:40")))]
    assert before == [dt.datetime(2028, 2, 29, 20) + dt.timedelta(hours=k) for k in range(5)]
    assert cal.last_day_boundary(utc("2028-03-01T23:59")) == utc("2028-03-01")


@pytest.mark.parametrize(
    "name,start,step",
    [("hourly", "2026-01-03-05", "24h"), ("daily", "2026-01-04", "7D"), ("weekly", "2026-01-06", "1W"), ("monthly", "2025-10-05", "1MS")],
)
def test_cutoff_range(spark, name, start, step):
    as_of = utc("2026-03-10T09:00")
    expected = pd.date_range(cal.cutoff_value(start), as_of, freq=step).tz_localize(None)
    if name in ("weekly", "monthly"):
        expected = expected[:-1]
    assert [r[0] for r in rows(cal.cutoff_range(spark, name, start, as_of))] == list(expected)


def test_empty_ranges(spark):
    assert rows(cal.cutoff_range(spark, "daily", "2026-01-04", utc("2026-01-01"))) == []
    assert rows(cal.cutoff_range(spark, "monthly", "2026-01-01", utc("2026-01-20"))) == []


def test_aggregation_grid(spark):
    found = rows(cal.aggregation_grid(spark, "weekly", "2023-01-09-01", utc("2023-02-01T05:00")))
    assert [r[0] for r in found] == list(
        pd.date_range("2023-01-09 01:00", "2023-02-01", freq="W-SUN")
    )


@pytest.mark.parametrize("name", ["hourly", "daily", "weekly", "monthly"])
def test_index_label_roundtrip(spark, name):
    times = pd.date_range("1969-11-20", "1970-03-05", freq="7h").append(
        pd.date_range("2022-12-20", "2023-01-10", freq="5h")
    )
    df = spark.createDataFrame([(t.to_pydatetime().replace(tzinfo=dt.timezone.utc),) for t in times], "t TIMESTAMP")
    idx = cal.period_index(F.col("t"), name)
    found = df.select("t", cal.period_label(idx, name).alias("ds"), cal.period_start(idx, name).alias("s"))
    code = {"hourly": "h", "daily": "D", "weekly": "W-SUN", "monthly": "M"}[name]
    for t, ds, start in rows(found):
        period = pd.Timestamp(t).to_period(code)
        label = period.end_time.normalize() if name == "weekly" else period.start_time
        assert pd.Timestamp(ds) == label and pd.Timestamp(start) == period.start_time
    same = df.select(cal.period_index(cal.period_label(idx, name), name) == idx)
    assert all(r[0] for r in same.collect())


def test_iso_week_partition(spark):
    days = spark.createDataFrame([(utc("2023-01-01"),), (utc("2024-12-30"),)], "t TIMESTAMP")
    parts = cal.partition_values(F.col("t"), "weekly")
    assert rows(days.select(parts["year"], parts["week"])) == [(2022, 52), (2025, 1)]


def test_expected_hours(spark):
    t = F.lit(utc("2024-02-10"))
    counts = [cal.expected_hours(cal.period_index(t, f), f).alias(f) for f in ("daily", "weekly", "monthly")]
    row = spark.range(1).select(*counts, F.size(cal.period_hours(cal.period_index(t, "monthly"), "monthly"))).first()
    assert tuple(row) == (24, 168, 29 * 24, 29 * 24)
