import datetime as dt
import re

import pytest
from helpers import rows, utc
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import series


def raw_events(spark, events):
    """Raw events of ``(repo_id, type, action, hour)``."""
    data = [(i, r, t, a, h.year, h.month, h.day, h.hour) for i, (r, t, a, h) in enumerate(events)]
    return spark.createDataFrame(
        data, "event_id INT, repo_id BIGINT, event_type STRING, action STRING, year INT, month INT, day INT, hour INT"
    )


def entities(spark, *ids):
    return spark.createDataFrame([(i, f"repo/{i}") for i in ids], "repo_id BIGINT, repo_name STRING")


def firsts(spark, pairs):
    return spark.createDataFrame(pairs, "repo_id BIGINT, first_hour TIMESTAMP")


T = dt.datetime(2025, 1, 1)
H = dt.timedelta(hours=1)


def test_one_hour(spark):
    """An entity seen an hour ago is zero-filled; one seen an hour later is absent."""
    raw = raw_events(spark, [(9, "PushEvent", None, T)])
    hours = cal.hours_between(spark, "2025-01-01-00", "2025-01-01-00")
    first = firsts(spark, [(1, utc("2024-12-31T23:00")), (2, utc("2025-01-01T01:00"))])
    found = series.hourly_series(series.hourly_activity(raw), entities(spark, 1, 2), first, hours)
    assert found.columns == ["repo_id", "repo_name", "metric", "unique_id", "ds", "y"]
    assert sorted((r.unique_id, r.y) for r in found.collect()) == [
        ("1:issues_opened", 0), ("1:prs_opened", 0), ("1:pushes", 0), ("1:stars", 0)
    ]


def test_counts(spark):
    events = [
        (1, "WatchEvent", "started", T),
        (1, "PullRequestEvent", "opened", T),
        (1, "PullRequestEvent", "closed", T),
        (1, "IssuesEvent", "opened", T),
        (1, "PushEvent", None, T),
        (1, "PushEvent", None, T),
        (1, "ForkEvent", None, T),
        (None, "PushEvent", None, T),
    ]
    raw = raw_events(spark, events)
    raw = raw.unionByName(raw.where("event_id = 4"))  # a repeated event id counts again
    (row,) = series.hourly_activity(raw).collect()
    assert (row.stars, row.prs_opened, row.issues_opened, row.pushes, row.n_events) == (1, 1, 1, 3, 7)
    sparse = series.hourly_counts(raw)
    assert sorted((r.unique_id, r.y) for r in sparse.collect()) == [
        ("1:issues_opened", 1), ("1:prs_opened", 1), ("1:pushes", 3), ("1:stars", 1)
    ]


@pytest.fixture(scope="module")
def busy(spark):
    """Events of three entities over 40 days; entity 3 starts at 23:00 of day five."""
    events = [(1, "PushEvent", None, T + i * 5 * H) for i in range(190)]
    events += [(2, "WatchEvent", None, T + i * 31 * H) for i in range(30)]
    events += [(3, "IssuesEvent", "opened", T + dt.timedelta(days=4, hours=23) + i * 50 * H) for i in range(15)]
    raw = raw_events(spark, events)
    activity = series.hourly_activity(raw)
    hours = cal.hours_between(spark, "2025-01-01-00", "2025-02-09-23")
    return raw, activity, entities(spark, 1, 2, 3), series.first_activity(activity), hours


@pytest.mark.parametrize("freq", ["daily", "weekly", "monthly"])
def test_sparse_late_equals_dense_early(spark, busy, freq):
    _, activity, ents, first, hours = busy
    dense = series.hourly_series(activity, ents, first, hours)
    expected = rows(series.rollup_series(dense, hours, freq))
    assert rows(series.period_series(activity, ents, first, hours, freq)) == expected
    assert expected


def test_late_start_is_in_its_day(spark, busy):
    _, activity, ents, first, hours = busy
    daily = series.period_series(activity, ents, first, hours, "daily").where("unique_id = '3:stars'")
    assert daily.agg(F.min("ds").cast("timestamp_ntz")).first()[0] == dt.datetime(2025, 1, 5)


def test_gaps_in_ledger(spark, busy):
    _, activity, ents, first, hours = busy
    # Day 2 loses three hours (21/24 < .90), day 3 loses two (22/24 >= .90).
    gone = [utc(f"2025-01-02T{h:02d}:00") for h in (1, 2, 3)] + [utc(f"2025-01-03T{h:02d}:00") for h in (22, 23)]
    hours = hours.where(~F.col("hour").isin(gone))
    status = series.completeness(hours, "daily")
    refused = status.where("NOT is_complete")
    assert [(r[4].day, r[5], r[6]) for r in rows(refused)] == [(2, 21, 24)]
    assert series.completeness_message(refused).first().error == "Data completeness (87.50%) too low: found 21/24 hours"
    dense = series.hourly_series(activity, ents, first, hours)
    daily = series.period_series(activity, ents, first, hours, "daily")
    assert rows(daily) == rows(series.rollup_series(dense, hours, "daily"))
    weekly = series.completeness(hours, "weekly")
    assert [r[8] for r in rows(weekly.where("ds = TIMESTAMP'2025-01-12 00:00:00'"))] == [True]
    assert not weekly.where("ds = TIMESTAMP'2025-01-05 00:00:00'").first().is_complete  # 115 of 168


def test_first_events(spark, busy):
    raw, activity, ents, first, _ = busy
    assert rows(series.first_events(raw, ents)) == rows(first)
    assert rows(series.first_events(raw, entities(spark, 3))) == [(3, dt.datetime(2025, 1, 5, 23))]


def test_empty_ledger(spark, busy):
    _, activity, ents, first, hours = busy
    none = hours.where("false")
    assert series.hourly_series(activity, ents, first, none).count() == 0
    assert series.period_series(activity, ents, first, none, "daily").count() == 0


def test_a_repeated_entity_is_refused(spark):
    ents = spark.createDataFrame([(1, "a/b"), (1, "a/c"), (2, "x/y")], "repo_id BIGINT, repo_name STRING")
    with pytest.raises(Exception, match="repeated entity: 1"):
        series.unique_entities(ents).select("repo_id").collect()
    assert rows(series.unique_entities(ents.where("repo_name <> 'a/c'"))) == [(1, "a/b"), (2, "x/y")]


def test_names_as_of_the_last_hour(spark):
    data = [(1, "old", "2026-01-01T05:00:00", 1), (1, "new", "2026-01-02T20:10:00", 2), (1, "old", "2026-01-02T20:05:00", 2), (2, "x", "2026-01-03T00:00:00", 3)]
    raw = spark.createDataFrame([(i, n, t, 2026, 1, d, int(t[11:13])) for i, n, t, d in data], "repo_id BIGINT, repo_name STRING, created_at STRING, year INT, month INT, day INT, hour INT")
    names = series.name_history(raw)
    assert rows(names.select("repo_id", "repo_name", F.hour("since"), F.hour("until")), "repo_id", "repo_name") == [(1, "new", 20, None), (1, "old", 5, 20), (2, "x", 0, None)]
    panel = spark.createDataFrame([(i, "first", utc(f"2026-01-0{d}")) for i in (1, 2) for d in (1, 2, 3)], "repo_id BIGINT, repo_name STRING, ds TIMESTAMP")
    found = rows(series.with_names(panel, names, "daily").select("repo_id", F.dayofmonth("ds"), "repo_name"))
    assert found == [(1, 1, "old"), (1, 2, "new"), (1, 3, "new"), (2, 1, "first"), (2, 2, "first"), (2, 3, "x")]


def test_dense_rows_stay_with_their_entity(spark, tmp_path):
    """Sparse counts are shuffled by entity; dense hours and their period sums are not shuffled again."""
    raw = raw_events(spark, [(i % 5, "PushEvent", None, T + (7 * i % 48) * H) for i in range(60)])
    hours = cal.hours_between(spark, "2025-01-01-00", "2025-01-02-23").where(F.hour("hour") != 3)
    path = str(tmp_path / "activity")
    series.hourly_activity(raw).write.parquet(path)
    activity = spark.read.parquet(path)
    dense = series.hourly_series(activity, entities(spark, *range(5)), series.first_activity(activity), hours)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = series.rollup_series(dense, hours, "daily")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(repo_id#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\([^)]*repo_id#\d+L?, [a-z]|hashpartitioning\([a-z]+#\d+L?, repo_id", plan)
    assert dense.count() == dense.select("unique_id", "ds").distinct().count() == dense.where("hour(ds) <> 3").count()
    kept = activity.where("hour(event_hour) <> 3").agg(F.sum("pushes")).first()[0]
    assert dense.agg(F.sum("y")).first()[0] == kept


def test_hours_off_the_grid_of_an_entity(spark):
    """Repeated hours stay repeated, hours before the first one and of other entities do not count, null hours neither."""
    counts = "repo_id BIGINT, event_hour TIMESTAMP, stars BIGINT, prs_opened BIGINT, issues_opened BIGINT, pushes BIGINT"
    at = lambda h: utc(f"2025-01-01T{h:02d}:00")
    seen = [(1, at(0), 9, 0, 0, 0), (1, at(2), 1, 0, 0, 0), (1, at(2), 2, 0, 0, 0), (1, None, 5, 0, 0, 0), (3, at(2), 7, 0, 0, 0), (None, at(2), 8, 0, 0, 0)]
    hours = cal.hours_between(spark, "2025-01-01-00", "2025-01-01-03")
    first = firsts(spark, [(1, at(1)), (2, at(2)), (4, utc("2025-01-01T01:30"))])
    dense = series.hourly_series(spark.createDataFrame(seen, counts), entities(spark, 1, 2, 4), first, hours)
    stars = sorted((r.repo_id, r.ds.hour, r.y) for r in dense.where("metric = 'stars'").collect())
    assert stars == [(1, 1, 0), (1, 2, 1), (1, 2, 2), (1, 3, 0), (2, 2, 0), (2, 3, 0)]
