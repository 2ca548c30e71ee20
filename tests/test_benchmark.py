"""The stored pipeline end to end, on small archive files."""

import datetime as dt
import gzip
import json
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import series
from panelspark.plans.benchmark import Benchmark
from panelspark.sources import tables

START = dt.datetime(2024, 1, 1)
KINDS = [("PushEvent", None), ("WatchEvent", None), ("IssuesEvent", "opened"), ("PullRequestEvent", "opened"), ("ForkEvent", None)]
CUTOFFS = ["2024-01-08", "2024-01-15"]


def write_hours(folder, first, count):
    for i in range(first, first + count):
        at = START + dt.timedelta(hours=i)
        rng = random.Random(i)
        with gzip.open(folder / f"{at:%Y-%m-%d}-{at.hour}.json.gz", "wt") as f:
            for n in range(12):
                kind, action = rng.choice(KINDS)
                repo = 0 if n < 4 else rng.randrange(6)  # one entity holds a third of the events
                f.write(json.dumps({
                    "id": f"{i}-{n}", "type": kind, "created_at": f"{at:%Y-%m-%dT%H}:00:00Z",
                    "repo": {"id": repo, "name": f"r{repo}"}, "payload": {"action": action},
                }) + "\n")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    src = tmp_path_factory.mktemp("archive")
    write_hours(src, 0, 15 * 24)
    return src, tmp_path_factory.mktemp("bench")


@pytest.fixture(scope="module")
def bench(spark, folders):
    src, root = folders
    b = Benchmark(spark, str(root))
    b.ingest(str(src))
    b.select_entities(
        2024, unit="week", active_from=dt.datetime(2024, 1, 1, tzinfo=cal.UTC),
        active_to=dt.datetime(2024, 1, 15, tzinfo=cal.UTC), required_active=2, top_share=0.0,
    )
    b.build_hourly()
    b.build_series("daily")
    return b


def test_layers(spark, bench):
    assert bench.stored_hours().count() == 15 * 24
    ids = {r.repo_id for r in bench.table("entities").collect()}
    assert ids and ids <= set(range(6))
    assert {r.repo_id for r in bench.table("first_events").collect()} == ids
    panel = bench.table("series")
    assert panel.where("frequency = 'daily'").count() == 15 * 4 * len(ids)
    # The stored series equal those made straight from the raw events.
    hours = bench.stored_hours().select("hour")
    activity = series.hourly_activity(bench.table("raw"))
    direct = series.period_series(activity, bench.table("entities"), bench.table("first_events"), hours, "daily")
    assert rows(panel.select(*direct.columns)) == rows(direct)
    plan = tables.read_series(spark, bench.path("series"), "daily", "2024-01-03", "2024-01-04")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(frequency" in plan and "ds_date" in plan


def test_forecast_evaluate_leaderboard(spark, bench, folders):
    src, _ = folders
    assert bench.run_forecasts("daily", CUTOFFS[:1], window=7).count() == 0
    status = bench.run_evaluations("daily", CUTOFFS[:1], window=7)
    assert {r.status for r in status.collect()} == {"ok"}
    bench.build_sparsity(2024)
    gaps = bench.build_leaderboard().first()
    assert gaps.total > 0
    first = rows(bench.metrics())

    # New hours arrive; only missing keys are made, stored ones stay as they are.
    write_hours(src, 15 * 24, 8 * 24)
    ledger = bench.refresh_raw(str(src), "2024-01-01-00", "2024-01-23-23")
    assert rows(ledger.groupBy("status").count()) == [("ok", 23 * 24)]
    bench.build_hourly()
    assert bench.build_series("daily").count() == 8
    bench.run_forecasts("daily", CUTOFFS, window=7)
    keys = bench.forecasts("daily").select("model", "cutoff").distinct()
    assert keys.count() == 6
    status = bench.run_evaluations("daily", CUTOFFS, window=7)
    assert {(r.cutoff.day, r.status) for r in status.collect()} == {(15, "ok")}
    metrics = rows(bench.metrics())
    assert set(first) < set(metrics) and len(metrics) == 2 * len(first)
    assert bench.build_leaderboard().first().total == 2 * gaps.total
    ordered = [r.cutoff for r in bench.table("leaderboard").collect()]
    assert len(ordered) == 2 * gaps.total


def test_refresh_of_touched_hours(spark, bench):
    before = rows(bench.panel("daily"))
    touched = bench.stored_hours().select("hour").where("hour < TIMESTAMP'2024-01-02 05:00:00'")
    status = bench.build_series("daily", touched=touched)
    assert [r[0].day for r in rows(status.select("ds"))] == [1, 2]
    assert rows(bench.panel("daily")) == before


def test_stored_forecast_lookup(spark, bench):
    found = tables.read_forecasts(spark, bench.path("forecasts"), "daily", "zero_model", CUTOFFS[0])
    assert found.agg(F.count_distinct("ds")).first()[0] == 7
    with pytest.raises(FileNotFoundError, match="historic_average"):
        tables.read_forecasts(spark, bench.path("forecasts"), "daily", "no_model", CUTOFFS[0])


def test_validation_and_catalog(spark, bench):
    ledger = bench.validate_series("daily", "2024-01-01", "2024-01-25")
    counts = {r.status: r["count"] for r in ledger.groupBy("status").count().collect()}
    assert counts == {"ok": 23, "missing": 2}
    tables.register_table(spark, "stored_series", bench.path("series"))
    found = spark.sql("SELECT count(*) AS n FROM stored_series WHERE frequency = 'daily' AND ds_date = DATE'2024-01-03'")
    assert found.first().n == bench.panel("daily").where("ds = TIMESTAMP'2024-01-03'").count() > 0
    spark.sql("DROP TABLE stored_series")


def test_stream(spark, bench, folders, tmp_path):
    """A benchmark fed by the stream equals one built in batches, also after late hours."""
    src, _ = folders
    streamed = Benchmark(spark, str(tmp_path / "streamed"))
    tables.write_table(bench.table("entities"), streamed.path("entities"))
    landing = tmp_path / "landing"
    landing.mkdir()
    late = f"{START:%Y-%m-%d}-7.json.gz"
    files = sorted(p.name for p in src.iterdir())
    first_day = [f for f in files if f.startswith("2024-01-01-")]
    second_day = [f for f in files if f.startswith("2024-01-02-")]

    def land(names):
        for name in names:
            (landing / name).write_bytes((src / name).read_bytes())
        streamed.stream(str(landing)).awaitTermination()

    def days(b):
        return rows(b.panel("daily").where("ds < TIMESTAMP'2024-01-03'"))

    land([f for f in first_day if f != late])
    assert streamed.stored_hours().count() == 23
    land([late, *second_day])
    assert streamed.stored_hours().count() == 48
    assert days(streamed) == days(bench) != []
    assert rows(streamed.table("first_events")) == rows(bench.table("first_events"))


def test_guards_of_single_cutoffs(spark, bench):
    """Cutoffs that fail a guard are reported; the others go on, and stored keys are left alone."""
    failed = bench.run_forecasts("daily", ["2024-01-03", "2024-01-12", CUTOFFS[0]], models=["zero_model"], window=7)
    assert [(r.model, r.key, r.error) for r in failed.select("model", cal.hour_key(F.col("cutoff")).alias("key"), "error").collect()] == [
        ("zero_model", "2024-01-03-00", "missing_history")
    ]
    keys = bench.forecasts("daily").where("model = 'zero_model'").select(cal.hour_key(F.col("cutoff")).alias("key")).distinct()
    assert rows(keys) == [("2024-01-08-00",), ("2024-01-12-00",), ("2024-01-15-00",)]
    with pytest.raises(ValueError):
        bench.run_forecasts("daily", ["2024-01-03-05"], window=2)


def test_only_missing_keys_are_fitted(spark, tmp_path, bench):
    """Two models, two cutoffs, two keys stored: the other two are fitted and no more."""
    from panelspark.operators import forecasting

    calls = tmp_path / "calls"
    calls.mkdir()

    def make(name):
        def fn(history, h, freq, quantiles):
            import uuid

            import pandas as pd

            last = history["ds"].max()
            (calls / f"{name}.{last:%m%d}.{uuid.uuid4().hex}").write_text("")
            ds = pd.date_range(last, periods=h + 1, freq="D")[1:]
            return pd.DataFrame({"ds": ds, "yhat": 1.0, **{f"q_{q}": 1.0 for q in quantiles}})

        return fn

    for name in ("first", "second"):
        forecasting.register_model(name, name.title(), fn=make(name))
    series_count = bench.panel("daily").select("unique_id").distinct().count()
    bench.run_forecasts("daily", CUTOFFS[:1], models=["first"], window=7)
    bench.run_forecasts("daily", CUTOFFS[1:], models=["second"], window=7)
    before = {p.name for p in calls.iterdir()}
    bench.run_forecasts("daily", CUTOFFS, models=["first", "second"], window=7)
    new = sorted(p.name.rsplit(".", 1)[0] for p in calls.iterdir() if p.name not in before)
    assert new == sorted(["first.0115"] * series_count + ["second.0108"] * series_count)


def test_failed_rescore_removes_metrics(spark, bench):
    """Metrics of a key that fails its guard on a second scoring go."""
    key = "model = 'zero_model' AND cutoff LIKE '2024-01-08%'"
    assert bench.metrics().where(key).count() > 0
    rows_ = bench.forecasts("daily").where("model = 'zero_model'").where(cal.hour_key(F.col("cutoff")) == "2024-01-08-00")
    kept = spark.createDataFrame(rows_.toPandas(), rows_.schema)
    tables.write_partitions(kept.withColumn("yhat", F.lit(None).cast("double")), bench.path("forecasts"), ["frequency", "model", "cutoff"])
    status = bench.run_evaluations("daily", CUTOFFS[:1], models=["zero_model"], window=7, overwrite=True)
    assert [r.status for r in status.collect()] == ["null_values"]
    assert bench.metrics().where(key).count() == 0 and bench.metrics().count() > 0


def archive_file(folder, day, hour, events):
    with gzip.open(folder / f"2024-01-{day:02d}-{hour}.json.gz", "wt") as f:
        for n, repo in enumerate(events):
            f.write(json.dumps({
                "id": f"{day}-{hour}-{n}-{len(events)}", "type": "WatchEvent", "created_at": f"2024-01-{day:02d}T{hour:02d}:00:00Z",
                "repo": {"id": repo, "name": f"r{repo}"}, "payload": {},
            }) + "\n")


@pytest.fixture()
def week(tmp_path):
    """Six days of hour files; entity 1 in all hours, entity 2 from day 5 on."""
    folder = tmp_path / "week"
    folder.mkdir()
    for day in range(1, 7):
        for hour in range(24):
            archive_file(folder, day, hour, [1, 2] if day >= 5 else [1])
    return folder


def from_scratch(spark, folder, root, entities):
    b = Benchmark(spark, str(root))
    b.ingest(str(folder))
    tables.write_table(entities, b.path("entities"))
    b.find_first_events()
    b.build_hourly()
    b.build_series("daily")
    return b


def test_late_and_replaced_hours(spark, week, tmp_path):
    """A stream with an earlier first event, an emptied hour and a refused hour equals a build in one go."""
    entities = spark.createDataFrame([(1, "r1"), (2, "r2")], "repo_id BIGINT, repo_name STRING")
    streamed = Benchmark(spark, str(tmp_path / "streamed"))
    tables.write_table(entities, streamed.path("entities"))
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(names):
        for name in names:
            (landing / name).write_bytes((week / name).read_bytes())
        streamed.stream(str(landing)).awaitTermination()

    late = "2024-01-02-3.json.gz"
    archive_file(week, 2, 3, [1, 2])  # entity 2 in fact began on day 2
    land(sorted(p.name for p in week.iterdir() if p.name != late))
    land([late])
    whole = from_scratch(spark, week, tmp_path / "whole", entities)
    assert rows(streamed.panel("daily")) == rows(whole.panel("daily"))
    assert streamed.panel("daily").where("unique_id = '2:stars'").count() == 5

    archive_file(week, 3, 4, [9])  # replaced by a file without entity events
    (landing / "again").mkdir()
    (landing / "again" / "2024-01-03-4.json.gz").write_bytes((week / "2024-01-03-4.json.gz").read_bytes())
    streamed.stream(str(landing)).awaitTermination()
    again = from_scratch(spark, week, tmp_path / "again", entities)
    assert rows(streamed.panel("daily")) == rows(again.panel("daily"))
    assert rows(streamed.table("raw").select("event_id")) == rows(again.table("raw").select("event_id"))
    assert streamed.stored_hours().count() == 144

    with gzip.open(landing / "again" / "2024-01-04-1.json.gz", "wt") as f:
        f.write('{"id": "x", broken\n')
    streamed.stream(str(landing)).awaitTermination()
    assert rows(streamed.panel("daily")) == rows(again.panel("daily"))  # the hour keeps what it had
    assert rows(streamed.refused_hours().select(cal.hour_key(F.col("hour")))) == [("2024-01-04-01",)]


def test_builds_read_only_their_days(spark, bench):
    """One day's rebuild prunes the raw and hourly layers by partition."""
    hours = bench.stored_hours().select("hour").where("hour >= TIMESTAMP'2024-01-03' AND hour < TIMESTAMP'2024-01-04'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for df in (bench._raw_of(hours), bench._activity(hours)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters: [") :].split("PushedFilters")[0]
        assert "make_date(year" in filters and "2024-01-03" in filters
