import random

import numpy as np
import pandas as pd
import pytest
from helpers import panel_of
from pyspark.sql import functions as F

from panelspark.operators import evaluation as ev
from panelspark.operators import forecasting as fc

CUTOFFS = ["2026-01-16", "2026-01-23"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(11)
    series = {f"{i}:{m}": [rng.choice([0, 0, 1, 3, 12]) for _ in range(30)] for i in range(8) for m in ("stars", "pushes")}
    series["z:stars"] = [0] * 30
    series["c:stars"] = [5] * 30
    return panel_of(spark, series)


@pytest.fixture(scope="module")
def forecasts(panel):
    return fc.forecast_native(panel, CUTOFFS, "daily", window=14).cache()


def status_of(status, model="zero_model"):
    return {r.cutoff.day: r.status for r in status.where(F.col("model") == model).collect()}


def test_against_pandas(panel, forecasts):
    metrics, status = ev.evaluate(forecasts, panel, CUTOFFS, "daily", 14)
    assert {r.status for r in status.collect()} == {"ok"} and status.count() == 6
    assert metrics.columns == list(ev.METRIC_COLUMNS)
    found = metrics.toPandas().set_index(["model", "cutoff", "unique_id"])
    data, fcst = panel.toPandas(), forecasts.toPandas()
    assert len(found) == 3 * 2 * 18
    for (model, cutoff, uid), f in fcst.groupby(["model", "cutoff", "unique_id"]):
        y = data[data.unique_id == uid].set_index("ds").y.sort_index()
        past = y[y.index <= cutoff].iloc[-14:]
        f = f.set_index("ds")
        actual = y.reindex(f.index)
        scale = max(past.diff().abs().mean(), 0.01)
        mase = (actual - f.yhat).abs().mean() / scale
        losses = []
        for q in range(10, 100, 10):
            d = f[f"q_{q}"] - actual
            losses.append(np.maximum(q / 100 * d, (q / 100 - 1) * d).sum())
        crps = 2 * np.mean(losses) / max(past.abs().mean(), 1.0)
        row = found.loc[(model, pd.Timestamp(cutoff).strftime("%Y-%m-%d-%H"), uid)]
        assert row.mase == pytest.approx(mase) and row.scaled_crps == pytest.approx(crps)
        assert row.subdataset == uid.split(":")[1] and row.frequency == "daily"


def test_parts_agree(panel, forecasts):
    from panelspark.operators import windows

    joined = ev.join_actuals(forecasts, windows.actuals(panel, CUTOFFS, "daily"))
    scales = ev.train_scales(panel, CUTOFFS, "daily", 14)
    metrics, _ = ev.evaluate(forecasts, panel, CUTOFFS, "daily", 14)
    total = metrics.agg(F.sum("mase").alias("m"), F.sum("scaled_crps").alias("c")).first()
    assert ev.mase(joined, scales).agg(F.sum("mase")).first()[0] == pytest.approx(total.m)
    assert ev.scaled_crps(joined, scales).agg(F.sum("scaled_crps")).first()[0] == pytest.approx(total.c)
    twice_mean = ev.quantile_loss(joined).groupBy(*ev.SERIES).agg((F.avg("loss") * 2).alias("c"))
    parts = twice_mean.join(scales, ["cutoff", "unique_id"]).agg(F.sum(F.col("c") / F.col("crps_scale"))).first()[0]
    assert parts == pytest.approx(total.c)


def test_pinball_conventions(spark):
    from panelspark.functions.scoring import pinball

    df = spark.createDataFrame([(0.0, 3.0), (5.0, 6.0), (10.0, 9.0)], "y DOUBLE, f DOUBLE").coalesce(1)
    # Losses of the two conventions at level 0.9.
    for convention, expected in (("reference", [2.7, 0.9, 0.1]), ("standard", [0.3, 0.1, 0.9])):
        found = [r[0] for r in df.select(pinball(F.col("y"), F.col("f"), 90, convention)).collect()]
        assert found == pytest.approx(expected)
    with pytest.raises(ValueError):
        pinball(F.col("y"), F.col("f"), 90, "other")


@pytest.mark.parametrize("gaps,expected", [(4, "ok"), (5, "null_values"), (6, "null_values")])
def test_quantile_gaps(spark, gaps, expected):
    """Gaps are filled below five percent of 100 rows, and not at five percent."""
    series = {f"{i:02d}:x": [1, 2] + [i] * 5 for i in range(20)}
    panel = panel_of(spark, series)
    rows = fc.forecast_native(panel, ["2026-01-02"], "daily", ["historic_average"], h=5, window=2)
    rows = rows.withColumn("q_70", F.when(F.col("unique_id") >= f"{gaps:02d}:x", F.col("q_70")).when(F.dayofmonth("ds") > 3, F.col("q_70")))
    metrics, status = ev.evaluate(rows, panel, ["2026-01-02"], "daily", 2, 5)
    row = status.first()
    assert (row.n_fill, row.n_rows, row.status) == (gaps, 100, expected)
    if expected == "ok":
        filled = rows.withColumn("q_70", F.coalesce("q_70", "yhat"))
        same, _ = ev.evaluate(filled, panel, ["2026-01-02"], "daily", 2, 5)
        expected = {r.unique_id: r.scaled_crps for r in same.collect()}
        assert {r.unique_id: r.scaled_crps for r in metrics.collect()} == pytest.approx(expected)
    else:
        assert metrics.count() == 0


def test_leakage(panel, forecasts):
    early = forecasts.where("model = 'zero_model'")
    at_cutoff = early.withColumn("ds", F.expr("ds - INTERVAL 1 DAY"))
    assert [r.leaks for r in ev.leakage(at_cutoff).collect()] == [False, False]
    before = early.unionByName(early.where("cutoff = TIMESTAMP'2026-01-16'").limit(1).withColumn("ds", F.lit("2026-01-15").cast("timestamp")))
    metrics, status = ev.evaluate(before, panel, CUTOFFS, "daily", 14)
    assert status_of(status) == {16: "leakage", 23: "ok"}
    assert {r.cutoff for r in metrics.select("cutoff").distinct().collect()} == {"2026-01-23-00"}


def test_actual_without_forecast(panel, forecasts):
    fewer = forecasts.where("NOT (model = 'zero_model' AND unique_id = 'z:stars' AND cutoff = TIMESTAMP'2026-01-16')")
    _, status = ev.evaluate(fewer, panel, CUTOFFS, "daily", 14)
    assert status_of(status) == {16: "null_values", 23: "ok"}
    assert status_of(status, "seasonal_naive") == {16: "ok", 23: "ok"}
    metrics, status = ev.evaluate(fewer, panel, CUTOFFS, "daily", 14, on_unmatched="drop")
    assert status_of(status) == {16: "ok", 23: "ok"}
    assert metrics.where("model = 'zero_model' AND cutoff = '2026-01-16-00'").count() == 17
    with pytest.raises(ValueError, match="null_values"):
        ev.evaluate(fewer, panel, CUTOFFS, "daily", 14, strict=True)
    # A repeated row must not hide a missing one.
    doubled = fewer.unionByName(fewer.where("model = 'zero_model' AND unique_id = 'c:stars' AND cutoff = TIMESTAMP'2026-01-16'"))
    _, status = ev.evaluate(doubled, panel, CUTOFFS, "daily", 14)
    assert status_of(status)[16] == "null_values"


def test_series_only_in_history(spark, panel, forecasts):
    gone = panel.where("NOT (unique_id = 'z:stars' AND ds > TIMESTAMP'2026-01-16')")
    _, status = ev.evaluate(forecasts, gone, CUTOFFS[:1], "daily", 14)
    assert status_of(status.where("cutoff = TIMESTAMP'2026-01-16'")) == {16: "nan_metrics"}


def test_single_observation(spark):
    panel = panel_of(spark, {"a:x": [1] * 21, "b:x": [None] * 13 + [1] * 8})
    rows = fc.forecast_native(panel, ["2026-01-14"], "daily", ["zero_model"], window=7)
    metrics, status = ev.evaluate(rows, panel, ["2026-01-14"], "daily", 7)
    assert status_of(status) == {14: "nan_metrics"} and metrics.count() == 0


def test_missing_periods(panel, forecasts):
    _, status = ev.evaluate(forecasts, panel, CUTOFFS, "daily", 20)
    assert status_of(status) == {16: "missing_history", 23: "ok"}
    short = panel.where("ds <= TIMESTAMP'2026-01-25'")
    _, status = ev.evaluate(forecasts, short, CUTOFFS, "daily", 14)
    assert status_of(status) == {16: "ok", 23: "missing_actuals"}
    none = panel.where("ds <= TIMESTAMP'2026-01-23'")
    _, status = ev.evaluate(forecasts, none, CUTOFFS, "daily", 14)
    assert status_of(status) == {16: "ok", 23: "no_actuals"}


def test_no_quantiles(panel, forecasts):
    empty = {f"q_{q}": F.lit(None).cast("double") for q in range(10, 100, 10)}
    _, status = ev.evaluate(forecasts.withColumns(empty), panel, CUTOFFS, "daily", 14)
    assert status_of(status) == {16: "no_quantiles", 23: "no_quantiles"}


def test_long_horizon(spark):
    """Beyond 63 steps the actuals are joined by time; the scores are the same."""
    panel = panel_of(spark, {f"{i}:x": [(7 * i + d * d) % 11 for d in range(120)] for i in range(3)})
    cutoff = ["2026-01-20"]
    rows = fc.forecast_native(panel, cutoff, "daily", ["historic_average"], h=70, window=10)
    metrics, status = ev.evaluate(rows, panel, cutoff, "daily", 10, 70)
    assert (status.first().status, status.first().n_matched) == ("ok", 210)
    data = panel.toPandas()
    for r in metrics.collect():
        y = data[data.unique_id == r.unique_id].sort_values("ds").y.tolist()
        past, actual = y[10:20], y[20:90]
        scale = np.mean(np.abs(np.diff(past)))
        assert r.mase == pytest.approx(np.mean([abs(a - np.mean(past)) for a in actual]) / scale)
    short, _ = ev.evaluate(rows.where("ds <= TIMESTAMP'2026-02-09'"), panel, cutoff, "daily", 10, 20)
    assert short.count() == 3


def test_forecast_off_the_grid(panel, forecasts):
    """A forecast at another time of day is no forecast of that day."""
    moved = forecasts.withColumn("ds", F.when(F.col("unique_id") == "z:stars", F.expr("ds + INTERVAL 1 HOUR")).otherwise(F.col("ds")))
    _, status = ev.evaluate(moved, panel, CUTOFFS, "daily", 14)
    assert set(status_of(status).values()) == {"null_values"}


def test_actuals_are_not_sent_to_every_task(spark):
    """Actuals are as many as the series, however small their files are."""
    forecasts = spark.range(1).selectExpr("TIMESTAMP'2026-01-01' AS cutoff", "string(id) AS unique_id", "TIMESTAMP'2026-01-02' AS ds", "1.0 AS yhat")
    joined = ev.join_actuals(forecasts, forecasts.withColumnRenamed("yhat", "y"))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.first().y == 1


def test_forecasts_are_not_sorted(spark, panel, forecasts, tmp_path):
    """Forecasts are wide and many; a partition's actuals and scales are few, and as many as the series, however small their files are."""
    panel.write.parquet(str(tmp_path / "panel"))
    stored = spark.read.parquet(str(tmp_path / "panel"))
    scores = ev.series_scores(forecasts, stored, CUTOFFS, "daily", 14)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan
    assert scores.where("mase IS NOT NULL").count() == forecasts.select("model", "cutoff", "unique_id").distinct().count()
