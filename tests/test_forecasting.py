import datetime as dt
import sys
from statistics import NormalDist, pstdev, stdev

import pandas as pd
import pytest
from helpers import panel_of, rows
from pyspark import cloudpickle

from panelspark.functions import calendar as cal
from panelspark.operators import forecasting as fc

cloudpickle.register_pickle_by_value(sys.modules[__name__])

A = [3, 0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9]
B = [None] * 10 + [2, 2, 7, 1]
CUTOFF = ["2026-01-14"]


@pytest.fixture(scope="module")
def panel(spark):
    return panel_of(spark, {"a:x": A, "b:x": B})


def by_step(df, uid):
    found = df.where(f"unique_id = '{uid}'").orderBy("ds").collect()
    assert [r.ds.day for r in found] == [15, 16, 17, 18, 19, 20, 21][: len(found)]
    return found


def test_zero(panel):
    found = by_step(fc.forecast_native(panel, CUTOFF, "daily", ["zero_model"], window=14), "a:x")
    assert all((r.yhat, r.q_10, r.q_90) == (0, 0, 0) for r in found) and len(found) == 7


def test_historic_average(panel):
    found = by_step(fc.forecast_native(panel, CUTOFF, "daily", ["historic_average"], window=14), "a:x")
    mean, sd = sum(A) / 14, stdev(A) * (1 + 1 / 14) ** 0.5
    for r in found:
        assert r.yhat == pytest.approx(mean)
        assert r.q_50 == pytest.approx(mean)
        assert r.q_90 == pytest.approx(mean + NormalDist().inv_cdf(0.9) * sd)
        assert r.q_10 == pytest.approx(mean - NormalDist().inv_cdf(0.9) * sd)


def test_seasonal_naive(panel):
    df = fc.forecast_native(panel, CUTOFF, "daily", ["seasonal_naive"], h=10, window=14)
    found = df.where("unique_id = 'a:x'").orderBy("ds").collect()
    assert [r.yhat for r in found] == A[-7:] + A[-7:-4]
    sd = (sum((b - a) ** 2 for a, b in zip(A, A[7:])) / 7) ** 0.5
    z = NormalDist().inv_cdf(0.8)
    assert found[0].q_80 - found[0].yhat == pytest.approx(z * sd)
    assert found[8].q_80 - found[8].yhat == pytest.approx(z * sd * 2**0.5)
    # Shorter than a season: no forecast, as a null and not as a guess.
    assert all(r.yhat is None for r in df.where("unique_id = 'b:x'").collect())


def test_weekly_and_monthly_steps(spark):
    weekly = panel_of(spark, {"a:x": [1, 2, 3]}, "2026-01-04", "W-SUN")
    (row,) = fc.forecast_native(weekly, ["2026-01-18"], "weekly", ["seasonal_naive"], window=2).collect()
    assert (row.ds.date(), row.yhat) == (dt.date(2026, 1, 25), 3.0)
    monthly = panel_of(spark, {"a:x": list(range(24))}, "2024-01-01", "MS")
    (row,) = fc.forecast_native(monthly, ["2025-12-01"], "monthly", ["seasonal_naive"]).collect()
    assert (row.ds.date(), row.yhat) == (dt.date(2026, 1, 1), 12.0)


def test_registry():
    with pytest.raises(ValueError, match="Unknown model"):
        fc.get_model("no_such_model")
    with pytest.raises(ValueError):
        fc.register_model("zero_model", native=lambda f: None)
    with pytest.raises(ValueError):
        fc.register_model("both")
    assert set(fc.BASELINES) <= set(fc.model_names())


def steps(past, h):
    return [past["ds"].iloc[-1] + pd.Timedelta(days=k) for k in range(1, h + 1)]


def spread_model(past, h, freq, quantiles):
    sd = pstdev(past["y"].tolist())
    out = pd.DataFrame({"ds": steps(past, h), "yhat": float(past["y"].mean())})
    for q in quantiles:
        out[f"q_{round(100 * q)}"] = out["yhat"] + NormalDist().inv_cdf(q) * sd
    return out


def point_model(past, h, freq, quantiles=None):
    if quantiles is not None:
        raise ValueError("no quantiles")
    return pd.DataFrame({"ds": steps(past, h), "yhat": float(past["y"].iloc[-1])})


def broken_model(past, h, freq, quantiles=None):
    if len(past) < 10:
        raise RuntimeError("too short")
    return point_model(past, h, freq)


@pytest.fixture
def models():
    names = {"spread": spread_model, "point": point_model, "broken": broken_model}
    for name, fn in names.items():
        fc.register_model(name, name.title(), fn=fn)
    yield names
    for name in names:
        fc.unregister_model(name)


def test_pandas_models(panel, models):
    out, failed = fc.forecast(panel, CUTOFF + ["2026-01-10"], "daily", ["zero_model", *models], window=14)
    # The broken model fails on series b only, which loses its cutoff but not the other one.
    assert [(r.model, r.cutoff.day, r.n_failed) for r in failed.collect()] == [("broken", 14, 1)]
    assert "too short" in failed.first().error
    counts = {(r.model, r.cutoff.day): r["count"] for r in out.groupBy("model", "cutoff").count().collect()}
    assert counts == {
        ("zero_model", 10): 7, ("zero_model", 14): 14, ("spread", 10): 7, ("spread", 14): 14,
        ("point", 10): 7, ("point", 14): 14, ("broken", 10): 7,
    }
    point = out.where("model = 'point' AND cutoff = TIMESTAMP'2026-01-14'").collect()
    assert {r.unique_id: r.yhat for r in point} == {"a:x": 9.0, "b:x": 1.0}
    assert all(r.q_50 is None for r in point)
    spread = out.where("model = 'spread' AND unique_id = 'a:x' AND cutoff = TIMESTAMP'2026-01-14'").first()
    assert spread.model_alias == "Spread"
    assert spread.q_90 == pytest.approx(sum(A) / 14 + NormalDist().inv_cdf(0.9) * pstdev(A))


def test_one_shuffle_for_all_cutoffs(panel, models):
    """Windows are cut in the task: the plan is the same for one cutoff and for ten."""
    days = [f"2026-01-{d:02d}" for d in range(5, 15)]
    plans = [fc.forecast_pandas(panel, c, "daily", "point", window=3)._jdf.queryExecution().executedPlan().toString() for c in (days[:1], days)]
    assert all(p.count("Exchange") == 1 and "Generate" not in p and "Join" not in p for p in plans)
    found = {(r.unique_id, r.cutoff.day): r.yhat for r in fc.forecast_pandas(panel, days, "daily", "point", window=3).collect()}
    assert found == {("a:x", d): A[d - 1] for d in range(5, 15)} | {("b:x", d): B[d - 1] for d in range(11, 15)}


def test_pandas_model_on_cutoffs_of_each_series(spark, panel, models):
    own = [("a:x", dt.datetime(2026, 1, 7, tzinfo=dt.timezone.utc)), ("b:x", dt.datetime(2026, 1, 13, tzinfo=dt.timezone.utc)), ("c:x", dt.datetime(2026, 1, 13, tzinfo=dt.timezone.utc))]
    cutoffs = spark.createDataFrame(own, "unique_id STRING, cutoff TIMESTAMP")
    found = fc.forecast_pandas(panel, cutoffs, "daily", "point", h=2, window=14).collect()
    assert sorted((r.unique_id, r.cutoff.day, r.ds.day, r.yhat) for r in found) == [("a:x", 7, 8, 9.0), ("a:x", 7, 9, 9.0), ("b:x", 13, 14, 7.0), ("b:x", 13, 15, 7.0)]


def test_model_file(panel):
    df = fc.forecast_native(panel, CUTOFF, "daily", ["zero_model", "historic_average"], window=14)
    wide = fc.to_model_file(df, "historic_average")
    assert wide.columns[:4] == ["unique_id", "ds", "HistoricAverage", "HistoricAverage-q-10"]
    assert wide.first().cutoff == "2026-01-14-00"
    back = fc.from_model_file(wide, "historic_average", "daily").select(*df.columns)
    assert rows(back) == rows(df.where("model = 'historic_average'"))
    with pytest.raises(ValueError, match="alias"):
        fc.from_model_file(wide.select("unique_id", "ds", "cutoff", "HistoricAverage"), "x", "daily")


def test_alignment_check(spark, panel):
    fc.check_alignment(panel, CUTOFF, "daily", 14)
    with pytest.raises(ValueError):
        fc.check_alignment(panel, ["2026-01-20"], "daily", 14)
    with pytest.raises(ValueError):
        fc.check_alignment(panel_of(spark, {"a:x": A, "b:x": A[:10]}), CUTOFF, "daily", 14)


def test_model_returns_arrays():
    """A function may return a dict of arrays; columns of different lengths are its failure."""
    import numpy as np
    import pandas as pd

    def arrays(past, h, freq):
        ds = past["ds"].to_numpy()[-1] + np.arange(1, h + 1).astype("timedelta64[D]")
        return {"ds": ds, "yhat": np.full(h if len(past) == 3 else h + 1, 4.0)}

    rows = pd.DataFrame({"unique_id": ["a"] * 3 + ["b"] * 2, "micros": [k * 86_400_000_000 for k in (0, 1, 2, 1, 2)], "idx": [0, 1, 2, 1, 2], "y": range(5), "is_cutoff": False})
    run = fc._run_series(fc.Model("arrays", "Arrays", fn=arrays), cal.frequency("daily"), 2, [50], 3, [(2 * 86_400_000_000, 2)])
    out = pd.concat(run(iter([rows.iloc[:2], rows.iloc[2:]])))
    assert out["unique_id"].tolist() == ["a", "a", "b"] and out["yhat"].tolist()[:2] == [4.0, 4.0]
    assert out["error"].tolist() == [None, None, "ValueError: columns of different lengths"]
