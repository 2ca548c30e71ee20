import datetime as dt
import random
import statistics

import pytest
from helpers import panel_of, rows

from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import windows


@pytest.fixture(scope="module")
def fortnight(spark):
    return panel_of(spark, {"repo_a:stars": [2 * i for i in range(1, 15)], "repo_b:stars": [3 * i for i in range(1, 15)]})


def test_history(spark, fortnight):
    found = rows(windows.history(fortnight, ["2026-01-10"], "daily", 7))
    assert len(found) == 14
    assert {r[2].day for r in found} == set(range(4, 11))
    assert windows.history(fortnight, ["2026-01-14"], "daily", 3).count() == 6
    both = windows.history(fortnight, ["2026-01-10-00", "2026-01-14 00:00:00"], "daily", 7)
    assert both.count() == 28
    frame = spark.createDataFrame([(cal.cutoff_value(d),) for d in ("2026-01-10", "2026-01-14")], "cutoff TIMESTAMP")
    assert rows(windows.history(fortnight, frame, "daily", 7)) == rows(both)


def test_missing_history(fortnight):
    ok = windows.window_presence(fortnight, ["2026-01-10"], "daily", 7)
    windows.require_window(ok)
    for cutoff in ("2025-06-01", "2026-01-05"):
        with pytest.raises(FileNotFoundError):
            windows.require_window(windows.window_presence(fortnight, [cutoff], "daily", 7))


def test_actuals(fortnight):
    found = rows(windows.actuals(fortnight, ["2026-01-05"], "daily"))
    assert len(found) == 14
    assert {r[2].day for r in found} == set(range(6, 13))
    assert windows.actuals(fortnight, ["2026-02-01"], "daily").count() == 0
    presence = windows.window_presence(fortnight, ["2026-01-05", "2026-01-10"], "daily", 3, h=7)
    assert [(r[0].day, r[3]) for r in rows(presence)] == [(5, 7), (10, 4)]


def test_off_grid_cutoffs(fortnight):
    with pytest.raises(ValueError):
        windows.history(fortnight, ["2026-01-15"], "monthly")
    with pytest.raises(ValueError):
        windows.history(fortnight, ["2026-01-15-03"], "daily")
    with pytest.raises(ValueError):
        windows.history(fortnight, [], "daily")


def test_off_grid_cutoffs_of_a_frame(spark, fortnight):
    frame = spark.createDataFrame([(cal.cutoff_value(c),) for c in ("2026-01-10", "2026-01-11-05")], "cutoff TIMESTAMP")
    with pytest.raises(Exception, match="not on the daily grid"):
        windows.history(fortnight, frame, "daily", 7).collect()


def test_rolling_stats_of_fractions(spark):
    import random

    rng = random.Random(2)
    values = [round(rng.gauss(0, 5), 3) for _ in range(30)]
    whole = [float(k * k % 17) for k in range(30)]
    day = dt.datetime(2026, 1, 1, tzinfo=cal.UTC)
    data = [(uid, day + dt.timedelta(k), y) for uid, ys in (("a", values), ("b", whole)) for k, y in enumerate(ys)]
    panel = spark.createDataFrame(data, "unique_id STRING, ds TIMESTAMP, y DOUBLE")
    for w, m, s in ((14, 1, 7), (5, 2, 3), (4, 1, 7)):
        found = {r.unique_id: r for r in windows.rolling_stats(panel, ["2026-01-25"], "daily", w, m, s).collect()}
        for uid, ys in (("a", values), ("b", whole)):
            expected = brute(ys[:25], w, m, s)
            for name, value in expected.items():
                assert found[uid][name] == pytest.approx(value), (uid, name)
        exact = windows.rolling_stats(panel.withColumn("y", F.col("y").cast("long")), ["2026-01-25"], "daily", w, m, s)
        same = exact.where("unique_id = 'b'").first()
        assert all(found["b"][n] == pytest.approx(same[n]) for n in ("mean_y", "sd_y", "mean_abs_diff", "sd_season"))


def test_fractions_beside_large_numbers_and_gaps(spark):
    """Sums over blocks lose no digits to values outside the window, and gaps leave periods out."""
    rng = random.Random(4)
    day = dt.datetime(2026, 1, 1, tzinfo=cal.UTC)
    days = sorted(rng.sample(range(200), 120))
    values = {d: (1e15 if d < 60 else 1e6) + rng.random() for d in days}
    panel = spark.createDataFrame([("a", day + dt.timedelta(d), y) for d, y in values.items()], "unique_id STRING, ds TIMESTAMP, y DOUBLE")
    at = [d for d in days if d >= 90][::5]
    for w in (2, 7, 30):
        stats = windows.rolling_stats(panel, [day + dt.timedelta(d) for d in at], "daily", w, 1, 3).collect()
        found = {(r.cutoff.date() - day.date()).days: r for r in stats}
        for d in at:
            inside = [values[k] for k in days if d - w < k <= d]
            assert found[d].n_obs == len(inside)
            assert found[d].mean_y == pytest.approx(statistics.mean(inside), rel=1e-12)
            spread = statistics.stdev(inside) if len(inside) > 1 else 0.0
            assert found[d].sd_y == pytest.approx(spread, rel=1e-6, abs=1e-9)


def test_fraction_plan_does_not_grow_with_the_window(spark, fortnight):
    """One shuffle by series, and frames that only grow."""
    panel = fortnight.withColumn("y", F.col("y") / 3)
    plans = [windows.rolling_stats(panel, ["2026-01-10"], "daily", w)._jdf.queryExecution().executedPlan().toString() for w in (8, 500)]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1]
    assert all("RangeFrame, -" not in p for p in plans)


def test_cutoffs_of_each_series(spark, fortnight):
    """A frame by series gives what lists give for its series."""
    mine = {"repo_a:stars": ["2026-01-05", "2026-01-10"], "repo_b:stars": ["2026-01-10", "2026-01-14"]}
    ids = {r.unique_id for r in fortnight.select("unique_id").distinct().collect()}
    mine = {k: v for k, v in zip(sorted(ids), mine.values())}
    data = [(uid, cal.cutoff_value(c)) for uid, cutoffs in mine.items() for c in cutoffs]
    own = spark.createDataFrame(data, "unique_id STRING, cutoff TIMESTAMP")
    for run in (
        lambda c: windows.history(fortnight, c, "daily", 7),
        lambda c: windows.actuals(fortnight, c, "daily", 3),
        lambda c: windows.rolling_stats(fortnight, c, "daily", 5).drop("tail"),
    ):
        expected = [r for uid, cutoffs in mine.items() for r in rows(run(cutoffs).where(F.col("unique_id") == uid))]
        assert sorted(rows(run(own)), key=repr) == sorted(expected, key=repr) != []
    plan = windows.history(fortnight, own, "daily", 7)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="single series"):
        windows.alignment(fortnight, own, "daily", 7)


def brute(values, w, m, s):
    """Window statistics of the last ``w`` of a list of observations."""
    ys = values[-w:]
    diffs = [abs(b - a) for a, b in zip(ys, ys[m:])]
    season = [b - a for a, b in zip(ys, ys[s:])]
    return {
        "n_obs": len(ys),
        "mean_y": sum(ys) / len(ys),
        "mean_abs_y": sum(map(abs, ys)) / len(ys),
        "sd_y": statistics.stdev(ys) if len(ys) > 1 else 0.0,
        "mean_abs_diff": sum(diffs) / len(diffs) if diffs else None,
        "sd_season": (sum(d * d for d in season) / len(season)) ** 0.5 if season else 0.0,
        "tail": ys[-s:] if len(ys) >= s else None,
    }


@pytest.mark.parametrize("w,m,s", [(14, 1, 7), (10, 2, 3), (3, 1, 7), (200, 1, 7)])
def test_rolling_stats(spark, w, m, s):
    rng = random.Random(w)
    series = {}
    for i in range(12):
        late = rng.choice([0, 0, 20, 29, 39])
        values = [None] * late + [rng.choice([0, 0, 1, 5, 10**9]) for _ in range(60 - late)]
        series[f"{i}:stars"] = values
    series["c:stars"] = [4] * 60
    panel = panel_of(spark, series)
    cutoffs = ["2026-01-30", "2026-02-09", "2026-03-01"]
    found = windows.rolling_stats(panel, cutoffs, "daily", w, m, s).collect()
    expected = {}
    for day in (30, 40, 60):
        for uid, values in series.items():
            seen = [v for v in values[:day] if v is not None]
            if seen:
                expected[uid, day] = brute(seen, w, m, s)
    assert len(found) == len(expected)
    for r in found:
        day = (r.cutoff.date() - dt.date(2025, 12, 31)).days
        for name, value in expected[r.unique_id, day].items():
            if value is None or isinstance(value, list):
                assert r[name] == value, (r, name)
            else:
                assert r[name] == pytest.approx(value, rel=1e-9, abs=1e-9), (r, name)


def test_rolling_stats_is_one_shuffle(fortnight):
    stats = windows.rolling_stats(fortnight, ["2026-01-10", "2026-01-14"], "daily", 7)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_alignment(spark):
    panel = panel_of(spark, {"a:x": [1] * 10, "b:x": [1] * 6, "c:x": [None] * 8 + [1] * 2, "d:x": [1] * 2})
    found = windows.alignment(panel, ["2026-01-06", "2026-01-08", "2026-01-10"], "daily", 3)
    assert [(r[0].day, *r[1:]) for r in rows(found)] == [(6, 2, 0, True), (8, 2, 1, False), (10, 2, 0, True)]


def test_preview(fortnight):
    row = windows.preview(fortnight).first()
    assert (row.n_rows, row.n_series) == (28, 2)
    first = windows.head(fortnight, 3).collect()
    assert [(r.unique_id, r.y) for r in first] == [("repo_a:stars", y) for y in (2, 4, 6)]


def test_listed_cutoffs_bound_the_scan(spark, fortnight, tmp_path):
    fortnight.write.parquet(str(tmp_path / "panel"))
    stored = spark.read.parquet(str(tmp_path / "panel"))
    plan = windows.history(stored, ["2026-01-10"], "daily", 7)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ds,2026-01-04" in plan


def _stats_by_both_ways(panel, cutoffs, freq, w, **more):
    """Statistics of few listed cutoffs, and of the same as cutoffs of each series, which take running sums."""
    few = windows.rolling_stats(panel, cutoffs, freq, w, **more)
    frame = panel.select("unique_id").distinct().crossJoin(windows.cutoff_frame(panel.sparkSession, cutoffs, freq).select("cutoff"))
    return few, windows.rolling_stats(panel, frame, freq, w, **more)


@pytest.mark.parametrize("fractions", [False, True])
@pytest.mark.parametrize("w, season", [(6, 3), (4, 4), (3, 7)])
def test_listed_windows_are_added_up(spark, fractions, w, season):
    """Series with gaps, with nulls, with one row and without one at the cutoff; season shorter and longer than the window."""
    chance = random.Random(w)
    data = {f"s{k}": [chance.randint(0, 9) if chance.random() < 0.8 else None for _ in range(30)] for k in range(8)}
    panel = panel_of(spark, data | {"one": [None] * 14 + [5], "flat": [0] * 30})
    panel = panel.withColumn("y", F.when(F.dayofmonth("ds") % 11 != 0, F.col("y") / 7 if fractions else F.col("y")))
    few, all_rows = _stats_by_both_ways(panel, ["2026-01-15", "2026-01-22"], "daily", w, season=season)
    assert few.columns == all_rows.columns
    found, expected = rows(few), rows(all_rows)
    assert len(found) == len(expected) > 8
    for a, b in zip(found, expected):
        assert a[:2] == b[:2]
        for x, y in zip(a[2:], b[2:]):
            assert x == (y if y is None or isinstance(y, list) else pytest.approx(y, abs=1e-9))


def test_listed_windows_take_no_frames(spark, fortnight):
    """Few listed cutoffs need differences only: no sums over frames of every row, no rows copied to the next block."""
    for y in ("y", "y / 7"):
        panel = fortnight.selectExpr("unique_id", "ds", f"{y} AS y")
        plan = windows.rolling_stats(panel, ["2026-01-10", "2026-01-13"], "daily", 7)._jdf.queryExecution().executedPlan().toString()
        assert "RangeFrame" not in plan and plan.count("Exchange hashpartitioning(unique_id") == 1
    many = [f"2026-01-{d:02d}" for d in range(2, 15)]
    assert "RangeFrame" in windows.rolling_stats(fortnight, many, "daily", 7)._jdf.queryExecution().executedPlan().toString()


def test_squares_of_large_numbers(spark):
    """Sums of squares beyond a long are exact."""
    panel = panel_of(spark, {"s": [2**40 + k if k % 3 else (-1) ** k * (2**31 - 1) for k in range(12)], "t": [0, 2**31, 3] * 4})
    few, expected = _stats_by_both_ways(panel, ["2026-01-11", "2026-01-12"], "daily", 8, season=3)
    assert rows(few) == rows(expected)
