import itertools

import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelspark.operators import leaderboard as lb

SCHEMA = (
    "unique_id STRING, model STRING, model_alias STRING, cutoff STRING, frequency STRING, "
    "subdataset STRING, mase DOUBLE, scaled_crps DOUBLE"
)
ALIAS = {"zero_model": "ZeroModel", "naive": "Naive"}


def metric_rows(spark, scores):
    """Metrics of ``(id, model, cutoff, frequency, mase, crps)``."""
    data = [(u, m, ALIAS[m], c, f, u.split(":")[1], a, b) for u, m, c, f, a, b in scores]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def board(spark):
    scores = []
    for i, c in itertools.product(range(5), ("2026-01-04-00", "2026-01-11-00")):
        scores.append((f"{i}:stars", "zero_model", c, "daily", float(i), 2.0 * i))
        if c == "2026-01-04-00":
            scores.append((f"{i}:stars", "naive", c, "daily", i + 1.0, 1.0))
        scores.append((f"{i}:pushes", "zero_model", c, "daily", 0.0, 0.0))
        scores.append((f"{i}:pushes", "naive", c, "daily", 3.0, None))
    scores.append(("9:stars", "naive", "2026-01-04-00", "weekly", 7.0, 7.0))
    scores.append(("9:stars", "naive", "2026-01-04-00", "hourly", 1.0, 1.0))
    metrics = metric_rows(spark, scores)
    levels = [(f"{i}:{m}", "low") for i in range(5) for m in ("stars", "pushes")]
    sparsity = spark.createDataFrame(levels + levels[:2], "unique_id STRING, sparsity_level STRING")
    return lb.leaderboard(metrics, sparsity).cache()


def cell(board, **keys):
    for name, value in keys.items():
        board = board.where(F.col(name) == value)
    found = board.collect()
    assert len(found) == 1
    return found[0]


def test_grid_is_complete(board):
    # cutoffs (2 daily + 1 weekly) x subdatasets 2 x levels (low, unknown) x metrics 2 x models 2
    assert board.columns == list(lb.COLUMNS)
    assert board.count() == 3 * 2 * 2 * 2 * 2
    assert board.select(*lb.STRATUM, "model").distinct().count() == 48
    assert board.where("frequency = 'hourly'").count() == 0
    assert {r.dataset for r in board.collect()} == {"gh-archive"}


def test_scaling(board):
    at = {"frequency": "daily", "cutoff": "2026-01-04-00", "subdataset": "stars", "sparsity_level": "low", "metric": "mase"}
    naive, zero = cell(board, model="naive", **at), cell(board, model="zero_model", **at)
    # Zero scores 0..4: median 2, tenth percentile of 1..4 is 1.3; naive median 3.
    assert (naive.median_zero, naive.denom) == (2.0, 2.0)
    assert naive.pct_z == pytest.approx(1.3)
    assert naive.value == 1.5 and zero.value == 1.0
    # The next cutoff has no naive score: a gap that still shows the denominator.
    gap = cell(board, model="naive", **{**at, "cutoff": "2026-01-11-00"})
    assert (gap.value, gap.model_alias, gap.denom) == (None, "Naive", 2.0)


def test_floor_without_positive_scores(board):
    at = {"frequency": "daily", "cutoff": "2026-01-04-00", "subdataset": "pushes", "sparsity_level": "low", "metric": "mase"}
    row = cell(board, model="naive", **at)
    assert (row.median_zero, row.pct_z, row.denom, row.value) == (0.0, None, 0.001, 3000.0)
    assert cell(board, model="zero_model", **at).value == 0.0


def test_without_zero_model(board):
    row = cell(board, frequency="weekly", subdataset="stars", sparsity_level="unknown", metric="mase", model="naive")
    assert (row.value, row.denom) == (None, None)


def test_null_scores_are_left_out(board):
    at = {"frequency": "daily", "cutoff": "2026-01-04-00", "subdataset": "pushes", "sparsity_level": "low"}
    assert cell(board, metric="scaled_crps", model="naive", **at).value is None


def test_gaps_and_order(board):
    total, missing = lb.leaderboard_gaps(board).first()
    assert (total, missing) == (48, board.where("value IS NULL").count())
    ordered = [tuple(r[k] for k in lb.SORT_KEYS) for r in lb.sorted_leaderboard(board).collect()]
    assert ordered == sorted(ordered)


def test_plan_has_no_cross_join(board, spark):
    stratum = board.select(*lb.STRATUM, "dataset", "model", "model_alias", "value")
    plan = lb.full_grid(stratum)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ambiguous_levels(spark):
    df = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", "low"), ("b", "low")], "unique_id STRING, sparsity_level STRING")
    assert rows(lb.ambiguous_sparsity(df)) == [("a", 2)]


def test_metrics_are_not_sorted_for_their_levels(spark, monkeypatch):
    """Levels are one row per series, metrics many; the staged scores hold no series, which are as many as the rows."""
    metrics = metric_rows(spark, [(f"{i}:stars", m, "2026-01-04-00", "daily", i + 1.0, 1.0) for i in range(4) for m in ALIAS])
    sparsity = spark.createDataFrame([(f"{i}:stars", "low") for i in range(3)], "unique_id STRING, sparsity_level STRING")
    long = lb.raw_long(metrics, sparsity)
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert long.where("sparsity_level = 'low'").count() == 12 and long.where("sparsity_level = 'unknown'").count() == 4
    staged = {}
    monkeypatch.setattr(lb, "settle", lambda df, name: staged.setdefault(name, df))
    assert lb.stratum_scores(metrics, sparsity).count() == 8
    assert staged["long-scores"].columns == [*lb.GROUP, "value"]
