"""Scores of forecasts against actuals, behind leakage, null and NaN guards.

A key is one ``(model, cutoff)``. The scores of all keys come from one join and
one aggregation; a guard that fails removes the whole key and is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import CRPS_EPS, MASE_EPS, QUANTILE_FILL_LIMIT
from panelspark.functions import calendar as cal
from panelspark.functions import scoring
from panelspark.operators import windows
from panelspark.operators.windows import Cutoffs
from panelspark.session import settle

KEY = ["model", "model_alias", "cutoff"]
SERIES = [*KEY, "unique_id"]

# Columns of the metrics table.
METRIC_COLUMNS = (
    "unique_id",
    "model",
    "model_alias",
    "cutoff",
    "frequency",
    "subdataset",
    "mase",
    "scaled_crps",
)


def join_actuals(forecasts: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast rows with their actual value ``y``; forecasts without one drop out.

    Actuals without a forecast are not in the result. :func:`evaluate` finds them
    by count, which avoids a copy of the actuals per model. Actuals grow with the series and shrink much on disk, so
    their size there must not make every task hold all of them.
    """
    return forecasts.join(actual.hint("merge"), ["cutoff", "unique_id", "ds"])


def train_scales(
    panel: DataFrame, cutoffs: Cutoffs, freq: str, window: int | None = None, m: int = 1
) -> DataFrame:
    """``mase_scale`` and ``crps_scale`` per cutoff and series, from its history."""
    stats = windows.rolling_stats(panel, cutoffs, freq, window, m=m)
    return stats.select(
        "cutoff",
        "unique_id",
        scoring.clip_lower(F.col("mean_abs_diff"), MASE_EPS).alias("mase_scale"),
        scoring.clip_lower(F.col("mean_abs_y"), CRPS_EPS).alias("crps_scale"),
    )


def _quantiles(df: DataFrame) -> dict[int, Column]:
    return {q: F.col(scoring.quantile_column(q)) for q in scoring.quantile_levels(df.columns)}


def mae(joined: DataFrame) -> DataFrame:
    """Mean absolute error per model, cutoff and series."""
    return joined.groupBy(*SERIES).agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))


def mase(joined: DataFrame, scales: DataFrame) -> DataFrame:
    """Mean absolute error over the mean absolute one-step difference in the history."""
    errors = mae(joined).join(scales, ["cutoff", "unique_id"], "left")
    return errors.select(*SERIES, (F.col("mae") / F.col("mase_scale")).alias("mase"))


def quantile_loss(joined: DataFrame, convention: str = "reference") -> DataFrame:
    """Sum of the quantile loss over the horizon, per series and level."""
    columns = _quantiles(joined)
    sums = joined.groupBy(*SERIES).agg(
        *[
            F.sum(scoring.pinball(F.col("y"), col, q, convention)).alias(str(q))
            for q, col in columns.items()
        ]
    )
    long = sums.unpivot(SERIES, [str(q) for q in columns], "level", "loss")
    return long.withColumn("level", F.col("level").cast("int"))


def scaled_crps(joined: DataFrame, scales: DataFrame, convention: str = "reference") -> DataFrame:
    """Twice the mean over levels of the summed quantile loss, over the history's mean |y|."""
    loss = scoring.mean_pinball(F.col("y"), _quantiles(joined), convention)
    crps = joined.groupBy(*SERIES).agg((F.sum(loss) * 2).alias("crps"))
    crps = crps.join(scales, ["cutoff", "unique_id"], "left")
    return crps.select(*SERIES, (F.col("crps") / F.col("crps_scale")).alias("scaled_crps"))


def fill_quantiles(joined: DataFrame) -> DataFrame:
    """Replace null quantiles by the point forecast."""
    filled = {
        scoring.quantile_column(q): F.coalesce(col, F.col("yhat"))
        for q, col in _quantiles(joined).items()
    }
    return joined.withColumns(filled)


def _needs_fill(joined: DataFrame) -> Column:
    """The point forecast is there but a quantile is null."""
    gaps = [col.isNull() for col in _quantiles(joined).values()]
    return F.col("yhat").isNotNull() & reduce(lambda a, b: a | b, gaps)


def leakage(forecasts: DataFrame) -> DataFrame:
    """Per key: first forecast time, and whether it lies before the cutoff."""
    first = forecasts.groupBy(*KEY).agg(F.min("ds").alias("min_ds"))
    return first.withColumn("leaks", F.col("min_ds") < F.col("cutoff"))


# Steps that fit the bits of a long.
_BITS = 62


def _distinct_steps(step: Column, h: int) -> Column:
    """Number of different steps of 1 to ``h``, as an aggregate of bits in as many longs as it takes."""
    zero = F.lit(0).cast("long")
    counts = []
    for first in range(1, h + 1, _BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (step - first).cast("int"))
        counts.append(F.bit_count(F.coalesce(F.bit_or(F.when(step.between(first, first + _BITS - 1), bit)), zero)))
    return reduce(lambda a, b: a + b, counts)


def _with_actuals(
    forecasts: DataFrame, actual: DataFrame, scales: DataFrame, f: cal.Frequency, h: int
) -> DataFrame:
    """Forecasts with their step ``_k``, actual ``y`` and scales; null where there is none.

    The actuals of a cutoff and series are packed into one row with its scales, so
    the join needs cutoff and series only and a following aggregation per series
    reuses its partitioning. The packed rows of a partition are few, so they are hashed:
    the forecasts, many wide rows for each, then need no sort. They shrink much on disk, so
    their size there must not make every task hold all of them either.
    """
    step = cal.period_index(F.col("ds"), f) - cal.period_index(F.col("cutoff"), f)
    keys = ["cutoff", "unique_id"]
    values = [F.max(F.when(step == i, F.col("y"))).alias(f"_y{i}") for i in range(1, h + 1)]
    side = actual.groupBy(*keys).agg(*values).join(scales.hint("shuffle_hash"), keys, "left")
    packed = F.array(*[F.col(f"_y{i}") for i in range(1, h + 1)])
    value = F.when(cal.on_grid(F.col("ds"), f) & (F.col("_k") > 0), F.get(packed, F.col("_k").cast("int") - 1))
    joined = forecasts.withColumn("_k", step).join(side.hint("shuffle_hash"), keys, "left")
    return joined.select(*forecasts.columns, "_k", value.alias("y"), "mase_scale", "crps_scale")


def series_scores(
    forecasts: DataFrame,
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    window: int | None = None,
    h: int | None = None,
    convention: str = "reference",
    m: int = 1,
) -> DataFrame:
    """Unchecked scores per model, cutoff and series, with the counts the guards need.

    The forecasts are read and shuffled once. Those without an actual stay in for
    the leakage guard and do not score.
    """
    f = cal.frequency(freq)
    h = h or f.h
    actual = windows.actuals(panel, cutoffs, f, h)
    scales = train_scales(panel, cutoffs, f, window, m)
    joined = _with_actuals(forecasts, actual, scales, f, h)
    matched = F.col("y").isNotNull()
    has_quantile = reduce(lambda a, b: a | b, [c.isNotNull() for c in _quantiles(joined).values()])
    filled = fill_quantiles(joined.withColumns({"_fill": _needs_fill(joined), "_has": has_quantile}))
    loss = scoring.mean_pinball(F.col("y"), _quantiles(filled), convention)
    step = F.when(matched, F.col("_k"))
    scores = filled.groupBy(*SERIES).agg(
        (F.avg(F.abs(F.col("y") - F.col("yhat"))) / F.max("mase_scale")).alias("mase"),
        (F.sum(loss) * 2 / F.max("crps_scale")).alias("scaled_crps"),
        F.count("y").alias("n_rows"),
        _distinct_steps(step, h).cast("long").alias("n_matched"),
        F.count_if(matched & F.col("_fill")).alias("n_fill"),
        F.count_if(matched & F.col("yhat").isNull()).alias("n_null"),
        F.count_if("_has").alias("n_quantiled"),
        F.min("ds").alias("min_ds"),
    )
    return scores.withColumn("subdataset", F.substring_index("unique_id", ":", -1))


def cutoff_expectations(
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    window: int | None = None,
    h: int | None = None,
) -> DataFrame:
    """Per cutoff: periods present, actual rows, and series with a history but no actuals."""
    f = cal.frequency(freq)
    actual = windows.actuals(panel, cutoffs, f, h)
    per_series = actual.groupBy("cutoff", "unique_id").agg(F.count("*").alias("n"))
    trained = windows.history(panel, cutoffs, f, 1).select("cutoff", "unique_id")
    both = per_series.join(trained, ["cutoff", "unique_id"], "full")
    counts = both.groupBy("cutoff").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_actual"),
        F.count_if(F.col("n").isNull()).alias("n_train_only"),
    )
    presence = windows.window_presence(panel, cutoffs, f, window, h or f.h)
    return presence.join(counts, "cutoff", "left").select(
        "cutoff",
        "window_ok",
        (F.col("found_actuals") == (h or f.h)).alias("actuals_ok"),
        "n_actual",
        "n_train_only",
    )


def key_status(scores: DataFrame, expected: DataFrame, on_unmatched: str = "fail") -> DataFrame:
    """Guard result per key, from :func:`series_scores` and :func:`cutoff_expectations`.

    ``ok``, or the first guard that fails: ``leakage`` (a forecast lies before the
    cutoff), ``missing_history`` and ``missing_actuals`` (a period is absent),
    ``no_actuals``, ``no_quantiles``, ``null_values`` (an actual has no forecast, or
    too many quantiles are missing) and ``nan_metrics`` (a score has no scale).
    """
    if on_unmatched not in ("fail", "drop"):
        raise ValueError(f"Unknown on_unmatched: {on_unmatched}")
    undefined = F.col("mase").isNull() | F.col("scaled_crps").isNull()
    undefined = undefined | F.isnan("mase") | F.isnan("scaled_crps")
    sums = scores.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_matched", "n_fill", "n_null", "n_quantiled")],
        F.count_if(undefined & (F.col("n_matched") > 0)).alias("n_undefined"),
        F.min("min_ds").alias("min_ds"),
    )
    zero, no = F.lit(0).cast("long"), F.lit(False)
    own = ("n_rows", "n_matched", "n_fill", "n_null", "n_quantiled", "n_undefined")
    rows = (
        sums.join(expected, "cutoff", "left")
        .select(
            *KEY,
            "min_ds",
            *own,
            *[F.coalesce(c, no).alias(c) for c in ("window_ok", "actuals_ok")],
            *[F.coalesce(c, zero).alias(c) for c in ("n_actual", "n_train_only")],
        )
        .withColumn("n_unmatched", F.col("n_actual") - F.col("n_matched"))
    )
    if on_unmatched == "drop":
        rows = rows.withColumns({"n_unmatched": zero, "n_train_only": zero})
    merged = F.col("n_rows") + F.col("n_unmatched")
    too_many = (F.col("n_fill") > 0) & (F.col("n_fill") / F.greatest(merged, F.lit(1)) >= QUANTILE_FILL_LIMIT)
    status = (
        F.when(F.col("min_ds") < F.col("cutoff"), "leakage")
        .when(~F.col("window_ok"), "missing_history")
        .when(F.col("n_actual") == 0, "no_actuals")
        .when(~F.col("actuals_ok"), "missing_actuals")
        .when(F.col("n_quantiled") == 0, "no_quantiles")
        .when((F.col("n_unmatched") > 0) | (F.col("n_null") > 0) | too_many, "null_values")
        .when((F.col("n_undefined") > 0) | (F.col("n_train_only") > 0), "nan_metrics")
        .otherwise("ok")
    )
    return rows.withColumn("status", status)


def evaluate(
    forecasts: DataFrame,
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    window: int | None = None,
    h: int | None = None,
    convention: str = "reference",
    on_unmatched: str = "fail",
    strict: bool = False,
    m: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Metrics of all keys that pass the guards, and the status of every key.

    ``on_unmatched="drop"`` scores the series that have a forecast instead of
    failing a key over an actual without one. ``strict`` raises on a failed key.
    ``m`` is the seasonality of the MASE scale.
    Scores are staged, so forecasts are read and joined once.
    """
    f = cal.frequency(freq)
    cutoffs = cutoffs if isinstance(cutoffs, DataFrame) else list(cutoffs)
    scores = settle(series_scores(forecasts, panel, cutoffs, f, window, h, convention, m), "scores")
    expected = cutoff_expectations(panel, cutoffs, f, window, h)
    status = key_status(scores, expected, on_unmatched)
    status = settle(status, "key-status")
    if strict:
        bad = status.where("status <> 'ok'")
        row = bad.agg(F.count("*").alias("n"), F.min(F.struct("cutoff", "model", "status")).alias("first")).first()
        if row.n:
            raise ValueError(f"Evaluation failed for {row.n} keys, the first of them {tuple(row.first)}")
    passed = status.where("status = 'ok'").select(*KEY)
    metrics = scores.where("n_matched > 0").join(passed, KEY, "left_semi").select(
        "unique_id",
        "model",
        "model_alias",
        cal.hour_key(F.col("cutoff")).alias("cutoff"),
        F.lit(f.name).alias("frequency"),
        "subdataset",
        "mase",
        "scaled_crps",
    )
    return metrics, status
