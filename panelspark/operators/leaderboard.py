"""Leaderboard: stratum medians, scaled by the zero model, on a complete grid."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import DATASET, DENOM_FLOOR, LEADERBOARD_FREQUENCIES, ZERO_MODEL
from panelspark.functions.scoring import safe_divide
from panelspark.operators.ranking import grouped_percentiles
from panelspark.session import settle

STRATUM = ["frequency", "cutoff", "metric", "subdataset", "sparsity_level"]
GROUP = ["dataset", *STRATUM, "model", "model_alias"]

# Column order and sort order of the leaderboard.
COLUMNS = (
    "dataset",
    "subdataset",
    "sparsity_level",
    "frequency",
    "cutoff",
    "metric",
    "model",
    "model_alias",
    "value",
    "median_zero",
    "pct_z",
    "denom",
)
SORT_KEYS = ("frequency", "subdataset", "sparsity_level", "cutoff", "metric", "model")


def _fallback_id() -> Column:
    """Null if a part is null, as with ``||``."""
    parts = [F.col(c) for c in ("subdataset", "model", "cutoff", "frequency")]
    return F.concat(*[x for part in parts for x in (part, F.lit(":"))][:-1])


def sparsity_levels(sparsity: DataFrame) -> DataFrame:
    """Series id and level; a series with two levels is an error, as it would repeat rows of the leaderboard."""
    spread = sparsity.groupBy("unique_id").agg(F.min("sparsity_level").alias("low"), F.max("sparsity_level").alias("high"))
    error = F.raise_error(F.concat(F.lit("more than one sparsity level: "), "unique_id")).cast("string")
    return spread.select("unique_id", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(error).alias("sparsity_level"))


def ambiguous_sparsity(sparsity: DataFrame) -> DataFrame:
    """Series with more than one level; they would repeat rows of the leaderboard."""
    counts = sparsity.select("unique_id", "sparsity_level").distinct().groupBy("unique_id").agg(F.count("*").alias("n"))
    return counts.where("n > 1")


def raw_long(
    metrics: DataFrame,
    sparsity: DataFrame,
    frequencies: Iterable[str] = LEADERBOARD_FREQUENCIES,
    dataset: str = DATASET,
) -> DataFrame:
    """One row per series and metric, with the series' sparsity level.

    Null scores are left out, as SQL ``UNPIVOT`` does. A series without a known
    level is ``unknown``. Levels are hashed, one row per series, so the metrics,
    rows for each model and cutoff, need no sort.
    """
    wide = metrics.where(F.col("frequency").isin(*frequencies))
    wide = wide.join(sparsity_levels(sparsity).hint("shuffle_hash"), "unique_id", "left").select(
        F.lit(dataset).alias("dataset"),
        F.coalesce("unique_id", _fallback_id()).alias("unique_id"),
        "subdataset",
        "frequency",
        "cutoff",
        "model",
        "model_alias",
        F.coalesce("sparsity_level", F.lit("unknown")).alias("sparsity_level"),
        "mase",
        "scaled_crps",
    )
    keys = [c for c in wide.columns if c not in ("mase", "scaled_crps")]
    return wide.unpivot(keys, ["mase", "scaled_crps"], "metric", "value").where("value IS NOT NULL")


def stratum_medians(long: DataFrame) -> DataFrame:
    """Median score ``v`` per stratum and model."""
    return grouped_percentiles(long, GROUP, "value", {"v": 0.5})


def zero_denominators(
    long: DataFrame, zero_model: str = ZERO_MODEL, floor: float = DENOM_FLOOR
) -> DataFrame:
    """Per stratum: zero-model median, tenth percentile of its positive scores, denominator.

    The denominator is the larger of the two; without a positive score the floor
    stands in for the percentile.
    """
    zero = long.where(F.col("model") == zero_model)
    found = grouped_percentiles(zero, STRATUM, "value", {"median_zero": 0.5}, {"pct_z": 0.1})
    denom = F.greatest(
        F.coalesce("median_zero", F.lit(0.0)), F.coalesce("pct_z", F.lit(floor))
    )
    return found.withColumn("denom", denom)


def scaled_scores(medians: DataFrame, denominators: DataFrame) -> DataFrame:
    """Median over denominator; null where the zero model has no score."""
    joined = medians.join(denominators, STRATUM, "left")
    return joined.withColumn("value", safe_divide(F.col("v"), F.col("denom"))).drop("v")


def full_grid(scored: DataFrame, dataset: str = DATASET) -> DataFrame:
    """Every (frequency, cutoff) with every subdataset, level, metric and model seen.

    The grid is a row expansion: each cutoff unrolls the arrays of the other
    dimensions, which hold a few fixed names each.
    """
    dims = scored.agg(
        F.collect_set("subdataset").alias("subdatasets"),
        F.collect_set("sparsity_level").alias("levels"),
        F.collect_set("metric").alias("metrics"),
        F.collect_set(F.struct("model", "model_alias")).alias("models"),
    )
    one = F.struct(*dims.columns)
    cells = scored.select("frequency", "cutoff").distinct()
    cells = cells.withColumn("d", dims.select(one).scalar())
    for source, name in (("subdatasets", "subdataset"), ("levels", "sparsity_level"), ("metrics", "metric")):
        cells = cells.withColumn(name, F.explode(f"d.{source}"))
    cells = cells.withColumn("m", F.explode("d.models"))
    return cells.select(
        F.lit(dataset).alias("dataset"),
        *STRATUM,
        F.col("m.model").alias("model"),
        F.col("m.model_alias").alias("model_alias"),
    )


def complete_grid(grid: DataFrame, scored: DataFrame, denominators: DataFrame) -> DataFrame:
    """Grid rows with their score, null where a model has none."""
    values = scored.select(*STRATUM, "model", "model_alias", "value")
    return (
        grid.join(values, [*STRATUM, "model", "model_alias"], "left")
        .join(denominators, STRATUM, "left")
        .select(*COLUMNS)
    )


def leaderboard(
    metrics: DataFrame,
    sparsity: DataFrame,
    zero_model: str = ZERO_MODEL,
    floor: float = DENOM_FLOOR,
    frequencies: Iterable[str] = LEADERBOARD_FREQUENCIES,
    dataset: str = DATASET,
) -> DataFrame:
    """The complete, unsorted leaderboard."""
    scored = settle(stratum_scores(metrics, sparsity, zero_model, floor, frequencies, dataset), "scaled")
    return from_strata(scored, zero_model, dataset)


def stratum_scores(
    metrics: DataFrame,
    sparsity: DataFrame,
    zero_model: str = ZERO_MODEL,
    floor: float = DENOM_FLOOR,
    frequencies: Iterable[str] = LEADERBOARD_FREQUENCIES,
    dataset: str = DATASET,
) -> DataFrame:
    """Scaled score of every stratum and model. Those of one frequency and cutoff depend on its own metrics only.

    The long scores are staged without their series, as medians and denominators read them.
    """
    long = settle(raw_long(metrics, sparsity, frequencies, dataset).select(*GROUP, "value"), "long-scores")
    return scaled_scores(stratum_medians(long), zero_denominators(long, zero_model, floor))


def from_strata(scored: DataFrame, zero_model: str = ZERO_MODEL, dataset: str = DATASET) -> DataFrame:
    """Leaderboard of stored stratum scores, which have a few rows per stratum.

    The grid's dimensions, the scores and the denominators all come from them; every stratum with a denominator has
    zero-model rows, which carry it.
    """
    stored = scored.where(F.col("model") == zero_model)
    stored = stored.select(*STRATUM, "median_zero", "pct_z", "denom").distinct()
    return complete_grid(full_grid(scored, dataset), scored, stored)


def sorted_leaderboard(board: DataFrame) -> DataFrame:
    """Leaderboard in report order."""
    return board.orderBy(*SORT_KEYS)


def leaderboard_gaps(board: DataFrame) -> DataFrame:
    """Number of grid rows and of those without a value."""
    return board.agg(
        F.count("*").alias("total"), (F.count("*") - F.count("value")).alias("missing")
    )
