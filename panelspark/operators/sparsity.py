"""Series sparsity: share of zero days and its tertile within each metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.constants import METRICS
from panelspark.operators.ranking import exact_ntile
from panelspark.session import settle

# Label of each tertile.
LABELS = {1: "low", 2: "medium", 3: "high"}


def zero_rates(daily: DataFrame, year: int | None = None) -> DataFrame:
    """Observations, zeros and zero rate per series.

    Rows are grouped by id and metric first: a maximum of strings would make Spark
    sort the whole panel.
    """
    rows = daily.where(F.col("metric").isin(*METRICS))
    if year is not None:
        rows = rows.where(F.year("ds") == year)
    zeros = F.count_if(F.col("y") == 0)
    counts = rows.groupBy("unique_id", "metric").agg(
        F.count("*").alias("n_obs"), zeros.alias("n_zero")
    )
    per_series = counts.groupBy("unique_id").agg(
        F.max("metric").alias("metric"), F.sum("n_obs").alias("n_obs"), F.sum("n_zero").alias("n_zero")
    )
    rate = F.col("n_zero").cast("double") / F.col("n_obs").cast("double")
    return per_series.where("n_obs > 0").withColumn("zero_rate", rate)


def series_sparsity(daily: DataFrame, year: int | None = None) -> DataFrame:
    """``unique_id, metric, n_obs, n_zero, zero_rate, sparsity_level``.

    Tertiles are formed within each metric. Equal zero rates are ordered by the
    hash of the series id, which keeps the result deterministic. The rates, one row
    per series, are staged, so the panel is read once.
    """
    rates = settle(zero_rates(daily, year), "zero-rates")
    tiles = exact_ntile(rates, 3, "metric", "zero_rate", "unique_id", "tile")
    level = F.coalesce(*[F.when(F.col("tile") == t, name) for t, name in LABELS.items()])
    return tiles.select(
        "unique_id", "metric", "n_obs", "n_zero", "zero_rate", level.alias("sparsity_level")
    )
