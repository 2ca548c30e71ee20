"""Exact ranks, tiles and percentiles that do not put a whole group into one task.

A plain window without partition, or partitioned by a column of few values, sorts
each group in one task. The functions here count first: values are reduced to a
histogram, ranks come from its running totals, and only rows that share one small
bucket are ordered against each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import settle


def running_total(df: DataFrame, order: str, amount: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with the sum of ``amount`` over the rows with a smaller ``order`` as ``name``, and the sum over all rows.

    Two phases: the rows are cut into ranges of ``order``, each range is added up on its own, and then every row adds the
    rows before it in its range to the total of the ranges before. Only one number per range goes through the driver.
    ``order`` must not repeat.
    """
    ranged = settle(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("n")).collect()
    offsets, total = [], 0
    for r in sorted(totals, key=lambda r: r["_range"]):
        offsets.append((r["_range"], total))
        total += r.n
    table = df.sparkSession.createDataFrame(offsets, "_range INT, _offset BIGINT")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0).cast("long"))
    placed = ranged.withColumn("_within", within).join(table, "_range")
    return placed.select(*df.columns, (F.col("_offset") + F.col("_within")).alias(name)), total


def count_percent_rank(values: DataFrame, value: str, rank: str) -> DataFrame:
    """``percent_rank`` per distinct value of a histogram ``(value, n)``, of any size."""
    placed, total = running_total(values, value, "n", "_below")
    share = F.col("_below") / (total - 1) if total > 1 else F.lit(0.0)
    return placed.select(*values.columns, share.alias(rank))


def top_per_group(
    df: DataFrame, group: str, order: Sequence[Column], limits: dict[str, int], rank: str = "rn"
) -> DataFrame:
    """First ``limits[g]`` rows of each group ``g`` in the given order.

    The plain bound on the row number lets Spark cut every task to its own top
    rows before the shuffle, so no group is gathered whole.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    numbered = numbered.where(F.col(rank) <= max(limits.values()))
    keep = reduce(
        lambda a, b: a | b,
        [(F.col(group) == g) & (F.col(rank) <= n) for g, n in limits.items()],
    )
    return numbered.where(keep)


def exact_ntile(df: DataFrame, n: int, group: str, order: str, tie: str, tile: str) -> DataFrame:
    """``ntile(n)`` within ``group``, ordered by ``order``, then ``md5(tie)``, then ``tie``.

    The hash spreads tied rows over 4,096 buckets, so even a group in which all
    rows tie is ordered in small pieces. ``order`` must have few distinct values
    per group, such as a share of days.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(tie).cast("binary"))).withColumn(
        "_bucket", F.substring("_hash", 1, 3)
    )
    bucket = [group, order, "_bucket"]
    numbered = hashed.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*bucket).orderBy("_hash", tie))
    )
    cells = hashed.groupBy(*bucket).agg(F.count("*").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    in_value = Window.partitionBy(group, order).orderBy("_bucket").rowsBetween(*before)
    values = cells.groupBy(group, order).agg(F.sum("_n").alias("_nv"))
    in_group = Window.partitionBy(group).orderBy(order).rowsBetween(*before)
    values = values.select(
        group,
        order,
        F.coalesce(F.sum("_nv").over(in_group), F.lit(0)).alias("_below"),
        F.sum("_nv").over(Window.partitionBy(group)).alias("_total"),
    )
    cells = cells.withColumn("_in_value", F.coalesce(F.sum("_n").over(in_value), F.lit(0)))
    offsets = cells.join(values, [group, order]).select(
        *bucket, (F.col("_below") + F.col("_in_value")).alias("_offset"), "_total"
    )
    position = F.col("_offset") + F.col("_rn") - 1
    size = F.floor(F.col("_total") / n)
    extra = F.col("_total") % n
    wide = extra * (size + 1)
    number = F.when(position < wide, F.floor(position / (size + 1)) + 1).otherwise(
        extra + F.floor((position - wide) / F.greatest(size, F.lit(1))) + 1
    )
    return numbered.join(offsets, bucket).select(*df.columns, number.cast("int").alias(tile))


# Buckets of the values without a magnitude: minus infinity, infinity, NaN (the largest value, as in SQL).
_LOWEST, _HIGHEST, _NAN = -1_000_000, 1_000_000, 1_000_001


def _magnitude_bucket(value: Column) -> Column:
    """Monotone bucket of a number: 64 buckets per power of two."""
    infinite = F.lit(float("inf"))
    size = F.floor(F.log2(F.abs(value)) * 64).cast("long") + 100_000
    bucket = F.when(F.isnan(value), _NAN).when(value == infinite, _HIGHEST).when(value == -infinite, _LOWEST)
    return bucket.when(value == 0, 0).when(value > 0, size).otherwise(-size).cast("long")


_SLICES = 1024


class _Target:
    """Wanted rank of one percentile, over all values or over the positive ones."""

    def __init__(self, name: str, p: float, positive: bool):
        self.name = name
        skipped = F.col("_nonpos") if positive else F.lit(0).cast("long")
        rank = skipped + F.lit(p) * (F.col("_total") - skipped - 1)
        self.rank = F.when(F.col("_total") > skipped, rank)
        self.low, self.high = F.floor(self.rank), F.ceil(self.rank)

    def within(self, start: Column, n: Column) -> Column:
        return _holds(self.low, start, n) | _holds(self.high, start, n)


def _holds(rank: Column, start: Column, n: Column) -> Column:
    return (rank >= start) & (rank < start + n)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _wanted_cells(cells: DataFrame, keys: list[str], cell: str, targets: list[_Target]) -> DataFrame:
    """Cells that hold a wanted rank, with the number of values before them.

    ``cells`` has ``keys, cell, _cn`` and ``_base``, the rank at which the group of
    ``keys`` starts. Keys come back under the names ``_k0, _k1, …``.
    """
    running = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("_cn").over(running), F.lit(0))
    hit = reduce(lambda a, b: a | b, [t.within(F.col("_start"), F.col("_cn")) for t in targets])
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, cell])]
    return cells.withColumn("_start", start).where(hit).select(
        *renamed, "_start", "_total", "_nonpos", "_min", "_max"
    )


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    of_positive: dict[str, float] | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per group, without ever holding or sorting a whole group.

    ``probabilities`` maps output columns to probabilities, ``of_positive`` does so for percentiles of the
    values above zero. Nulls are ignored; NaN is the largest value.

    Equal values are counted first. The counts are cut into buckets by magnitude,
    and the few buckets that hold a wanted rank into 1,024 slices between their
    smallest and largest value; only the slices that hold a wanted rank are sorted.
    """
    keys = list(keys)
    targets = [_Target(n, p, False) for n, p in probabilities.items()]
    targets += [_Target(n, p, True) for n, p in (of_positive or {}).items()]
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .withColumn("_bucket", _magnitude_bucket(F.col("_v")))
        .groupBy(*keys, "_bucket", "_v")
        .agg(F.count("*").alias("_n"))
    )
    bounds = [F.sum("_n").alias("_cn"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    whole = Window.partitionBy(*keys)
    buckets = counted.groupBy(*keys, "_bucket").agg(*bounds).withColumns(
        {
            "_total": F.sum("_cn").over(whole),
            "_nonpos": F.sum(F.when(F.col("_max") <= 0, F.col("_cn")).otherwise(0)).over(whole),
            "_base": F.lit(0).cast("long"),
        }
    )
    wanted = _wanted_cells(buckets, keys, "_bucket", targets)
    in_bucket = [*keys, "_bucket"]
    names = [f"_k{i}" for i in range(len(in_bucket))]
    share = (F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min")) * _SLICES
    sliced = counted.join(wanted, _same(in_bucket, names)).drop(*names).withColumn(
        "_slice", F.when(F.col("_max") > F.col("_min"), F.floor(share)).otherwise(F.lit(0).cast("long"))
    )
    inside = [*in_bucket, "_slice"]
    constant = [F.first(c).alias(c) for c in ("_total", "_nonpos")]
    slices = sliced.groupBy(*inside).agg(*bounds, *constant, F.first("_start").alias("_base"))
    wanted = _wanted_cells(slices, in_bucket, "_slice", targets)
    names = [f"_k{i}" for i in range(len(inside))]
    kept = sliced.select(*inside, "_v", "_n").join(wanted, _same(inside, names)).drop(*names)
    order = Window.partitionBy(*inside).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn(
        "_at", F.col("_start") + F.coalesce(F.sum("_n").over(order), F.lit(0))
    )

    def value_at(rank: Column) -> Column:
        return F.max(F.when(_holds(rank, F.col("_at"), F.col("_n")), F.col("_v")))

    ends = []
    for t in targets:
        ends += [value_at(t.low).alias(f"_lo_{t.name}"), value_at(t.high).alias(f"_hi_{t.name}")]
    found = placed.groupBy(*keys).agg(*constant, *ends)

    def between(t: _Target) -> Column:
        low, high, share = F.col(f"_lo_{t.name}"), F.col(f"_hi_{t.name}"), t.rank - t.low
        return F.when((low == high) | (share == 0), low).otherwise(low * (1 - share) + high * share)

    return found.select(*keys, *[between(t).alias(t.name) for t in targets])
