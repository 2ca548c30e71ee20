"""Partitioned Parquet tables.

One table per layer. A write replaces only the partitions it holds rows for, so
rebuilding some hours or periods leaves the others alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.functions import calendar as cal
from panelspark.session import settle


def write_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], gather: bool = True, wanted: DataFrame | None = None
) -> None:
    """Replace the partitions present in ``df``, and drop those of ``wanted`` keys that have no rows any more.

    ``gather`` collects each partition into few files; the rebalance hint lets AQE
    split a partition that is too large for one task and merge small ones. Rows
    that already lie together by partition, such as archive hours read file by
    file, are written without that shuffle.

    Partitions are replaced first and dropped afterwards. A run that dies in between leaves old rows of dropped keys; the next
    write that wants these keys drops them.
    """
    spark, stale = df.sparkSession, None
    if wanted is not None and table_exists(spark, path):
        wanted = settle(wanted.select(*partition_by).distinct(), "wanted-keys")
        stale = settle(partition_files(spark, path, wanted, partition_by), "old-files")
        stale = None if stale.isEmpty() else stale
    rows = df.hint("rebalance", *partition_by) if gather else df
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    if stale is not None:
        left = partition_files(spark, path, wanted, partition_by).join(stale, "file", "left_semi")
        folders = left.select(F.regexp_extract("file", "(.*)/[^/]*", 1).alias("folder")).distinct()
        for row in folders.toLocalIterator():  # keys that lost all their rows
            _delete(spark, row.folder)


def partition_files(spark: SparkSession, path: str, keys: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Files (``file``) of the partitions of ``keys``; no file is opened.

    The span of the keys goes into the partition filters as literals, so only folders inside it are looked at.
    """
    files = spark.read.format("binaryFile").load(path)
    as_stored = keys.select(*[F.col(c).cast(files.schema[c].dataType).alias(c) for c in partition_by]).distinct()
    # As texts, which have no time zone; a partition column takes them as its own type.
    ends = [f(c).cast("string").alias(f"{n}_{c}") for c in partition_by for n, f in (("low", F.min), ("high", F.max))]
    span = as_stored.agg(*ends).first()
    for c in partition_by:
        low, high = span[f"low_{c}"], span[f"high_{c}"]
        if low is not None:
            kind = files.schema[c].dataType
            files = files.where(F.col(c).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))
    return files.join(as_stored, list(partition_by), "left_semi").select(F.col("path").alias("file"))


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store the session reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def append(df: DataFrame, path: str) -> None:
    """Add rows to an unpartitioned table."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def hours_of(df: DataFrame, low: dt.datetime, high: dt.datetime) -> DataFrame:
    """Rows of an hourly partitioned table between two hours, pruned to their days by partition."""
    from panelspark.sources.archive import hour_of_parts

    day = F.make_date("year", "month", "day")
    return (
        df.where(F.col("year").between(low.year, high.year))
        .where(day.between(F.lit(low.date()), F.lit(high.date())))
        .where(hour_of_parts().between(F.lit(low), F.lit(high)))
    )


def write_table(df: DataFrame, path: str) -> None:
    """Replace an unpartitioned table."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace a table by files in key order; a small table becomes one file."""
    write_table(df.orderBy(*keys), path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True if the path holds a readable Parquet table."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Read a table; without one, an empty frame if a schema is given, else an error.

    With a schema no footer is read to infer one.
    """
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as error:
        if schema is None:
            raise FileNotFoundError(f"No table at {path}") from error
        return spark.createDataFrame([], schema)


def register_table(spark: SparkSession, name: str, path: str) -> None:
    """Make a stored, partitioned layer known to the catalog as an external table."""
    spark.catalog.createTable(name, path=path, source="parquet")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)


def read_tree(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Read all matching files below a folder of mixed layout, merging their columns by name."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("mergeSchema", "true")
        .parquet(path)
    )


def read_opaque(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read an export whose files have no suffix."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_raw_hours(
    spark: SparkSession, path: str, start: str | dt.datetime, end: str | dt.datetime
) -> DataFrame:
    """Raw events of an hour range with an ``event_hour`` column, pruned by partition.

    Raises if the table holds no such hour.
    """
    from panelspark.sources.archive import hour_of_parts

    first, last = cal.cutoff_value(start), cal.cutoff_value(end)
    raw = hours_of(read_table(spark, path), first, last).withColumn("event_hour", hour_of_parts())
    if raw.select("year").isEmpty():
        raise FileNotFoundError(f"No raw hours between {first} and {last} at {path}")
    return raw


def present_hours(spark: SparkSession, path: str) -> DataFrame:
    """Hours that have a partition in an hourly table, with their row counts."""
    from panelspark.sources.archive import HOUR_PARTS, hour_of_parts

    counts = read_table(spark, path).groupBy(*HOUR_PARTS).agg(F.count("*").alias("num_rows"))
    return counts.select(hour_of_parts().alias("hour"), "num_rows")


def read_series(
    spark: SparkSession,
    path: str,
    freq: str | cal.Frequency,
    start: str | dt.datetime | None = None,
    end: str | dt.datetime | None = None,
    columns: Sequence[str] = ("unique_id", "ds", "y"),
    sort: bool = False,
) -> DataFrame:
    """Series of one frequency and range, pruned by partition and sorted only if asked."""
    df = read_table(spark, path).where(F.col("frequency") == cal.frequency(freq).name)
    if start is not None:
        low = cal.cutoff_value(start)
        df = df.where((F.col("ds_date") >= F.lit(low.date())) & (F.col("ds") >= F.lit(low)))
    if end is not None:
        high = cal.cutoff_value(end)
        df = df.where((F.col("ds_date") <= F.lit(high.date())) & (F.col("ds") <= F.lit(high)))
    df = df.select(*columns)
    return df.orderBy("unique_id", "ds") if sort else df


def read_forecasts(
    spark: SparkSession, path: str, freq: str, model: str, cutoff: str | dt.datetime
) -> DataFrame:
    """Forecasts of one model and cutoff; raises with the stored model names if absent."""
    table = read_table(spark, path)
    found = table.where(
        (F.col("frequency") == cal.frequency(freq).name)
        & (F.col("model") == model)
        & (F.col("cutoff") == F.lit(cal.cutoff_value(cutoff)))
    )
    if found.isEmpty():
        names = [r.model for r in table.select("model").distinct().orderBy("model").collect()]
        raise FileNotFoundError(f"No forecast of {model} at {cutoff}. Stored models: {names}")
    return found
