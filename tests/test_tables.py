import re

import pytest
from helpers import utc
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.sources import archive, tables

PARTS = list(archive.HOUR_PARTS)


def hours(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "key STRING")
    return df.withColumns(cal.partition_values(cal.parse_cutoff(F.col("key")), "hourly"))


def stored(spark, layer):
    return {(r.month, r.day, r.hour) for r in tables.read_table(spark, layer).collect()}


@pytest.fixture()
def layer(spark, tmp_path):
    path = f"{tmp_path}/layer"
    first = hours(spark, *(f"2026-{m:02d}-{d:02d}-{h:02d}" for m in (1, 2) for d in (3, 4) for h in (0, 5)))
    tables.write_partitions(first, path, PARTS)
    return path


def test_wanted_keys_without_rows_go(spark, layer):
    wanted = hours(spark, "2026-01-03-00", "2026-01-03-05", "2026-01-03-07")
    tables.write_partitions(hours(spark, "2026-01-03-05", "2026-01-03-07"), layer, PARTS, wanted=wanted)
    assert stored(spark, layer) == {(1, 3, 5), (1, 3, 7), (1, 4, 0), (1, 4, 5), *((2, d, h) for d in (3, 4) for h in (0, 5))}


def test_a_dropped_key_goes_with_the_next_write(spark, layer):
    """Old rows that a run left behind by dying before it dropped them."""
    wanted = hours(spark, "2026-01-03-00", "2026-01-03-05")
    tables.write_partitions(hours(spark, "2026-01-03-05"), layer, PARTS)  # as if it died there
    tables.write_partitions(hours(spark, "2026-01-03-05"), layer, PARTS, wanted=wanted)
    assert {k for k in stored(spark, layer) if k[:2] == (1, 3)} == {(1, 3, 5)}


def test_files_are_pruned_to_the_keys(spark, layer):
    files = tables.partition_files(spark, layer, hours(spark, "2026-01-03-00", "2026-01-03-05"), PARTS)
    assert files.count() == 2 and all("month=1/day=3" in r.file for r in files.collect())
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        again = tables.partition_files(spark, layer, hours(spark, "2026-01-03-00", "2026-01-03-05"), PARTS)
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    for test in (r"month#\d+ >= 1", r"month#\d+ <= 1", r"day#\d+ >= 3", r"day#\d+ <= 3"):
        assert re.search(test, filters)


def test_timestamp_and_null_keys(spark, tmp_path):
    path = f"{tmp_path}/keys"
    df = spark.createDataFrame([("m", utc("2026-01-04"), 1), (None, utc("2026-01-05"), 2)], "model STRING, cutoff TIMESTAMP, v INT")
    tables.write_partitions(df, path, ["model", "cutoff"])
    tables.write_partitions(df.where("v = 2"), path, ["model", "cutoff"], wanted=df)
    assert [r.v for r in tables.read_table(spark, path).collect()] == [2]
