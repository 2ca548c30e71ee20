"""Helpers of these tests."""

import datetime as dt

from pyspark.sql import functions as F


def utc(text):
    """UTC datetime of an ISO text."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def rows(df, *order):
    """Rows as tuples with naive timestamps, sorted."""
    fixed = [
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if f.dataType.simpleString() == "timestamp"
        else F.col(f.name)
        for f in df.schema
    ]
    found = [tuple(r) for r in df.select(*fixed).collect()]
    return sorted(found, key=lambda r: [(v is None, 0 if v is None else v) for v in r])


def panel_of(spark, series, start="2026-01-01", step="D"):
    """Panel frame of ``{unique_id: [y, ...]}`` from a common first day."""
    import pandas as pd

    data = [
        (uid, t.to_pydatetime().replace(tzinfo=dt.timezone.utc), int(y))
        for uid, values in series.items()
        for t, y in zip(pd.date_range(start, periods=len(values), freq=step), values)
        if y is not None
    ]
    return spark.createDataFrame(data, "unique_id STRING, ds TIMESTAMP, y BIGINT")
