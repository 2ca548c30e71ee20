"""Registered queries over stored layers, file layouts and texts, and their DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import entities as ent
from panelspark.operators import forecasting, leaderboard as board, series
from panelspark.plans import sample_queries as q
from panelspark.plans.benchmark import HOUR_PARTS, KEY_PARTS, SERIES_PARTS
from panelspark.session import scratch_path
from panelspark.sources import archive, tables

ONE_FORECAST = ("historic_average", q.DAILY_CUTOFFS[1])
# Months in which an entity may be active.
MONTHS = (dt.datetime(2024, 1, 1, tzinfo=cal.UTC), dt.datetime(2025, 1, 1, tzinfo=cal.UTC))


@q._query
def raw_hour_scan(s: q.Sample) -> DataFrame:
    """Some columns of the raw layer between its first and last hour."""
    path = scratch_path(s.spark, "raw")
    kept = s.all_events().where(archive.kept_events())
    tables.write_partitions(kept, path, HOUR_PARTS)
    hour = archive.hour_of_parts()
    row = kept.agg(cal.hour_key(F.min(hour)).alias("low"), cal.hour_key(F.max(hour)).alias("high")).first()
    return tables.read_raw_hours(s.spark, path, row.low, row.high).select("event_id", "repo_id", "event_type", "event_hour")


def _series_layer(s: q.Sample) -> str:
    path = scratch_path(s.spark, "series")
    keys = {"frequency": F.lit("daily"), "ds_date": F.to_date("ds")}
    tables.write_partitions(s.panel("daily").withColumns(keys), path, SERIES_PARTS)
    return path


@q._query
def sorted_series(s: q.Sample) -> DataFrame:
    """The stored daily series from the first cutoff on, read in order of series and time."""
    return tables.read_series(s.spark, _series_layer(s), "daily", start=q.DAILY_CUTOFFS[0], sort=True)


@q._query
def external_table(s: q.Sample) -> DataFrame:
    """The series layer as a table of the catalog."""
    name = f"series_{uuid.uuid4().hex}"
    tables.register_table(s.spark, name, _series_layer(s))
    return s.spark.table(name).where("frequency = 'daily'").groupBy("ds_date").agg(F.count("*").alias("n"), F.sum("y").alias("y"))


@q._query
def opaque_export(s: q.Sample) -> DataFrame:
    """Two columns of an exported entity table."""
    path = scratch_path(s.spark, "export")
    tables.write_table(s.stats(), path)
    return tables.read_opaque(s.spark, path, ["repo_id", "total_events"])


@q._query
def metrics_tree(s: q.Sample) -> DataFrame:
    """Metrics below folders of mixed depth, some without a series id, as long scores."""
    root = scratch_path(s.spark, "tree")
    metrics, zero = s.metrics(), F.col("model") == "zero_model"
    tables.write_table(metrics.where(zero), f"{root}/a/zero")
    tables.write_table(metrics.where(~zero).drop("unique_id"), f"{root}/others")
    long = board.raw_long(tables.read_tree(s.spark, root), s.sparsity())
    return long.select("unique_id", "model", "frequency", "cutoff", "metric", "sparsity_level", "value")


@q._query
def one_forecast(s: q.Sample) -> DataFrame:
    """Stored forecasts of one model and cutoff; a missing one is named in an error that lists the stored models."""
    path = scratch_path(s.spark, "forecasts")
    tables.write_partitions(s.backtest(), path, KEY_PARTS)
    model, cutoff = ONE_FORECAST
    try:
        tables.read_forecasts(s.spark, path, "daily", "other_model", cutoff)
        raise RuntimeError("a missing forecast was found")
    except FileNotFoundError as error:
        if not all(name in str(error) for name in forecasting.BASELINES):
            raise
    found = tables.read_forecasts(s.spark, path, "daily", model, cutoff)
    return found.select("unique_id", "ds", "yhat", "q_10", "q_90")


@q._query
def actor_logins(s: q.Sample) -> DataFrame:
    """Logins that are texts, numbers, null or missing; only texts count."""
    n = F.col("event_id").cast("long") % 4
    login = F.when(n == 0, F.concat(F.lit('"'), "actor_login", F.lit('"'))).when(n == 1, F.col("actor_id").cast("string")).otherwise("null")
    actor = F.when(n == 3, F.lit("{}")).otherwise(F.format_string('{"id": %s, "login": %s}', F.col("actor_id").cast("string"), login))
    line = F.format_string('{"id": %s, "type": "PushEvent", "repo": {"name": "a"}, "actor": %s}', "event_id", actor)
    lines = s.all_events().select(archive.hour_of_parts().alias("archive_hour"), line.alias("line"))
    return archive.flatten_events(archive.parse_lines(lines)).select("event_id", "actor_id", "actor_login")


@q._query
def active_months(s: q.Sample) -> DataFrame:
    """Calendar months with an event, by entity."""
    return ent.entity_stats(s.all_events(), 2024, *MONTHS, unit="month").select("repo_id", "active_units")


@q._query
def completeness_texts(s: q.Sample) -> DataFrame:
    """Refused days of the ledger of purchase hours, with the reason."""
    return series.completeness_message(series.completeness(q._purchase_hours(s), "daily"))


@q._query
def hours_of_periods(s: q.Sample) -> DataFrame:
    """All hours of every day, week and month that has an event."""
    hours = s.hours()
    parts = [
        hours.select(F.lit(f).alias("frequency"), cal.period_index(F.col("hour"), f).alias("idx")).distinct()
        .select("frequency", cal.period_start(F.col("idx"), f).alias("start"), F.explode(cal.period_hours(F.col("idx"), f)).alias("hour"))
        for f in ("daily", "weekly", "monthly")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def bodies() -> dict[str, str]:
    """SQL bodies by query name."""
    model, cutoff = ONE_FORECAST
    counts = ", ".join(f"round({c}, 6) AS {c}" for c in ("yhat", "q_10", "q_90"))
    units = {"daily": ("day", "1 DAY"), "weekly": ("week", "7 DAY"), "monthly": ("month", "1 MONTH")}
    hours = " UNION ALL ".join(
        f"""SELECT '{f}' AS frequency, CAST(start AS TIMESTAMP) AS start,
          unnest(generate_series(CAST(start AS TIMESTAMP), start + INTERVAL {step} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour
        FROM (SELECT DISTINCT date_trunc('{unit}', hour) AS start FROM hours)"""
        for f, (unit, step) in units.items()
    )
    return {
        "raw_hour_scan": "SELECT event_id, repo_id, event_type, event_hour FROM kept",
        "sorted_series": f"""SELECT unique_id, ds, y FROM daily WHERE ds >= TIMESTAMP '{q.DAILY_CUTOFFS[0]} 00:00:00'
          ORDER BY unique_id, ds""",
        "external_table": "SELECT CAST(ds AS DATE) AS ds_date, count(*) AS n, sum(y)::BIGINT AS y FROM daily GROUP BY 1",
        "opaque_export": "SELECT repo_id, total_events FROM entity_year",
        "metrics_tree": """SELECT CASE WHEN model = 'zero_model' THEN unique_id
              ELSE subdataset || ':' || model || ':' || cutoff || ':' || frequency END AS unique_id,
            model, frequency, cutoff, metric, CASE WHEN model = 'zero_model' THEN sparsity_level ELSE 'unknown' END AS sparsity_level,
            round(value, 6) AS value FROM raw_long""",
        "one_forecast": f"""SELECT unique_id, ds, {counts} FROM d_fc
          WHERE model = '{model}' AND cutoff = TIMESTAMP '{cutoff} 00:00:00'""",
        "actor_logins": """SELECT event_id, CASE WHEN n <> 3 THEN actor_id END AS actor_id, CASE WHEN n = 0 THEN actor_login END AS actor_login
          FROM (SELECT *, CAST(event_id AS BIGINT) % 4 AS n FROM raw)""",
        "active_months": """SELECT repo_id, count(DISTINCT date_trunc('month', ts)) AS active_units FROM kept
          WHERE year = 2024 GROUP BY repo_id""",
        "completeness_texts": """SELECT 'daily' AS frequency, CAST(d AS TIMESTAMP) AS ds,
            printf('Data completeness (%.2f%%) too low: found %d/%d hours', n / 24.0 * 100, n, 24) AS error
          FROM (SELECT date_trunc('day', hour) AS d, count(*) AS n FROM purchase_hours GROUP BY 1) WHERE n / 24.0 < 0.9""",
        "hours_of_periods": hours,
    }
