"""Registered queries that go through the stored, incremental pipeline, and their DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import quality, windows
from panelspark.plans import sample_queries as q
from panelspark.plans.benchmark import KEY_PARTS, SERIES_PARTS, Benchmark
from panelspark.session import scratch_path
from panelspark.sources import archive, tables
from panelspark.streaming import hourly

# Hours after this one of the day arrive first in the late-hours query.
LATE_BEFORE = 12
# This hour of each day is replaced by a file without entity events.
REPLACED_HOUR = 5
RESCORED = ("historic_average", q.DAILY_CUTOFFS[0])


def _write_archive(s: q.Sample, path: str, keep: str = "true") -> None:
    """Archive files of the hours that pass a test, one folder per hour."""
    events = s.all_events().where(keep)
    stamped = q._json_lines(events).select(
        F.col("line").alias("value"), cal.archive_stamp(F.col("archive_hour")).alias("stamp")
    )
    tasks = s.spark.sparkContext.defaultParallelism
    files = stamped.repartition(tasks, "stamp").write.mode("append").partitionBy("stamp")
    files.option("compression", "gzip").text(path)


def _benchmark(s: q.Sample) -> Benchmark:
    """An empty benchmark with all users as entities."""
    bench = Benchmark(s.spark, scratch_path(s.spark, "benchmark"))
    tables.write_table(s.entities(), bench.path("entities"))
    return bench


def _stored_daily(bench: Benchmark) -> DataFrame:
    rows = bench.table("series").where("frequency = 'daily'")
    return rows.select("repo_id", "repo_name", "metric", "unique_id", "ds", "y")


@q._query
def stored_series(s: q.Sample) -> DataFrame:
    """Ingest, build, build again (nothing is left to do), read back. Days with too few hours are refused."""
    source = scratch_path(s.spark, "archive")
    _write_archive(s, source)
    bench = _benchmark(s)
    bench.ingest(source)
    bench.find_first_events()
    bench.build_hourly()
    bench.build_series("daily")
    bench.build_hourly()
    again = bench.build_series("daily")
    if not again.where("is_complete").isEmpty():
        raise RuntimeError("a second build found complete periods that the first one left out")
    return _stored_daily(bench)


@q._query
def late_hours_series(s: q.Sample) -> DataFrame:
    """The stream gets the second halves of all days first, then the first halves."""
    source = scratch_path(s.spark, "landing")
    bench = _benchmark(s)
    for part in (f"hour >= {LATE_BEFORE}", f"hour < {LATE_BEFORE}"):
        _write_archive(s, source, part)
        bench.stream(source).awaitTermination()
    return _stored_daily(bench)


@q._query
def replaced_hour_series(s: q.Sample) -> DataFrame:
    """One hour of each day is replaced by a file without entity events."""
    source, again = scratch_path(s.spark, "archive"), scratch_path(s.spark, "archive-again")
    _write_archive(s, source)
    bench = _benchmark(s)
    bench.ingest(source)
    bench.build_hourly()
    _write_archive(s, again, f"hour = {REPLACED_HOUR} AND event_type = 'ErrorEvent'")
    replaced = bench.ingest(again)
    bench.build_hourly(replaced)
    bench.find_first_events()
    bench.build_series("daily")
    return _stored_daily(bench)


@q._query
def gated_series(s: q.Sample) -> DataFrame:
    """Two landings; a keyed state per day emits a day when its hours are there, also when the last of them come late."""
    source = scratch_path(s.spark, "archive")
    bench = _benchmark(s)
    row = s.hours().agg(cal.hour_key(F.min("hour")).alias("low"), cal.hour_key(F.max("hour")).alias("high")).first()
    low, high = cal.cutoff_value(row.low).date(), cal.cutoff_value(row.high).date()
    middle = low + (high - low) / 2
    # The last two days of the first landing lack their second halves.
    early = f"make_date(year, month, day) < DATE'{middle}' AND (make_date(year, month, day) < DATE'{middle}' - 2 OR hour < {LATE_BEFORE})"
    for part in (early, f"NOT ({early})"):
        landed = f"{source}/{len(part)}"
        _write_archive(s, landed, part)
        bench.ingest(landed)
        bench.find_first_events()
        bench.stream_series("daily").awaitTermination()
    return _stored_daily(bench)


@q._query
def live_hourly_counts(s: q.Sample) -> DataFrame:
    """Counts of closed hours from a stream that sends all events twice, some of them in a later batch, and very late ones."""
    events = s.all_events().withColumn("ts", F.to_timestamp("created_at"))
    low, high = (events.agg(cal.hour_key(f(F.col("ts"))).alias("k")).first().k for f in (F.min, F.max))
    low, high = cal.cutoff_value(low), cal.cutoff_value(high)
    middle = low + dt.timedelta(hours=(high - low) // dt.timedelta(hours=2))
    landing, out, state = (scratch_path(s.spark, name) for name in ("landing", "live", "live-state"))
    hour = dt.timedelta(hours=1)
    first, second = events.where(F.col("ts") < F.lit(middle)), events.where(F.col("ts") >= F.lit(middle - hour))
    late = first.where(F.col("ts") < F.lit(middle - 24 * hour)).withColumn("event_id", F.concat(F.lit("late-"), "event_id"))
    for batch in (first, second.unionAll(late)):
        batch.unionAll(batch).write.mode("append").parquet(landing)
        stream = s.spark.readStream.schema(events.schema).parquet(landing)
        hourly.stream_live(stream, out, state).awaitTermination()
    return s.spark.read.parquet(out)


@q._query
def incremental_leaderboard(s: q.Sample) -> DataFrame:
    """The leaderboard is built, one more cutoff is scored, and only its strata are computed again."""
    bench = _benchmark(s)
    tables.write_table(s.sparsity(), bench.path("sparsity"))
    metrics = s.metrics().withColumn("cutoff", cal.parse_cutoff(F.col("cutoff")))
    last = (F.col("frequency") == "daily") & (F.col("cutoff") == F.lit(cal.cutoff_value(q.DAILY_CUTOFFS[-1])))
    changed = []
    for part in (~last, last):
        tables.write_partitions(metrics.where(part), bench.path("metrics"), KEY_PARTS)
        changed.append(bench.changed_strata().count())
        bench.build_leaderboard()
    if changed[1] != 1 or not bench.changed_strata().isEmpty():
        raise RuntimeError(f"cutoffs computed again: {changed}")
    return bench.table("leaderboard")


@q._query
def stored_hours(s: q.Sample) -> DataFrame:
    """The hour ledger after a refresh of a range: kept events of each hour, 0 for an hour without any."""
    source = scratch_path(s.spark, "archive")
    _write_archive(s, source)
    bench = _benchmark(s)
    row = s.hours().agg(cal.hour_key(F.min("hour")).alias("low"), cal.hour_key(F.max("hour")).alias("high")).first()
    bench.refresh_raw(source, row.low, row.high)
    return bench.stored_hours()


def _with_panel(s: q.Sample) -> Benchmark:
    bench = _benchmark(s)
    keys = {"frequency": F.lit("daily"), "ds_date": F.to_date("ds")}
    tables.write_partitions(s.panel("daily").withColumns(keys), bench.path("series"), SERIES_PARTS)
    return bench


@q._query
def stored_forecasts(s: q.Sample) -> DataFrame:
    """One key is forecast first, then all; the stored one is skipped."""
    bench = _with_panel(s)
    bench.run_forecasts("daily", q.DAILY_CUTOFFS[:1], ["zero_model"], window=q.DAILY_WINDOW)
    bench.run_forecasts("daily", q.DAILY_CUTOFFS, window=q.DAILY_WINDOW)
    return bench.forecasts("daily").select(s.backtest().columns)


@q._query
def refused_forecasts(s: q.Sample) -> DataFrame:
    """Cutoffs without a full history are reported per key, and the others are forecast."""
    bench = _with_panel(s)
    failed = bench.run_forecasts("daily", q.EDGE_CUTOFFS, ["zero_model", "historic_average"], window=q.DAILY_WINDOW)
    made = bench.forecasts("daily").groupBy("model", "cutoff").agg(F.lit("ok").alias("status"))
    return failed.select("model", "cutoff", F.col("error").alias("status")).unionByName(made)


@q._query
def rescored_metrics(s: q.Sample) -> DataFrame:
    """A key loses its forecasts' values, is scored again, and its metrics go."""
    bench = _with_panel(s)
    bench.run_forecasts("daily", q.DAILY_CUTOFFS, window=q.DAILY_WINDOW)
    bench.run_evaluations("daily", q.DAILY_CUTOFFS, window=q.DAILY_WINDOW)
    model, cutoff = RESCORED
    spoilt = bench.forecasts("daily").where((F.col("model") == model) & (cal.hour_key(F.col("cutoff")) == f"{cutoff}-00"))
    spoilt = q.settle(spoilt.withColumn("yhat", F.lit(None).cast("double")), "spoilt")
    tables.write_partitions(spoilt, bench.path("forecasts"), ["frequency", "model", "cutoff"])
    bench.run_evaluations("daily", q.DAILY_CUTOFFS, window=q.DAILY_WINDOW, overwrite=True)
    return bench.metrics()


@q._query
def fractional_stats(s: q.Sample) -> DataFrame:
    """Window statistics of fractional values: the monthly mean price of orders with an odd and an even key."""
    orders = q.sample.table(s.spark, s.sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, "even:price").otherwise("odd:price")
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    panel = orders.groupBy(name.alias("unique_id"), month.alias("ds")).agg(F.avg("o_totalprice").alias("y"))
    stats = windows.rolling_stats(panel, q.MONTHLY_CUTOFFS, "monthly", q.MONTHLY_WINDOW)
    return stats.select("cutoff", "unique_id", "n_obs", *[F.round(c, 2).alias(c) for c in _MEASURES])


_MEASURES = ("mean_y", "mean_abs_y", "sd_y", "mean_abs_diff", "sd_season")


@q._query
def calendar_grids(s: q.Sample) -> DataFrame:
    """Cutoff ranges, aggregation keys, label grids and hour ranges over the span of the events."""
    key = lambda f: cal.hour_key(F.date_trunc("hour", f(F.col("ts").cast("timestamp"))))
    row = q.sample.table(s.spark, s.sf_dir, "events").agg(key(F.min).alias("low"), key(F.max).alias("high")).first()
    low, high = row.low, cal.cutoff_value(row.high)
    day = low[:10]
    parts = []
    for freq in ("hourly", "daily", "weekly", "monthly"):
        for kind, grid in (
            ("cutoffs", cal.cutoff_range(s.spark, freq, day, high)),
            ("keys", cal.aggregation_grid(s.spark, freq, day, high)),
            ("labels", cal.label_grid(s.spark, freq, day, high)),
        ):
            parts.append(grid.select(F.lit(f"{kind}:{freq}").alias("grid"), F.col(grid.columns[0]).alias("at")))
    parts.append(cal.hours_between(s.spark, low, row.high).select(F.lit("hours").alias("grid"), F.col("hour").alias("at")))
    parts.append(cal.previous_hours(s.spark, 24, high).select(F.lit("previous").alias("grid"), F.col("hour").alias("at")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@q._query
def ragged_events(s: q.Sample) -> DataFrame:
    """Archive lines with odd ids, names and payloads, and a few that are no JSON."""
    ev = s.all_events()
    n = F.col("event_id").cast("long") % 10
    number = F.col("repo_id").cast("string")
    repo = (
        F.when(n == 0, F.lit("null"))
        .when(n == 1, F.format_string('{"id": %s.0, "name": "%s"}', number, "repo_name"))
        .when(n == 2, F.format_string('{"id": "%s", "name": "%s"}', number, "repo_name"))
        .when(n == 3, F.format_string('{"id": %s, "name": 7}', number))
        .otherwise(F.format_string('{"id": %s, "name": "%s"}', number, "repo_name"))
    )
    payload = (
        F.when(n == 4, F.lit('["a"]')).when(n == 5, F.lit('{"distinct_size": 3.7, "action": 1}')).when(n == 6, F.lit('{"distinct_size": true}'))
        .otherwise(F.lit('{"distinct_size": 2, "action": "opened"}'))
    )
    line = F.format_string('{"id": %s, "type": "PushEvent", "created_at": "x", "repo": %s, "payload": %s}', "event_id", repo, payload)
    line = F.when(n == 7, F.lit("  ")).when(n == 8, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    lines = ev.select(archive.hour_of_parts().alias("archive_hour"), line.alias("line"))
    return archive.flatten_events(archive.parse_lines(lines)).select("event_id", "repo_id", "repo_name", "action", "push_distinct_size")


@q._query
def file_ledger(s: q.Sample) -> DataFrame:
    """Daily files of which some are there, some empty, some no Parquet and some missing."""
    root = scratch_path(s.spark, "daily-files")
    days = s.hours().select(F.to_date("hour").alias("date")).distinct()
    parts = cal.partition_values(F.col("date").cast("timestamp"), "daily")
    days = q.settle(days.withColumns(parts).withColumn("k", F.dayofmonth("date") % 4), "days")
    full = s.activity().select(F.to_date("event_hour").alias("date"), "repo_id").join(days.where("k = 0"), "date")
    full.select("repo_id", *parts).repartition(1).write.partitionBy(*parts).parquet(root)
    for row in days.where("k = 1").select(cal.partition_path(F.col("date").cast("timestamp"), "daily").alias("folder")).toLocalIterator():
        s.spark.createDataFrame([], "repo_id BIGINT").coalesce(1).write.parquet(f"{root}/{row.folder}")
    odd = days.where("k = 2").select(F.lit("not parquet").alias("value"), *parts)
    odd.repartition(1).write.mode("append").partitionBy(*parts).text(root)
    found = s.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    date = F.make_date(*[F.regexp_extract("path", f"{p}=(\\d+)", 1).cast("int") for p in ("year", "month", "day")])
    uri = root if ":" in root else f"file:{root}"
    absent = F.concat(F.lit(f"{uri}/"), F.col("date").cast("string"), F.lit("/none.parquet"))
    files = days.join(found.select(date.alias("date"), "path"), "date", "left")
    files = files.select(F.col("date").cast("string").alias("key"), F.coalesce("path", absent).alias("path"))
    return quality.validate_files(files).select("key", "status", "num_rows")


# --- SQL -----------------------------------------------------------------------------------

_FILES = "SELECT DISTINCT event_hour AS hour FROM raw"


def _series(kept: str) -> str:
    """Daily series of the days of which 90 % of the hours have a file, from the entity's first hour on."""
    return f"""
  SELECT e.repo_id, e.repo_name, m.metric, e.repo_id || ':' || m.metric AS unique_id,
    CAST(d.p AS TIMESTAMP) AS ds, coalesce(y, 0)::BIGINT AS y
  FROM entities e
  JOIN (SELECT repo_id, min(event_hour) AS first_hour FROM ({kept}) GROUP BY repo_id) f USING (repo_id)
  JOIN (SELECT date_trunc('day', hour) AS p, max(hour) AS last_found FROM ({_FILES}) GROUP BY 1 HAVING count(*) >= 0.9 * 24) d
    ON f.first_hour <= d.last_found
  CROSS JOIN metric_names m
  LEFT JOIN (
    SELECT repo_id, date_trunc('day', event_hour) AS p, {{case}} AS metric, count(*) AS y FROM ({kept}) GROUP BY ALL
  ) c ON c.repo_id = e.repo_id AND c.p = d.p AND c.metric = m.metric"""


def _grids() -> str:
    units = {"hourly": ("HOUR", 24), "daily": ("DAY", 7), "weekly": ("WEEK", 1), "monthly": ("MONTH", 1)}
    first = {
        "hourly": "day", "daily": "day", "weekly": "day + to_days(CAST((7 - isodow(day)) % 7 AS INTEGER))",
        "monthly": "CASE WHEN day(day) > 1 THEN date_trunc('month', day) + INTERVAL 1 MONTH ELSE day END",
    }
    # The reference point of the day boundary is a fixed midnight, so it is the last midnight.
    ends = {"cutoffs": "high", "keys": "date_trunc('day', high)", "labels": "high"}
    parts = []
    for freq, (unit, h) in units.items():
        for kind, end in ends.items():
            step = f"INTERVAL {h if kind == 'cutoffs' else 1} {unit}"
            drop = kind == "cutoffs" and freq in ("weekly", "monthly")
            points = f"generate_series(CAST({first[freq]} AS TIMESTAMP), CAST({end} AS TIMESTAMP), {step})"
            parts.append(f"SELECT '{kind}:{freq}' AS grid, unnest({points + '[:-2]' if drop else points}) AS at FROM span")
    parts.append("SELECT 'hours', unnest(generate_series(low, high, INTERVAL 1 HOUR)) FROM span")
    parts.append("SELECT 'previous', unnest(generate_series(high - INTERVAL 24 HOUR, high - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) FROM span")
    span = """SELECT CAST(date_trunc('hour', min(ts)) AS TIMESTAMP) AS low, CAST(date_trunc('hour', max(ts)) AS TIMESTAMP) AS high,
      CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS day FROM events"""
    return f"WITH span AS ({span}) " + " UNION ALL ".join(parts)


def bodies(metric_case: str, stats, rounded, history) -> dict[str, str]:
    """SQL bodies by query name; the arguments are the helpers of the other statements."""
    b = {}
    series = _series("SELECT * FROM kept").format(case=metric_case)
    b["stored_series"] = b["late_hours_series"] = b["gated_series"] = series
    b["live_hourly_counts"] = """SELECT repo_id, event_hour,
        count_if(event_type = 'WatchEvent')::BIGINT AS stars,
        count_if(event_type = 'PullRequestEvent' AND action = 'opened')::BIGINT AS prs_opened,
        count_if(event_type = 'IssuesEvent' AND action = 'opened')::BIGINT AS issues_opened,
        count_if(event_type = 'PushEvent')::BIGINT AS pushes, count(*) AS n_events
      FROM kept WHERE event_hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM kept) - INTERVAL 2 HOUR
      GROUP BY repo_id, event_hour"""
    b["replaced_hour_series"] = _series(f"SELECT * FROM kept WHERE hour <> {REPLACED_HOUR} OR event_hour NOT IN (SELECT event_hour FROM raw WHERE event_type = 'ErrorEvent')").format(case=metric_case)
    b["stored_hours"] = """SELECT event_hour AS hour,
        count_if(event_type IN ('WatchEvent', 'PullRequestEvent', 'IssuesEvent', 'PushEvent'))::BIGINT AS num_rows
      FROM raw WHERE event_hour BETWEEN (SELECT min(hour) FROM hours) AND (SELECT max(hour) FROM hours) GROUP BY 1"""
    b["refused_forecasts"] = f"""SELECT model, cutoff,
        CASE WHEN found = {q.DAILY_WINDOW} THEN 'ok' ELSE 'missing_history' END AS status
      FROM (SELECT unnest(['zero_model', 'historic_average']) AS model) CROSS JOIN (
        SELECT cutoff, count(DISTINCT ds) AS found FROM (
          SELECT unnest([{", ".join(f"TIMESTAMP '{c} 00:00:00'" for c in q.EDGE_CUTOFFS)}]) AS cutoff) c
        LEFT JOIN daily ON ds > cutoff - INTERVAL {q.DAILY_WINDOW} DAY AND ds <= cutoff GROUP BY cutoff)"""
    panel = """(SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even:price' ELSE 'odd:price' END AS unique_id,
        CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ds, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"""
    past = history(panel, q.MONTHLY_CUTOFFS, q.MONTHLY_WINDOW)
    b["fractional_stats"] = f"""SELECT cutoff, unique_id, n_obs, {", ".join(f"round({m}, 2) AS {m}" for m in _MEASURES)}
      FROM ({stats(f"({past})", 12)})"""
    b["calendar_grids"] = _grids()
    b["ragged_events"] = """SELECT event_id, repo_id, repo_name, action, push_distinct_size FROM (
      SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(event_id AS BIGINT) % 10 AS n,
        CASE WHEN n <> 2 THEN repo_id END AS repo_id, repo_name,
        CASE WHEN n NOT IN (4, 5, 6) THEN 'opened' END AS action,
        CASE n WHEN 4 THEN NULL WHEN 5 THEN 3 WHEN 6 THEN 1 ELSE 2 END::INTEGER AS push_distinct_size FROM raw)
      WHERE n NOT IN (0, 3, 7, 8)"""
    b["file_ledger"] = """SELECT strftime(day, '%Y-%m-%d') AS key,
        CASE WHEN k = 0 AND n > 0 THEN 'ok' WHEN k = 1 THEN 'empty' WHEN k = 2 THEN 'unreadable' ELSE 'missing' END AS status,
        CASE WHEN k = 0 THEN coalesce(n, 0) ELSE 0 END::BIGINT AS num_rows
      FROM (SELECT DISTINCT CAST(hour AS DATE) AS day, day(CAST(hour AS DATE)) % 4 AS k FROM hours)
      LEFT JOIN (SELECT CAST(event_hour AS DATE) AS day, count(DISTINCT (repo_id, event_hour)) AS n FROM kept GROUP BY 1) USING (day)"""
    return b
