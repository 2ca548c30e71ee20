"""Registered queries over the sample tables.

Every query covers its whole tables. Steps the stored pipeline keeps as tables
(hourly activity, panels, scores) are staged here as well, so a query
reads the events once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.functions import scoring
from panelspark.operators import (
    entities as ent,
    evaluation,
    forecasting,
    leaderboard as board,
    quality,
    series,
    sparsity,
    windows,
)
from panelspark.session import configure, scratch_path, settle
from panelspark.sources import archive, sample_tables as sample
from panelspark.streaming import hourly

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the sample benchmark.
DAILY_CUTOFFS = ("2024-01-16", "2024-01-23")
EARLY_CUTOFFS = ("2024-01-02", "2024-01-03", "2024-01-16")
EDGE_CUTOFFS = ("2024-01-03", "2024-01-16", "2024-01-23", "2024-01-29")
DAILY_WINDOW = 14
EARLY_WINDOW = 2
WEEKLY_CUTOFFS = ("2024-01-14", "2024-01-21")
WEEKLY_WINDOW = 2
MONTHLY_CUTOFFS = ("2001-05-01", "2001-06-01")
MONTHLY_WINDOW = 24
HOURLY_WINDOW = 168
HOURLY_STATS_WINDOW = 168
OWN_STEP = 5
GUARD_CUTOFFS = (*EDGE_CUTOFFS, "2024-01-30")
RENAMED_AT = "2024-01-16-06"
SELECTION = {
    "year": 2024,
    "unit": "week",
    "active_from": dt.datetime(2024, 1, 1, tzinfo=cal.UTC),
    "active_to": dt.datetime(2024, 1, 29, tzinfo=cal.UTC),
}
REQUIRED_WEEKS = 4
TOP_SHARE = 0.5
SAMPLE_SIZES = {"large": 20, "medium": 10, "low": 10}
PREVIEW_ROWS = 20


# --- shared stages -----------------------------------------------------------------


class Sample:
    """Stages of the sample benchmark for one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._stages: dict[str, DataFrame] = {}

    def _stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._stages:
            self._stages[name] = settle(make(), name)
        return self._stages[name]

    def all_events(self) -> DataFrame:
        return sample.all_events(self.spark, self.sf_dir)

    def activity(self) -> DataFrame:
        return self._stage("activity", lambda: series.hourly_activity(self.all_events()))

    def entities(self) -> DataFrame:
        ids = self.activity().select("repo_id").distinct()
        return ids.withColumn("repo_name", F.concat(F.lit("user/"), F.col("repo_id")))

    def first(self) -> DataFrame:
        return series.first_activity(self.activity())

    def hours(self) -> DataFrame:
        """All hours between the first and last one with activity."""
        span = self.activity().agg(
            F.min("event_hour").alias("low"), F.max("event_hour").alias("high")
        )
        step = F.expr("INTERVAL 1 HOUR")
        return span.select(F.explode(F.sequence("low", "high", step)).alias("hour"))

    def series(self, freq: str) -> DataFrame:
        if freq == "hourly":
            return series.hourly_series(self.activity(), self.entities(), self.first(), self.hours())
        return series.period_series(
            self.activity(), self.entities(), self.first(), self.hours(), freq
        )

    def panel(self, freq: str) -> DataFrame:
        if freq == "monthly":
            return self._stage("monthly", lambda: sample.monthly_orders(self.spark, self.sf_dir))
        return self._stage(freq, lambda: self.series(freq).select("unique_id", "metric", "ds", "y"))

    def backtest(self, freq: str = "daily", cutoffs=DAILY_CUTOFFS, window: int = DAILY_WINDOW) -> DataFrame:
        return forecasting.forecast_native(self.panel(freq), cutoffs, freq, window=window)

    def joined(self) -> DataFrame:
        actual = windows.actuals(self.panel("daily"), DAILY_CUTOFFS, "daily")
        return evaluation.join_actuals(self.backtest(), actual)

    def scales(self) -> DataFrame:
        return evaluation.train_scales(self.panel("daily"), DAILY_CUTOFFS, "daily", DAILY_WINDOW)

    def evaluated(self, freq: str, cutoffs, window: int) -> tuple[DataFrame, DataFrame]:
        rows = self.backtest(freq, cutoffs, window)
        return evaluation.evaluate(rows, self.panel(freq), cutoffs, freq, window)

    def metrics(self) -> DataFrame:
        """Daily, weekly and monthly metrics; the frequencies are independent jobs.

        They are the staged scores of the keys that passed, so they are not written once more.
        """
        runs = [
            ("daily", DAILY_CUTOFFS, DAILY_WINDOW),
            ("weekly", WEEKLY_CUTOFFS, WEEKLY_WINDOW),
            ("monthly", MONTHLY_CUTOFFS, MONTHLY_WINDOW),
        ]
        if "metrics" not in self._stages:
            self.activity()
            with ThreadPoolExecutor(len(runs)) as pool:
                parts = list(pool.map(lambda run: self.evaluated(*run)[0], runs))
            self._stages["metrics"] = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return self._stages["metrics"]

    def sparsity(self) -> DataFrame:
        return sparsity.series_sparsity(self.panel("daily"))

    def long_scores(self) -> DataFrame:
        return self._stage("long", lambda: board.raw_long(self.metrics(), self.sparsity()))

    def leaderboard(self) -> DataFrame:
        return board.leaderboard(self.metrics(), self.sparsity())

    def stats(self) -> DataFrame:
        return ent.entity_stats(self.all_events(), **SELECTION)


# --- output helpers -------------------------------------------------------------------


def _output(df: DataFrame) -> DataFrame:
    """Timestamps as naive UTC and doubles rounded, as the SQL side returns them."""
    columns = []
    for field in df.schema:
        col, kind = F.col(field.name), field.dataType.simpleString()
        if kind == "timestamp":
            col = col.cast("timestamp_ntz")
        elif kind == "double":
            col = F.round(col, 6)
        columns.append(col.alias(field.name))
    return df.select(*columns)


_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Sample], DataFrame]) -> Callable[[Sample], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _output(build(Sample(spark, sf_dir)))

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    """Registered queries by name."""
    return dict(_QUERIES)


# --- sources and projection --------------------------------------------------------------


@_query
def flatten_filter_events(s: Sample) -> DataFrame:
    return s.all_events().where(archive.kept_events())


def _json_lines(ev: DataFrame) -> DataFrame:
    """Sample events as archive lines: nested JSON text with an hour."""
    document = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        "created_at",
        F.struct(F.col("repo_id").alias("id"), F.col("repo_name").alias("name")).alias("repo"),
        F.struct(F.col("actor_id").alias("id"), F.col("actor_login").alias("login")).alias("actor"),
        F.struct("action", F.col("push_distinct_size").alias("distinct_size")).alias("payload"),
    )
    return ev.select(archive.hour_of_parts().alias("archive_hour"), F.to_json(document).alias("line"))


@_query
def flatten_json_events(s: Sample) -> DataFrame:
    parsed = archive.parse_lines(_json_lines(s.all_events()))
    return archive.with_hour_parts(archive.flatten_events(parsed))


@_query
def archive_files(s: Sample) -> DataFrame:
    lines = _json_lines(s.all_events())
    path = scratch_path(s.spark, "archive")
    stamped = lines.select(F.col("line").alias("value"), cal.archive_stamp(F.col("archive_hour")).alias("stamp"))
    tasks = s.spark.sparkContext.defaultParallelism
    hourly_files = stamped.repartition(tasks, "stamp").write.partitionBy("stamp")
    hourly_files.option("compression", "gzip").text(path)
    return archive.read_archive(s.spark, path)


# --- calendar ---------------------------------------------------------------------------------


@_query
def hour_grid(s: Sample) -> DataFrame:
    hours = s.hours()
    return hours.select(
        "hour",
        cal.hour_key(F.col("hour")).alias("hour_key"),
        cal.archive_stamp(F.col("hour")).alias("stamp"),
    )


@_query
def period_bounds(s: Sample) -> DataFrame:
    hours = s.hours()
    columns = []
    for freq in ("daily", "weekly", "monthly"):
        previous = cal.previous_period(F.col("hour"), freq)
        idx = cal.period_index(F.col("hour"), freq) - 1
        columns += [
            previous["start"].alias(f"{freq}_start"),
            previous["last_hour"].alias(f"{freq}_end"),
            previous["ds"].alias(f"{freq}_ds"),
            cal.expected_hours(idx, freq).alias(f"{freq}_hours"),
        ]
    return hours.select("hour", *columns)


@_query
def iso_partitions(s: Sample) -> DataFrame:
    orders = sample.table(s.spark, s.sf_dir, "orders")
    days = orders.select(F.col("o_orderdate").cast("timestamp").alias("ts")).distinct()
    weekly = cal.partition_values(F.col("ts"), "weekly")
    daily = cal.partition_values(F.col("ts"), "daily")
    iso = [col.alias(f"iso_{name}") for name, col in weekly.items()]
    return days.select("ts", *iso, *[col.alias(name) for name, col in daily.items()])


@_query
def cutoff_grid(s: Sample) -> DataFrame:
    """Cutoffs one horizon apart between the first and last period of each series."""
    panel = s.panel("daily").groupBy("unique_id").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    step = F.expr(f"INTERVAL {cal.frequency('daily').h} DAY")
    points = F.explode(F.sequence("first", "last", step))
    return panel.select("unique_id", points.alias("cutoff")).withColumn(
        "cutoff_key", cal.hour_key(F.col("cutoff"))
    )


@_query
def parse_cutoffs(s: Sample) -> DataFrame:
    ev = sample.table(s.spark, s.sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd-HH"))
        .when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_type") == "signup", F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.col("event_type"))
    )
    return ev.select("event_id", text.alias("text"), cal.parse_cutoff(text).alias("cutoff"))


# --- entities ------------------------------------------------------------------------------------


@_query
def entity_stats(s: Sample) -> DataFrame:
    return s.stats().drop("active_units")


@_query
def active_periods(s: Sample) -> DataFrame:
    return s.stats().select("repo_id", "active_units")


@_query
def eligible_entities(s: Sample) -> DataFrame:
    return ent.eligible_entities(s.stats(), REQUIRED_WEEKS)


@_query
def entity_percent_rank(s: Sample) -> DataFrame:
    eligible = settle(ent.eligible_entities(s.stats(), REQUIRED_WEEKS), "eligible")
    ranked = ent.rank_entities(eligible, TOP_SHARE)
    return ranked.select("repo_id", "stars", "star_prank_all", "star_prank_upper", "size_bucket")


def _sample(s: Sample, sample_hash: str) -> DataFrame:
    return ent.select_entities(
        s.all_events(),
        **SELECTION,
        required_active=REQUIRED_WEEKS,
        top_share=TOP_SHARE,
        sizes=SAMPLE_SIZES,
        sample_hash=sample_hash,
    )


@_query
def entity_sample(s: Sample) -> DataFrame:
    return _sample(s, "md5")


@_query
def entity_sample_xxh64(s: Sample) -> DataFrame:
    return _sample(s, "xxh64")


@_query
def first_events(s: Sample) -> DataFrame:
    eligible = settle(ent.eligible_entities(s.stats(), REQUIRED_WEEKS), "eligible")
    return series.first_events(s.all_events(), eligible)


# --- series ----------------------------------------------------------------------------------------


@_query
def hourly_counts_sparse(s: Sample) -> DataFrame:
    return series.hourly_counts(s.all_events())


@_query
def hourly_series(s: Sample) -> DataFrame:
    return s.series("hourly")


@_query
def daily_series(s: Sample) -> DataFrame:
    return s.series("daily")


@_query
def weekly_series(s: Sample) -> DataFrame:
    return s.series("weekly")


@_query
def monthly_series(s: Sample) -> DataFrame:
    return sample.monthly_orders(s.spark, s.sf_dir)


@_query
def renamed_series(s: Sample) -> DataFrame:
    """Entities with an even id get a new name in the middle of a day; each day has the name of its last hour."""
    moved = (F.col("repo_id") % 2 == 0) & (archive.hour_of_parts() >= F.lit(cal.cutoff_value(RENAMED_AT)))
    name = F.when(moved, F.concat(F.lit("moved/"), F.col("repo_id"))).otherwise(F.col("repo_name"))
    events = s.all_events().where(archive.kept_events()).withColumn("repo_name", name)
    return series.with_names(s.series("daily"), series.name_history(events), "daily")


@_query
def repeated_entities(s: Sample) -> DataFrame:
    """Entities listed under two names."""
    renamed = s.entities().where("repo_id % 3 = 0").withColumn("repo_name", F.concat(F.lit("moved/"), F.col("repo_id")))
    return ent.duplicate_entities(s.entities().unionByName(renamed))


@_query
def rollup_series(s: Sample) -> DataFrame:
    return series.rollup_series(s.series("hourly"), s.hours(), "daily")


def _purchase_hours(s: Sample) -> DataFrame:
    """Hours with a pull request event: a ledger with natural gaps."""
    opened = s.all_events().where("event_type = 'PullRequestEvent'")
    return opened.select(archive.hour_of_parts().alias("hour")).distinct()


@_query
def completeness(s: Sample) -> DataFrame:
    hours = settle(_purchase_hours(s), "ledger")
    daily = series.completeness(hours, "daily")
    weekly = series.completeness(hours, "weekly")
    return daily.unionByName(weekly).drop("idx")


@_query
def series_sparsity(s: Sample) -> DataFrame:
    return s.sparsity()


def _first_window(s: Sample) -> DataFrame:
    return windows.history(s.panel("daily"), DAILY_CUTOFFS[:1], "daily", DAILY_WINDOW)


@_query
def series_preview(s: Sample) -> DataFrame:
    return windows.preview(_first_window(s))


@_query
def series_head(s: Sample) -> DataFrame:
    return windows.head(_first_window(s), PREVIEW_ROWS).select("unique_id", "ds", "y")


# --- windows -------------------------------------------------------------------------------------------


@_query
def history_window(s: Sample) -> DataFrame:
    return windows.history(s.panel("daily"), DAILY_CUTOFFS, "daily", DAILY_WINDOW)


@_query
def actuals_window(s: Sample) -> DataFrame:
    return windows.actuals(s.panel("daily"), DAILY_CUTOFFS, "daily")


@_query
def rolling_stats(s: Sample) -> DataFrame:
    stats = windows.rolling_stats(s.panel("daily"), DAILY_CUTOFFS, "daily", DAILY_WINDOW)
    return stats.drop("tail")


def _own_cutoffs(s: Sample) -> DataFrame:
    """A cutoff every ``OWN_STEP`` days of each series, from its own first day on."""
    span = s.panel("daily").groupBy("unique_id").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    points = F.sequence("first", "last", F.expr(f"INTERVAL {OWN_STEP} DAY"))
    return span.select("unique_id", F.explode(points).alias("cutoff"))


@_query
def own_cutoff_history(s: Sample) -> DataFrame:
    return windows.history(s.panel("daily"), _own_cutoffs(s), "daily", DAILY_WINDOW)


@_query
def own_cutoff_actuals(s: Sample) -> DataFrame:
    return windows.actuals(s.panel("daily"), _own_cutoffs(s), "daily")


@_query
def own_cutoff_stats(s: Sample) -> DataFrame:
    return windows.rolling_stats(s.panel("daily"), _own_cutoffs(s), "daily", DAILY_WINDOW).drop("tail")


@_query
def hourly_fraction_stats(s: Sample) -> DataFrame:
    """Window statistics of hourly shares: each series' part of the entity's events of the hour, windows of 168 hours."""
    whole = F.sum("y").over(Window.partitionBy("repo_id", "ds"))
    share = F.when(whole > 0, F.col("y") / whole).otherwise(F.lit(0.0))
    panel = s.series("hourly").select("unique_id", "ds", share.alias("y"))
    stats = windows.rolling_stats(panel, DAILY_CUTOFFS, "hourly", HOURLY_STATS_WINDOW, season=24)
    return stats.drop("tail")


@_query
def hourly_backtest(s: Sample) -> DataFrame:
    """Hourly forecasts of 24 steps from one season of history."""
    return forecasting.forecast_native(s.panel("hourly"), DAILY_CUTOFFS, "hourly", window=HOURLY_WINDOW)


@_query
def hourly_metrics(s: Sample) -> DataFrame:
    return s.evaluated("hourly", DAILY_CUTOFFS, HOURLY_WINDOW)[0]


@_query
def guard_window(s: Sample) -> DataFrame:
    return windows.window_presence(s.panel("daily"), EDGE_CUTOFFS, "daily", DAILY_WINDOW, h=7)


@_query
def guard_alignment(s: Sample) -> DataFrame:
    counts = series.hourly_counts(s.all_events())
    daily = counts.groupBy("unique_id", F.date_trunc("day", "ds").alias("ds")).agg(F.sum("y").alias("y"))
    return windows.alignment(daily, DAILY_CUTOFFS, "daily", DAILY_WINDOW)


# --- forecasts --------------------------------------------------------------------------------------------


def _forecast(s: Sample, model: str) -> DataFrame:
    return forecasting.forecast_native(
        s.panel("daily"), DAILY_CUTOFFS, "daily", [model], window=DAILY_WINDOW
    )


@_query
def forecast_zero(s: Sample) -> DataFrame:
    return _forecast(s, "zero_model")


@_query
def forecast_historic_average(s: Sample) -> DataFrame:
    return _forecast(s, "historic_average")


@_query
def forecast_seasonal_naive(s: Sample) -> DataFrame:
    return _forecast(s, "seasonal_naive")


@_query
def forecast_backtest(s: Sample) -> DataFrame:
    return s.backtest()


@_query
def forecast_monthly(s: Sample) -> DataFrame:
    return s.backtest("monthly", MONTHLY_CUTOFFS, MONTHLY_WINDOW)


def _sample_models() -> dict:
    """Sample pandas models; local functions travel to the tasks without this package."""

    import numpy as np

    def steps(past, h):
        return past["ds"].to_numpy()[-1] + np.arange(1, h + 1).astype("timedelta64[D]")

    def window_median(past, h, freq, quantiles):
        """Median and empirical quantiles of the history."""
        y = past["y"].to_numpy().astype("float64")
        y = y[~np.isnan(y)]
        names = ["yhat", *(f"q_{round(q * 100)}" for q in quantiles)]
        values = np.percentile(y, [50.0, *(q * 100 for q in quantiles)]) if len(y) else np.full(len(names), np.nan)
        return {"ds": steps(past, h)} | {name: np.full(h, v) for name, v in zip(names, values)}

    def last_value(past, h, freq):
        """Point forecasts only."""
        return {"ds": steps(past, h), "yhat": np.full(h, float(past["y"].iloc[-1]))}

    return {"WindowMedian": window_median, "LastValue": last_value}


def _forecast_pandas(s: Sample, name: str, alias: str) -> DataFrame:
    if name not in forecasting.model_names():
        forecasting.register_model(name, alias, fn=_sample_models()[alias])
    rows, _ = forecasting.forecast(
        s.panel("daily"), DAILY_CUTOFFS, "daily", [name], window=DAILY_WINDOW
    )
    return rows


@_query
def forecast_udf(s: Sample) -> DataFrame:
    return _forecast_pandas(s, "window_median", "WindowMedian")


@_query
def forecast_point_only(s: Sample) -> DataFrame:
    rows = _forecast_pandas(s, "last_value", "LastValue")
    quantiles = [F.col(scoring.quantile_column(q)) for q in scoring.quantile_levels(rows.columns)]
    found = F.size(F.array_compact(F.array(*quantiles)))
    return rows.select("model", "cutoff", "unique_id", "ds", "yhat", found.alias("n_quantiles"))


@_query
def forecast_model_file(s: Sample) -> DataFrame:
    wide = forecasting.to_model_file(s.backtest(), "historic_average")
    return forecasting.from_model_file(wide, "historic_average", "daily")


# --- scores -----------------------------------------------------------------------------------------------


@_query
def mae_by_series(s: Sample) -> DataFrame:
    return evaluation.mae(s.joined())


@_query
def mase_by_series(s: Sample) -> DataFrame:
    return evaluation.mase(s.joined(), s.scales())


@_query
def pinball_by_quantile(s: Sample) -> DataFrame:
    joined = settle(s.joined(), "joined")
    keys = [*evaluation.SERIES, "level"]
    ours = evaluation.quantile_loss(joined)
    textbook = evaluation.quantile_loss(joined, "standard").withColumnRenamed("loss", "standard_loss")
    return ours.join(textbook, keys)


@_query
def scaled_crps(s: Sample) -> DataFrame:
    return evaluation.scaled_crps(s.joined(), s.scales())


def _without_spread(s: Sample) -> DataFrame:
    """Forecasts that lack the top quantile of series without spread."""
    flat = F.col("q_90") == F.col("q_10")
    return s.backtest().withColumn("q_90", F.when(~flat, F.col("q_90")))


@_query
def quantile_fill(s: Sample) -> DataFrame:
    actual = windows.actuals(s.panel("daily"), DAILY_CUTOFFS, "daily")
    joined = evaluation.join_actuals(_without_spread(s), actual)
    return evaluation.fill_quantiles(joined)


@_query
def guard_quantiles(s: Sample) -> DataFrame:
    scores = evaluation.series_scores(
        _without_spread(s), s.panel("daily"), DAILY_CUTOFFS, "daily", DAILY_WINDOW
    )
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_fill")]
    counts = scores.groupBy("model", "cutoff").agg(*sums)
    return counts.withColumn("fillable", F.col("n_fill") < F.col("n_rows") * 0.05)


@_query
def evaluate_metrics(s: Sample) -> DataFrame:
    return s.evaluated("daily", DAILY_CUTOFFS, DAILY_WINDOW)[0]


@_query
def guard_leakage(s: Sample) -> DataFrame:
    return evaluation.leakage(s.backtest())


def _early(s: Sample) -> tuple[DataFrame, DataFrame]:
    """Backtest with cutoffs before some series start or just after; guards refuse them."""
    rows = forecasting.forecast_native(
        s.panel("daily"), EARLY_CUTOFFS, "daily", ["zero_model", "historic_average"], window=EARLY_WINDOW
    )
    return evaluation.evaluate(rows, s.panel("daily"), EARLY_CUTOFFS, "daily", EARLY_WINDOW)


@_query
def guard_status(s: Sample) -> DataFrame:
    """Status of keys whose forecasts are spoilt in different ways, and of cutoffs at the ends of the data."""
    rows = s.backtest("daily", GUARD_CUTOFFS, DAILY_WINDOW)
    day = F.expr("INTERVAL 1 DAY")
    key = lambda model, cutoff: (F.col("model") == model) & (cal.hour_key(F.col("cutoff")) == f"{cutoff}-00")
    first, second = DAILY_CUTOFFS
    next_day = F.col("ds") == F.col("cutoff") + day
    # A series has forecasts at the cutoffs it has a row at.
    forecast = windows.history(s.panel("daily"), GUARD_CUTOFFS, "daily", 1)
    lost = F.col("unique_id") == forecast.select(F.min("unique_id")).scalar()
    rows = rows.where(~(key("historic_average", second) & lost))
    changes = {"ds": F.when(key("zero_model", first) & next_day, F.col("cutoff") - day).otherwise(F.col("ds"))}
    for level in scoring.quantile_levels(rows.columns):
        name = scoring.quantile_column(level)
        gone = key("historic_average", first)
        if level == 50:
            gone |= next_day & (key("seasonal_naive", first) | (key("seasonal_naive", second) & lost))
        changes[name] = F.when(~gone, F.col(name))
    _, status = evaluation.evaluate(rows.withColumns(changes), s.panel("daily"), GUARD_CUTOFFS, "daily", DAILY_WINDOW)
    return status.select("model", "cutoff", "status")


@_query
def guard_nulls(s: Sample) -> DataFrame:
    _, status = _early(s)
    return status.select("model", "cutoff", "n_actual", "n_matched", "n_unmatched", "status")


@_query
def guard_nan(s: Sample) -> DataFrame:
    metrics, _ = _early(s)
    undefined = F.count_if(F.col("mase").isNull() | F.isnan("mase"))
    return metrics.groupBy("model", "cutoff").agg(
        F.count("*").alias("n_series"), undefined.alias("n_undefined")
    )


# --- leaderboard --------------------------------------------------------------------------------------------


@_query
def metrics_unpivot(s: Sample) -> DataFrame:
    return board.raw_long(s.metrics(), s.sparsity())


@_query
def stratum_median(s: Sample) -> DataFrame:
    return board.stratum_medians(s.long_scores())


@_query
def zero_denominator(s: Sample) -> DataFrame:
    return board.zero_denominators(s.long_scores())


@_query
def scaled_scores(s: Sample) -> DataFrame:
    long = s.long_scores()
    return board.scaled_scores(board.stratum_medians(long), board.zero_denominators(long))


@_query
def leaderboard_grid(s: Sample) -> DataFrame:
    long = s.long_scores()
    return board.full_grid(long)


@_query
def leaderboard(s: Sample) -> DataFrame:
    return board.sorted_leaderboard(s.leaderboard())


@_query
def leaderboard_gaps(s: Sample) -> DataFrame:
    return board.leaderboard_gaps(s.leaderboard())


# --- quality and streaming --------------------------------------------------------------------------------


def _hour_keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(cal.hour_key(F.col(column)).alias("key"))


def _ledger(s: Sample) -> DataFrame:
    """All hours of the events against the hours that have a pull request event."""
    opened = s.all_events().where("event_type = 'PullRequestEvent'")
    present = opened.select(cal.hour_key(archive.hour_of_parts()).alias("key"))
    present = present.groupBy("key").agg(F.count("*").alias("num_rows"))
    return quality.validate_keys(_hour_keys(s.hours(), "hour"), present)


@_query
def ledger_status(s: Sample) -> DataFrame:
    known = [f"2024-01-01-{h:02d}" for h in range(24)]
    ledger = quality.mark_known_issues(_ledger(s), known)
    return ledger.select("key", "status", "num_rows", "error")


@_query
def ledger_counts(s: Sample) -> DataFrame:
    return quality.status_counts(_ledger(s))


@_query
def pending_keys(s: Sample) -> DataFrame:
    return quality.pending(_hour_keys(s.hours(), "hour"), _ledger(s))


@_query
def stream_hourly_counts(s: Sample) -> DataFrame:
    schema = sample.table(s.spark, s.sf_dir, "events").schema
    source = (
        s.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    )
    out, checkpoint = scratch_path(s.spark, "streamed"), scratch_path(s.spark, "stream-state")
    query = hourly.stream_hourly(sample.map_events(source), out, checkpoint)
    query.awaitTermination()
    return hourly.read_streamed(s.spark, out)
