"""The stored benchmark: layers as partitioned tables, built incrementally.

Each layer is one table below ``root``. A build finds the keys that are expected
but not stored, makes all of them in one job and replaces only their partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.constants import KEEP_EVENT_TYPES
from panelspark.functions import calendar as cal
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
from panelspark.session import configure, settle
from panelspark.sources import archive, tables
from panelspark.streaming import completeness, hourly

HOUR_PARTS = list(archive.HOUR_PARTS)
SERIES_PARTS = ["frequency", "ds_date"]
KEY_PARTS = ["frequency", "model", "cutoff"]
HOURS_SCHEMA = "hour TIMESTAMP, num_rows BIGINT, n_bad BIGINT, loaded_at TIMESTAMP"
# Archive hours matched by name in one job.
MAX_LISTED_HOURS = 2_000


class Benchmark:
    """Tables of one benchmark and the steps that fill them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.root = root.rstrip("/")

    def path(self, layer: str) -> str:
        """Path of a layer's table."""
        return f"{self.root}/{layer}"

    def table(self, layer: str) -> DataFrame:
        """A stored layer; raises if it is not there."""
        return tables.read_table(self.spark, self.path(layer))

    def has(self, layer: str) -> bool:
        """True if a layer is stored."""
        return tables.table_exists(self.spark, self.path(layer))

    # --- raw hours -----------------------------------------------------------------

    def stored_hours(self) -> DataFrame:
        """Hours whose archive file was read, with their kept events; the hour ledger of the later steps.

        The ledger is a small table of its own that ingest appends to; the last row of an hour counts.
        """
        rows = tables.read_table(self.spark, self.path("hours"), HOURS_SCHEMA)
        last = rows.groupBy("hour").agg(F.max_by(F.struct("num_rows", "n_bad"), "loaded_at").alias("r"))
        return last.where("r.num_rows IS NOT NULL").select("hour", "r.num_rows")

    def refused_hours(self) -> DataFrame:
        """Hours whose last file had unreadable lines and was left out, with the number of these."""
        rows = tables.read_table(self.spark, self.path("hours"), HOURS_SCHEMA)
        last = rows.groupBy("hour").agg(F.max_by("n_bad", "loaded_at").alias("n_bad"))
        return last.where("n_bad > 0")

    def _store_hours(self, events: DataFrame, hours: DataFrame, bad: DataFrame) -> DataFrame:
        """Replace the raw hours whose files were read, also by none; returns the replaced hours.

        An hour refused for unreadable lines keeps what it had.
        """
        read = settle(hours.join(bad, "hour", "left_anti"), "read-hours")
        parts = {name: col for name, col in cal.partition_values(F.col("hour"), "hourly").items()}
        tables.write_partitions(events, self.path("raw"), HOUR_PARTS, gather=False, wanted=read.withColumns(parts))
        counts = events.groupBy(archive.hour_of_parts().alias("hour")).agg(F.count("*").alias("num_rows"))
        good = read.join(counts, "hour", "left").select(
            "hour", F.coalesce("num_rows", F.lit(0).cast("long")).alias("num_rows"), F.lit(0).cast("long").alias("n_bad")
        )
        refused = bad.select("hour", F.lit(None).cast("long").alias("num_rows"), "n_bad")
        before = self.stored_hours().select("hour", F.col("num_rows").alias("kept"))
        refused = refused.join(before, "hour", "left").select("hour", F.col("kept").alias("num_rows"), "n_bad")
        found = settle(good.unionAll(refused).withColumn("loaded_at", F.current_timestamp()), "hour-rows")
        tables.append(found, self.path("hours"))
        return read

    def ingest(
        self,
        source: str,
        hours: Iterable[str] | None = None,
        strict: bool = True,
        keep: Iterable[str] = KEEP_EVENT_TYPES,
    ) -> DataFrame:
        """Flatten archive files into the raw table; only the given hours if any. Returns the hours that were read."""
        hours, keep = None if hours is None else list(hours), tuple(keep)
        lines = archive.read_lines(self.spark, source, hours=hours)
        projected = archive.project_events(archive.parse_lines(lines))
        if strict:
            events, bad = archive.split_bad_hours(projected, keep)
        else:
            events = settle(projected.where(archive.kept_events(keep)).drop("bad"), "flat-events")
            bad = self.spark.createDataFrame([], "hour TIMESTAMP, n_bad BIGINT")
        files = archive.file_hours(self.spark, source, hours)
        return self._store_hours(archive.with_hour_parts(events), files, bad)

    def refresh_raw(self, source: str, start: str, end: str, known: Iterable[str] = ()) -> DataFrame:
        """Check all hours of a range and ingest those that are missing or empty."""
        expected = cal.hours_between(self.spark, start, end).select(cal.hour_key(F.col("hour")).alias("key"))

        def validate(keys: DataFrame) -> DataFrame:
            present = self.stored_hours().select(cal.hour_key(F.col("hour")).alias("key"), "num_rows")
            return quality.validate_keys(keys, present)

        def build(keys: DataFrame) -> None:
            # File names are matched against literals, so that other files are not opened; a bounded number at a time.
            some: list[str] = []
            for row in keys.orderBy("key").toLocalIterator():
                some.append(row.key)
                if len(some) == MAX_LISTED_HOURS:
                    self.ingest(source, hours=some)
                    some = []
            if some:
                self.ingest(source, hours=some)

        return quality.refresh(
            self.spark, self.path("ledger/raw"), expected, validate, build, known, strict=False
        )

    def stream(self, source: str, freqs: Iterable[str] = ("daily",), files_per_batch: int = 1000) -> StreamingQuery:
        """Ingest all archive files that are new since the last run, then stop.

        A file holds a whole hour, so a new file of a stored hour replaces it. The
        hourly counts of the touched hours and the series of the touched periods
        are rebuilt with each batch; repeating a batch changes nothing.
        """
        freqs = list(freqs)

        def write(batch: DataFrame, number: int) -> None:
            good, bad, files = archive.stage_hours(batch)  # a batch is computed anew at each use, so it is used once
            hours = self._store_hours(archive.with_hour_parts(good), files, bad)
            if not self.has("entities") or hours.isEmpty():
                return
            raw = self._raw_of(hours)
            moved = self._merge_first_events(series.first_events(raw, self.table("entities")))
            self.build_hourly(hours)
            # An entity that turns out to be older has zero rows to gain in all periods between.
            late = self.stored_hours().select("hour").join(
                moved, F.col("hour").between(F.col("low"), F.col("high")), "left_semi"
            )
            hours = settle(hours.unionAll(late).distinct(), "touched-hours")
            for freq in freqs:
                self.build_series(freq, touched=hours)

        return (
            hourly.stream_archive(self.spark, source, files_per_batch)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", self.path("stream-state"))
            .trigger(availableNow=True)
            .start()
        )

    # --- entities ----------------------------------------------------------------------

    def select_entities(self, year: int, **options) -> None:
        """Choose the entities from a year of raw events and find their first hours."""
        raw = self.table("raw")
        tables.write_table(ent.select_entities(raw, year, **options), self.path("entities"))
        self.find_first_events()

    def find_first_events(self) -> None:
        """Store the first raw hour of each entity."""
        first = series.first_events(self.table("raw"), self.table("entities"))
        tables.write_table(first, self.path("first_events"))

    def _merge_first_events(self, found: DataFrame) -> DataFrame:
        """Lower stored first hours to earlier ones in new events; returns the span ``low, high`` they moved over, one row."""
        none = "repo_id BIGINT, first_hour TIMESTAMP"
        old = tables.read_table(self.spark, self.path("first_events"), none)
        both = old.unionByName(found.select(*old.columns))
        merged = settle(both.groupBy("repo_id").agg(F.min("first_hour").alias("first_hour")), "first")
        was = old.select("repo_id", F.col("first_hour").alias("was"))
        moved = merged.join(was, "repo_id").where("first_hour < was")
        moved = settle(moved.agg(F.min("first_hour").alias("low"), F.max("was").alias("high")), "moved")
        tables.write_table(merged, self.path("first_events"))
        return moved

    # --- series --------------------------------------------------------------------------

    def _span(self, times: DataFrame, column: str) -> tuple[dt.datetime, dt.datetime] | None:
        """First and last time of a column; None without rows."""
        low, high = (cal.hour_key(f(F.col(column))) for f in (F.min, F.max))
        row = times.agg(low.alias("low"), high.alias("high")).first()
        return None if row.low is None else (cal.cutoff_value(row.low), cal.cutoff_value(row.high))

    def _raw_of(self, hours: DataFrame) -> DataFrame:
        """Raw events of some hours: pruned to their days by partition, then to the hours."""
        span = self._span(hours, "hour")
        raw = self.table("raw")
        raw = tables.hours_of(raw, *span) if span else raw.limit(0)
        parts = cal.partition_values(F.col("hour"), "hourly")
        return raw.join(hours.select(*[c.alias(n) for n, c in parts.items()]).distinct(), HOUR_PARTS, "left_semi")

    def build_hourly(self, hours: DataFrame | None = None) -> None:
        """Sparse hourly counts of the stored hours that were not counted yet, or of the given hours.

        The hours counted are noted in a table of their own, as one without entity events leaves no counts.
        """
        if hours is None:
            hours = self.stored_hours().select("hour")
            hours = hours.join(tables.read_table(self.spark, self.path("hourly_done"), "hour TIMESTAMP"), "hour", "left_anti")
        hours = settle(hours.select("hour").distinct(), "hours")
        if hours.isEmpty():
            return
        activity = series.hourly_activity(self._raw_of(hours), self.table("entities"))
        parts = cal.partition_values(F.col("event_hour"), "hourly")
        wanted = hours.withColumns(cal.partition_values(F.col("hour"), "hourly"))
        tables.write_partitions(activity.withColumns(parts), self.path("hourly"), HOUR_PARTS, wanted=wanted)
        tables.append(hours, self.path("hourly_done"))

    def _activity(self, hours: DataFrame) -> DataFrame:
        """Hourly counts, pruned to the days of the given hours."""
        span = self._span(hours, "hour")
        counts = self.table("hourly")
        return (tables.hours_of(counts, *span) if span else counts.limit(0)).drop(*HOUR_PARTS)

    def build_series(self, freq: str, overwrite: bool = False, touched: DataFrame | None = None) -> DataFrame:
        """Period series of all complete periods that are not stored; returns their status.

        ``touched`` hours name the periods to rebuild instead.
        """
        f = cal.frequency(freq)
        hours = settle(self.stored_hours().select("hour"), "hour-ledger")
        status = series.completeness(hours, f)
        if touched is not None:
            idx = touched.select(cal.period_index(F.col("hour"), f).alias("idx")).distinct()
            status = status.join(idx, "idx", "left_semi")
        elif not overwrite and self.has("series"):
            done = self.table("series").where(F.col("frequency") == f.name).select("ds").distinct()
            status = status.join(done, "ds", "left_anti")
        status = settle(status, "period-status")
        wanted = settle(
            hours.join(
                status.select(F.col("idx").alias("_i")), cal.period_index(F.col("hour"), f) == F.col("_i"), "left_semi"
            ),
            "wanted-hours",
        )
        if wanted.isEmpty():
            return status
        panel = series.period_series(
            self._activity(wanted), self.table("entities"), self.table("first_events"), wanted, f
        )
        keys = {"frequency": F.lit(f.name), "ds_date": F.to_date("ds")}
        tables.write_partitions(
            panel.withColumns(keys), self.path("series"), SERIES_PARTS, wanted=status.select("ds").withColumns(keys)
        )
        return status

    def stream_series(self, freq: str, grace: str = "3 days") -> StreamingQuery:
        """Build the periods that the hours read since the last run complete, then stop.

        Hours are taken from the ledger as a stream; a keyed state per period decides. The status of periods,
        also of those refused because their time is over, is appended to the layer ``gate``.
        """
        f, path = cal.frequency(freq), self.path("hours")

        def write(batch: DataFrame, number: int) -> None:
            status = settle(batch, "gate")
            noted = status.withColumns({"frequency": F.lit(f.name), "batch": F.lit(number)})
            noted.write.mode("overwrite").parquet(f"{self.path('gate')}/run={f.name}-{number}")
            done = status.where("status = 'complete'").select(F.col("idx").alias("_i"))
            if done.isEmpty():
                return
            self.build_hourly()
            hours = self.stored_hours().select("hour")
            hours = hours.join(done.distinct(), cal.period_index(F.col("hour"), f) == F.col("_i"), "left_semi")
            self.build_series(f.name, touched=settle(hours, "gated-hours"))

        ledger = self.spark.readStream.schema(HOURS_SCHEMA).parquet(path).where("num_rows IS NOT NULL").select("hour")
        return (
            completeness.gate_periods(ledger, f, grace).writeStream.foreachBatch(write)
            .option("checkpointLocation", self.path(f"gate-state-{f.name}"))
            .trigger(availableNow=True)
            .start()
        )

    def validate_series(self, freq: str, start: str, end: str) -> DataFrame:
        """Ledger of the stored periods of a range."""
        rows = tables.read_series(self.spark, self.path("series"), freq, start, end)
        return quality.validate_periods(rows, freq, start, end)

    def build_sparsity(self, year: int | None = None) -> None:
        """Sparsity levels from the stored daily series."""
        daily = self.table("series").where("frequency = 'daily'")
        if year is not None:
            low, high = dt.date(year, 1, 1), dt.date(year, 12, 31)
            daily = daily.where(F.col("ds_date").between(F.lit(low), F.lit(high)))
        tables.write_table(sparsity.series_sparsity(daily), self.path("sparsity"))

    def panel(self, freq: str) -> DataFrame:
        """Stored series of one frequency as ``unique_id, ds, y``."""
        return tables.read_series(self.spark, self.path("series"), freq)

    # --- forecasts and scores --------------------------------------------------------------

    def _missing(self, layer: str, freq: str, models: list[str], cutoffs: list) -> DataFrame:
        """Keys of (models x cutoffs) that a layer does not hold."""
        frame = windows.cutoff_frame(self.spark, cutoffs, freq)
        names = F.array(*[F.lit(m) for m in models])
        keys = frame.select(F.explode(names).alias("model"), "cutoff")
        if not self.has(layer):
            return keys
        done = self.table(layer).where(F.col("frequency") == cal.frequency(freq).name)
        done = done.select("model", F.col("cutoff").cast("timestamp").alias("cutoff")).distinct()
        return keys.join(done, ["model", "cutoff"], "left_anti")

    def run_forecasts(
        self,
        freq: str,
        cutoffs: Iterable[str | dt.datetime],
        models: Iterable[str] = forecasting.BASELINES,
        window: int | None = None,
        overwrite: bool = False,
    ) -> DataFrame:
        """Forecast all missing keys; returns the keys that could not be made, with the reason.

        Stored keys are skipped first. Of the others, a cutoff whose history has a gap or whose series do not end
        at it is reported and the rest goes on. Models that miss the same cutoffs run in one job.
        """
        f, cutoffs, models = cal.frequency(freq), list(cutoffs), list(models)
        layer, panel = "forecasts", self.panel(freq)
        wanted = {m: set(windows.listed_cutoffs(cutoffs, f)) for m in models}
        if not overwrite:
            keys = self._missing(layer, freq, models, cutoffs)
            rows = keys.select("model", cal.hour_key(F.col("cutoff")).alias("key")).collect()  # at most models x cutoffs
            wanted = {m: {cal.cutoff_value(r.key) for r in rows if r.model == m} for m in models}
        asked = sorted(set().union(*wanted.values()))
        none = "model STRING, cutoff TIMESTAMP, n_failed BIGINT, error STRING"
        failed = self.spark.createDataFrame([], none)
        if not asked:
            return failed
        refused = {cal.cutoff_value(r.key): (r.n, r.error) for r in forecasting.refused_cutoffs(panel, asked, f.name, window).collect()}
        rows = [(m, c, *refused[c]) for m, mine in wanted.items() for c in sorted(mine) if c in refused]
        failed = failed.unionAll(self.spark.createDataFrame(rows, none))
        groups: dict[tuple, list[str]] = {}
        for m, mine in wanted.items():
            if good := tuple(sorted(mine - set(refused))):
                groups.setdefault(good, []).append(m)
        for good, names in groups.items():
            out, bad = forecasting.forecast(panel, good, f, names, window=window)
            keys = windows.cutoff_frame(self.spark, good, f).select(
                F.lit(f.name).alias("frequency"), F.explode(F.array(*map(F.lit, names))).alias("model"), "cutoff"
            )
            tables.write_partitions(out, self.path(layer), KEY_PARTS, wanted=keys)
            failed = failed.unionByName(bad)
        return failed

    def forecasts(self, freq: str) -> DataFrame:
        """Stored forecasts of one frequency."""
        rows = self.table("forecasts").where(F.col("frequency") == cal.frequency(freq).name)
        return rows.withColumn("cutoff", F.col("cutoff").cast("timestamp"))

    def run_evaluations(
        self,
        freq: str,
        cutoffs: Iterable[str | dt.datetime],
        models: Iterable[str] = forecasting.BASELINES,
        window: int | None = None,
        overwrite: bool = False,
        **options,
    ) -> DataFrame:
        """Score all forecast keys without metrics; returns the status of each."""
        cutoffs, models = list(cutoffs), list(models)
        rows = self.forecasts(freq).where(F.col("model").isin(models))
        if not overwrite:
            keys = settle(self._missing("metrics", freq, models, cutoffs), "missing-keys")
            rows = rows.join(keys, ["model", "cutoff"], "left_semi")
        else:
            rows = rows.where(F.col("cutoff").isin([cal.cutoff_value(c) for c in cutoffs]))
        metrics, status = evaluation.evaluate(rows, self.panel(freq), cutoffs, freq, window, **options)
        metrics = metrics.withColumn("cutoff", cal.parse_cutoff(F.col("cutoff")))
        keys = status.select(F.lit(cal.frequency(freq).name).alias("frequency"), "model", "cutoff")
        tables.write_partitions(metrics, self.path("metrics"), KEY_PARTS, wanted=keys)
        return status

    def metrics(self) -> DataFrame:
        """Stored metrics of all frequencies, with the cutoff as key text."""
        key = cal.hour_key(F.col("cutoff").cast("timestamp"))
        return self.table("metrics").withColumn("cutoff", key).select(*evaluation.METRIC_COLUMNS)

    def _metric_files(self) -> DataFrame:
        """Per frequency and cutoff of the metrics: a checksum of the names of its files, which change with every write."""
        files = self.spark.read.format("binaryFile").load(self.path("metrics"))
        name = F.hash(F.regexp_extract("path", "([^/]*/[^/]*)$", 1)).cast("long")
        return files.groupBy("frequency", F.col("cutoff").cast("timestamp").alias("cutoff")).agg(
            F.sum(name).alias("files"), F.count("*").alias("n_files")
        )

    def changed_strata(self) -> DataFrame:
        """Frequencies and cutoffs whose metrics were written or dropped since the leaderboard was last built.

        With another sparsity table it is all of them.
        """
        now = self._metric_files()
        schema = "frequency STRING, cutoff TIMESTAMP, files BIGINT, n_files BIGINT"
        before = tables.read_table(self.spark, self.path("leaderboard_state/keys"), schema)
        keys = ["frequency", "cutoff"]
        digest = tables.read_table(self.spark, self.path("leaderboard_state/sparsity"), "digest BIGINT")
        same = digest.join(self._sparsity_digest(), "digest", "left_semi").count()
        if not same:
            return now.select(*keys).unionAll(before.select(*keys)).distinct()
        kept = now.join(before, now.columns, "left_semi").select(*keys)
        return now.select(*keys).unionAll(before.select(*keys)).distinct().join(kept, keys, "left_anti")

    def _sparsity_digest(self) -> DataFrame:
        rows = self.table("sparsity").select(F.xxhash64("unique_id", "sparsity_level").alias("h"))
        return rows.agg(F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).bitwiseXOR(F.count("*")).alias("digest"))

    def build_leaderboard(self) -> DataFrame:
        """Store the sorted leaderboard; returns its gap counts.

        Only the strata of changed cutoffs are computed, from metrics pruned to them; the others are read from the last
        build. The grid spans the names of all strata, so a new model also shows in the old cutoffs.
        """
        changed = settle(self.changed_strata(), "changed-strata")
        state = settle(self._metric_files(), "leaderboard-state")
        by_frequency: dict[str, list] = {}
        for r in changed.select("frequency", cal.hour_key(F.col("cutoff")).alias("key")).toLocalIterator():
            by_frequency.setdefault(r.frequency, []).append(cal.cutoff_value(r.key))
        if by_frequency:
            wanted = F.lit(False)
            for name, cutoffs in by_frequency.items():  # literals on partition columns
                wanted |= (F.col("frequency") == name) & F.col("cutoff").cast("timestamp").isin(cutoffs)
            key = cal.hour_key(F.col("cutoff").cast("timestamp"))
            metrics = self.table("metrics").where(wanted).withColumn("cutoff", key)
            scored = board.stratum_scores(metrics.select(*evaluation.METRIC_COLUMNS), self.table("sparsity"))
            scored = scored.withColumn("cutoff", cal.parse_cutoff(F.col("cutoff")))
            tables.write_partitions(scored, self.path("strata"), ["frequency", "cutoff"], wanted=changed)
            tables.write_table(state, self.path("leaderboard_state/keys"))
            tables.write_table(self._sparsity_digest(), self.path("leaderboard_state/sparsity"))
        key = cal.hour_key(F.col("cutoff").cast("timestamp"))
        result = board.from_strata(settle(self.table("strata").withColumn("cutoff", key), "strata"))
        tables.write_sorted(result, self.path("leaderboard"), board.SORT_KEYS)
        return board.leaderboard_gaps(self.table("leaderboard"))
