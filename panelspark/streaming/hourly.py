"""Hourly counts from a stream of events.

Each micro-batch is reduced to its own hourly counts and written under its batch
number; a repeated batch overwrites itself, so results are exactly-once. Reading
adds the batches up, or, for archive files that hold a whole hour each, takes each hour from the
last batch that brought its file. Late events are simply part of a later batch: nothing is
dropped, and no state grows with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.constants import KEEP_EVENT_TYPES, METRICS
from panelspark.operators.series import hourly_activity, metric_counts, with_event_hour
from panelspark.sources import archive

OnBatch = Callable[[DataFrame, int], None]


def stream_archive(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of projected archive events; each file is read once, when it appears."""
    lines = archive.read_lines(spark, path, stream=True, files_per_batch=files_per_batch)
    return archive.project_events(archive.parse_lines(lines))


def windowed_counts(
    events: DataFrame, watermark: str = "2 hours", time: str = "ts", event_id: str | None = None
) -> DataFrame:
    """Live hourly counts per entity; with ``event_id``, an event that is sent again counts once.

    The watermark bounds all state: ids are remembered and hours stay open for that long after the latest event.
    Events that come later are not counted here; :func:`stream_hourly` keeps the complete counts.
    """
    kept = events.where(F.col("event_type").isin(*KEEP_EVENT_TYPES) & F.col("repo_id").isNotNull())
    timed = kept.withWatermark(time, watermark)
    once = timed.dropDuplicatesWithinWatermark([event_id]) if event_id else timed
    counts = once.groupBy("repo_id", F.window(time, "1 hour")).agg(*metric_counts(), F.count("*").alias("n_events"))
    return counts.select("repo_id", F.col("window.start").alias("event_hour"), *METRICS, "n_events")


def stream_live(
    events: DataFrame, out: str, checkpoint: str, watermark: str = "2 hours", time: str = "ts", event_id: str = "event_id"
) -> StreamingQuery:
    """Append the counts of closed hours to a table, each once, for all events that are available now."""
    return (
        windowed_counts(events, watermark, time, event_id).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )


def stream_hourly(
    events: DataFrame,
    out: str,
    checkpoint: str,
    entities: DataFrame | None = None,
    on_batch: OnBatch | None = None,
    archive_input: bool = False,
    keep: Iterable[str] = KEEP_EVENT_TYPES,
) -> StreamingQuery:
    """Count all events that are available now, batch by batch, and stop.

    ``checkpoint`` remembers which files were read, so the next run continues.
    With ``archive_input`` the stream is :func:`stream_archive`, and an hour file
    with an unreadable line is left out as a whole. ``on_batch`` gets the hours a
    batch touched.
    """
    keep = tuple(keep)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if archive_input:
            good, bad, read = archive.stage_hours(batch, keep)  # a batch is computed anew at each use, so it is used once
            hours = read.join(bad, "hour", "left_anti")
            hours.write.mode("overwrite").parquet(f"{out}/hours/batch={number}")
            rows = archive.with_hour_parts(good)
        counts = hourly_activity(with_event_hour(rows), entities)
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        if on_batch is not None:
            done = batch.sparkSession.read.parquet(f"{out}/counts/batch={number}")
            on_batch(done.select(F.col("event_hour").alias("hour")).distinct(), number)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_streamed(spark: SparkSession, out: str, archive_input: bool = False) -> DataFrame:
    """Hourly activity of all batches: added up, or of the last file of each hour with ``archive_input``."""
    batches = spark.read.option("basePath", f"{out}/counts").parquet(f"{out}/counts/batch=*")
    if archive_input:
        hours = spark.read.option("basePath", f"{out}/hours").parquet(f"{out}/hours/batch=*")
        last = hours.groupBy(F.col("hour").alias("event_hour")).agg(F.max("batch").alias("batch"))
        batches = batches.join(last, ["event_hour", "batch"], "left_semi")
    sums = [F.sum(c).alias(c) for c in (*METRICS, "n_events")]
    return batches.groupBy("repo_id", "event_hour").agg(*sums)
