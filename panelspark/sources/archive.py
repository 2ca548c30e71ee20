"""Archive files: one gzip of JSON lines per hour.

Gzip is not splittable, so each hour file is one task and hours run in parallel.
A line is parsed once into a VARIANT, which keeps the JSON type of every field;
a typed JSON schema would turn the number 5 into the string "5" or drop a row
over one odd field.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.constants import KEEP_EVENT_TYPES
from panelspark.functions import calendar as cal
from panelspark.session import settle

# Columns of a flattened raw event.
RAW_SCHEMA = (
    "event_id STRING, created_at STRING, event_type STRING, repo_id BIGINT, repo_name STRING, "
    "actor_id BIGINT, actor_login STRING, action STRING, push_distinct_size INT"
)
RAW_COLUMNS = tuple(part.split()[0] for part in RAW_SCHEMA.split(", "))
HOUR_PARTS = ("year", "month", "day", "hour")

_STAMP = r"(\d{4}-\d{2}-\d{2}-\d{1,2})"


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    stream: bool = False,
    hours: Iterable[str] | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Text lines of archive files with the hour taken from the file or folder name.

    The hour filter is on file metadata, so other files are not opened.
    ``files_per_batch`` bounds a micro-batch when a stream starts on a long archive.
    """
    reader = spark.readStream if stream else spark.read
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = reader.format("text").option("recursiveFileLookup", "true").load(path)
    stamp = F.regexp_extract(F.col("_metadata.file_path"), _STAMP, 1)
    if hours is not None:
        stamps = [f"{v:%Y-%m-%d}-{v.hour}" for v in map(cal.cutoff_value, hours)]
        text = text.where(stamp.isin(stamps))
    return text.select(cal.stamp_hour(stamp).alias("archive_hour"), F.col("value").alias("line"))


def file_hours(spark: SparkSession, path: str | list[str], hours: Iterable[str] | None = None) -> DataFrame:
    """Hours that have an archive file, from the file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stamp = F.regexp_extract("path", _STAMP, 1)
    if hours is not None:
        files = files.where(stamp.isin([f"{v:%Y-%m-%d}-{v.hour}" for v in map(cal.cutoff_value, hours)]))
    return files.select(cal.stamp_hour(stamp).alias("hour")).where("hour IS NOT NULL").distinct()


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse ``line`` into ``event``; null marks a line that is not a JSON object.

    Blank lines are skipped. The explode keeps later filters above the parse, so
    a line is parsed once and not once per filter and projection.
    """
    text = F.btrim(F.col("line"), F.lit(" \t\r\n"))
    parsed = F.when(text.startswith("{"), F.try_parse_json(text))
    others = [c for c in lines.columns if c != "line"]
    return lines.where(F.length(text) > 0).select(
        *others, F.explode(F.array(parsed)).alias("event")
    )


def _kind(event: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(event, path, "variant"))


def _text(event: Column, path: str) -> Column:
    return F.when(_kind(event, path) == "STRING", F.try_variant_get(event, path, "string"))


def _whole_number(event: Column, path: str) -> Column:
    kind = _kind(event, path)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
    exact = F.try_variant_get(event, path, "bigint")
    return F.when(number, F.coalesce(exact, F.try_variant_get(event, path, "double").try_cast("bigint")))


def project_events(parsed: DataFrame) -> DataFrame:
    """Typed projection of parsed events, with ``bad`` for unreadable lines.

    Ids and sizes accept any JSON number (truncated) or boolean, never a string.
    """
    e = F.col("event")
    others = [c for c in parsed.columns if c != "event"]
    size = _whole_number(e, "$.payload.distinct_size")
    return parsed.select(
        *others,
        F.try_variant_get(e, "$.id", "string").alias("event_id"),
        _text(e, "$.created_at").alias("created_at"),
        _text(e, "$.type").alias("event_type"),
        _whole_number(e, "$.repo.id").alias("repo_id"),
        _text(e, "$.repo.name").alias("repo_name"),
        _whole_number(e, "$.actor.id").alias("actor_id"),
        _text(e, "$.actor.login").alias("actor_login"),
        _text(e, "$.payload.action").alias("action"),
        size.try_cast("int").alias("push_distinct_size"),
        e.isNull().alias("bad"),
    )


def kept_events(keep: Iterable[str] = KEEP_EVENT_TYPES) -> Column:
    """Events of a kept type whose repo name is a string."""
    return F.col("event_type").isin(*keep) & F.col("repo_name").isNotNull()


def flatten_events(parsed: DataFrame, keep: Iterable[str] = KEEP_EVENT_TYPES) -> DataFrame:
    """Flat events of the kept types; unreadable lines are left out."""
    return project_events(parsed).where(kept_events(keep)).drop("bad")


def read_archive(
    spark: SparkSession,
    path: str | list[str],
    keep: Iterable[str] = KEEP_EVENT_TYPES,
    strict: bool = True,
    hours: Iterable[str] | None = None,
) -> DataFrame:
    """Flattened raw events of archive files, with their hour parts.

    ``strict`` leaves out every hour that has an unreadable line; otherwise only
    that line is left out. Strict mode stages the flat events, so the text is
    parsed once. ``hours`` (hour keys) limits the scan to the files of those hours.
    """
    parsed = parse_lines(read_lines(spark, path, hours=hours))
    if not strict:
        return with_hour_parts(flatten_events(parsed, keep))
    return with_hour_parts(drop_bad_hours(project_events(parsed), keep))


def drop_bad_hours(projected: DataFrame, keep: Iterable[str] = KEEP_EVENT_TYPES) -> DataFrame:
    """Kept events of the hours without an unreadable line."""
    return split_bad_hours(projected, keep)[0]


def split_bad_hours(
    projected: DataFrame, keep: Iterable[str] = KEEP_EVENT_TYPES
) -> tuple[DataFrame, DataFrame]:
    """Kept events of the good hours, and the hours with an unreadable line as ``hour, n_bad``."""
    return stage_hours(projected, keep)[:2]


def stage_hours(
    projected: DataFrame, keep: Iterable[str] = KEEP_EVENT_TYPES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept events of the good hours, the bad hours as ``hour, n_bad``, and all hours with a line as ``hour``.

    The lines are read and parsed once. Events that are not kept are staged without their fields, which takes next to no
    space and still tells their hour, also of files without any kept event.
    """
    event = F.when(~F.col("bad") & kept_events(keep), F.struct(*RAW_COLUMNS)).alias("event")
    staged = settle(projected.select("archive_hour", "bad", event), "flat-events")
    bad = staged.where("bad").groupBy("archive_hour").agg(F.count("*").alias("n_bad"))
    good = staged.where("event IS NOT NULL").join(bad, "archive_hour", "left_anti").select("archive_hour", "event.*")
    hours = staged.select(F.col("archive_hour").alias("hour")).distinct()
    return good, bad.withColumnRenamed("archive_hour", "hour"), hours


def with_hour_parts(events: DataFrame) -> DataFrame:
    """Replace ``archive_hour`` by the partition columns year, month, day and hour."""
    parts = cal.partition_values(F.col("archive_hour"), "hourly")
    return events.select(*RAW_COLUMNS, *[col.alias(name) for name, col in parts.items()])


def hour_of_parts() -> Column:
    """Hour timestamp of the partition columns."""
    return F.make_timestamp(*[F.col(p) for p in HOUR_PARTS], F.lit(0), F.lit(0).cast("decimal(16,6)"))
