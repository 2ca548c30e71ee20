"""Count series: hourly activity, dense hourly series and period series.

Counts stay sparse (only hours with events) until the requested frequency, and
zeros are filled in there. The raw table is read once, and the map side of its
aggregation reduces even a very active entity to one row per hour and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.constants import COMPLETENESS, DEFAULT_COMPLETENESS, KEEP_EVENT_TYPES, METRICS
from panelspark.functions import calendar as cal
from panelspark.sources.archive import hour_of_parts


def with_event_hour(raw: DataFrame) -> DataFrame:
    """Add ``event_hour`` from the partition columns unless it is there."""
    return raw if "event_hour" in raw.columns else raw.withColumn("event_hour", hour_of_parts())


def metric_counts() -> list[Column]:
    """Conditional counts of the four metrics. Pushes count events, not commits."""
    kind, opened = F.col("event_type"), F.col("action") == "opened"
    return [
        F.count_if(kind == "WatchEvent").alias("stars"),
        F.count_if((kind == "PullRequestEvent") & opened).alias("prs_opened"),
        F.count_if((kind == "IssuesEvent") & opened).alias("issues_opened"),
        F.count_if(kind == "PushEvent").alias("pushes"),
    ]


def _aggregate_known(events: DataFrame, entities: DataFrame | None, keys: list[str], columns: list[Column]) -> DataFrame:
    """Group events by ``keys``, which include ``repo_id``, for the given entities only.

    The entities cut the events before they are grouped: a small stored table is broadcast by Catalyst, and
    a large one joined, where adaptive execution splits an entity with a large share of the events.
    """
    if entities is not None:
        events = events.join(entities.select("repo_id"), "repo_id", "left_semi")
    return events.groupBy(*keys).agg(*columns)


def hourly_activity(raw: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row per entity and hour with any kept event: the four counts and ``n_events``."""
    events = with_event_hour(raw).where(
        F.col("event_type").isin(*KEEP_EVENT_TYPES) & F.col("repo_id").isNotNull()
    )
    columns = [*metric_counts(), F.count("*").alias("n_events")]
    return _aggregate_known(events, entities, ["repo_id", "event_hour"], columns)


def first_activity(activity: DataFrame) -> DataFrame:
    """First hour of each entity, from hourly activity."""
    return activity.groupBy("repo_id").agg(F.min("event_hour").alias("first_hour"))


def first_events(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """First hour in which each entity occurs in the raw events."""
    events = with_event_hour(raw).select("repo_id", "event_hour")
    return _aggregate_known(events, entities, ["repo_id"], [F.min("event_hour").alias("first_hour")])


def unique_id() -> Column:
    """Series id ``repo_id:metric``."""
    return F.concat_ws(":", F.col("repo_id").cast("string"), F.col("metric"))


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per metric, in one pass over the counts; rows stay in their partition, which an unpivot does not promise."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("y")) for m in METRICS])
    return wide.select(*keys, F.inline(cells))


def hourly_counts(raw: DataFrame) -> DataFrame:
    """Sparse hourly counts ``repo_id, metric, unique_id, ds, y``, zeros left out."""
    counts = to_long(hourly_activity(raw), ["repo_id", "event_hour"]).where("y > 0")
    return counts.select("repo_id", "metric", unique_id().alias("unique_id"), F.col("event_hour").alias("ds"), "y")


def _bounds(df: DataFrame, column: str) -> tuple[Column, Column]:
    """Minimum and maximum of a column as scalar subqueries."""
    return df.select(F.min(column)).scalar(), df.select(F.max(column)).scalar()


def unique_entities(entities: DataFrame) -> DataFrame:
    """``repo_id, repo_name``; an entity that is listed twice is an error, as its counts would be added twice.

    The check is in the join key, so it is not pruned with unused columns.
    """
    known = entities.groupBy("repo_id").agg(F.max("repo_name").alias("repo_name"), F.count("*").alias("_n"))
    text = F.concat(F.lit("repeated entity: "), F.coalesce(F.col("repo_id").cast("string"), F.lit("null")))
    checked = F.when(F.col("_n") == 1, F.col("repo_id")).otherwise(F.raise_error(text).cast("long"))
    return known.select(checked.alias("repo_id"), "repo_name")


def name_history(raw: DataFrame) -> DataFrame:
    """Names of entities over time, ``repo_id, repo_name, since, until``; ``until`` is null for the last one.

    The name of an hour is that of its last event, so an entity adds one row an hour at most before its hours are put in order.
    """
    events = with_event_hour(raw).where(F.col("repo_id").isNotNull() & F.col("repo_name").isNotNull())
    hourly = events.groupBy("repo_id", "event_hour").agg(
        F.max_by("repo_name", F.struct("created_at", "repo_name")).alias("repo_name")
    )
    order = Window.partitionBy("repo_id").orderBy("event_hour")
    before = F.lag("repo_name").over(order)
    changes = hourly.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("repo_name")))
    return changes.select(
        "repo_id", "repo_name", F.col("event_hour").alias("since"), F.lead("event_hour").over(order).alias("until")
    )


def with_names(panel: DataFrame, names: DataFrame, freq: str | cal.Frequency) -> DataFrame:
    """``panel`` with the name each entity had in the last hour of the period (an as-of join).

    A period before the first known name keeps the panel's own. Names take part in no grouping, so a rename does not split a period.
    """
    f = cal.frequency(freq)
    at = cal.period_last_hour(cal.period_index(F.col("ds"), f), f)
    valid = names.select(F.col("repo_id").alias("_id"), F.col("repo_name").alias("_name"), "since", "until")
    inside = (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    joined = panel.withColumn("_at", at).join(valid, (F.col("repo_id") == F.col("_id")) & inside, "left")
    name = F.coalesce("_name", "repo_name").alias("repo_name")
    return joined.select(*[name if c == "repo_name" else F.col(c) for c in panel.columns])


def hourly_series(
    activity: DataFrame, entities: DataFrame, first: DataFrame, hours: DataFrame
) -> DataFrame:
    """Dense hourly series: every entity, metric and given hour from the entity's first hour.

    Each entity unrolls its own hour sequence, so the zero fill never pairs entities with hours they do not reach.
    Sparse counts are packed by entity and joined before that: only they are shuffled, and the dense rows stay where
    their entity is. A few packed bytes become many rows, so the number of tasks is set here and not merged by size.
    """
    low, high = _bounds(hours, "hour")
    start = F.greatest(F.col("first_hour"), low)
    tasks = int(activity.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = (
        unique_entities(entities)
        .join(first, "repo_id")
        .withColumn("last_hour", high)
        .where(start <= F.col("last_hour"))
        .select("repo_id", "repo_name", start.alias("start"), "last_hour")
    )
    zero = F.lit(0).cast("long")
    counts = F.struct(F.col("event_hour").alias("ds"), *[F.coalesce(m, zero).alias(m) for m in METRICS])
    sparse = activity.where("repo_id IS NOT NULL AND event_hour IS NOT NULL").repartition(tasks, "repo_id")
    packed = sparse.groupBy("repo_id").agg(F.collect_list(counts).alias("_counts"))
    joined = known.join(packed, "repo_id", "left")

    step = F.expr("INTERVAL 1 HOUR")
    on_step = lambda c: (F.unix_micros(c.ds) - F.unix_micros("start")) % 3_600_000_000 == 0
    found = F.filter("_counts", lambda c: c.ds.between(F.col("start"), F.col("last_hour")) & on_step(c))
    empty = F.array_except(F.sequence("start", "last_hour", step), F.coalesce("_counts.ds", F.array().cast("array<timestamp>")))
    zeros = F.transform(empty, lambda h: F.struct(h.alias("ds"), *[zero.alias(m) for m in METRICS]))
    dense = joined.select("repo_id", "repo_name", F.inline(F.concat(F.coalesce(found, F.array().cast(_COUNTS)), zeros)))
    dense = dense.join(F.broadcast(hours.select(F.col("hour").alias("ds"))), "ds", "left_semi")
    return _series_columns(to_long(dense, ["repo_id", "repo_name", "ds"]))


# Packed hours of an entity.
_COUNTS = f"array<struct<ds: timestamp, {', '.join(f'{m}: bigint' for m in METRICS)}>>"


def _series_columns(long: DataFrame) -> DataFrame:
    return long.select(
        "repo_id", "repo_name", "metric", unique_id().alias("unique_id"), "ds", F.col("y").cast("long").alias("y")
    )


def completeness(
    hours: DataFrame, freq: str | cal.Frequency, thresholds: dict[str, float] | None = None
) -> DataFrame:
    """Per period: hours found and expected, their ratio, and whether it may be aggregated.

    Only the presence of hours counts, not their rows. ``last_found`` is the last
    hour found.
    """
    f = cal.frequency(freq)
    threshold = (COMPLETENESS if thresholds is None else thresholds).get(f.name, DEFAULT_COMPLETENESS)
    found = (
        hours.select("hour")
        .distinct()
        .groupBy(cal.period_index(F.col("hour"), f).alias("idx"))
        .agg(F.count("*").alias("found_hours"), F.max("hour").alias("last_found"))
    )
    ratio = F.col("found_hours") / F.col("expected_hours")
    return (
        found.withColumn("expected_hours", cal.expected_hours(F.col("idx"), f))
        .withColumn("completeness_ratio", ratio)
        .select(
            F.lit(f.name).alias("frequency"),
            "idx",
            cal.period_start(F.col("idx"), f).alias("period_start"),
            cal.period_last_hour(F.col("idx"), f).alias("period_end"),
            cal.period_label(F.col("idx"), f).alias("ds"),
            "found_hours",
            "expected_hours",
            "completeness_ratio",
            (F.col("completeness_ratio") >= threshold).alias("is_complete"),
            "last_found",
        )
    )


def completeness_message(status: DataFrame) -> DataFrame:
    """Refused periods with the reason as text."""
    text = F.format_string(
        "Data completeness (%.2f%%) too low: found %d/%d hours",
        F.col("completeness_ratio") * 100,
        "found_hours",
        "expected_hours",
    )
    return status.where(~F.col("is_complete")).select("frequency", "ds", text.alias("error"))


def period_series(
    activity: DataFrame,
    entities: DataFrame,
    first: DataFrame,
    hours: DataFrame,
    freq: str | cal.Frequency,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Zero-filled series of all complete periods at once.

    Equals summing the dense hourly series per period: an entity is in a period
    if one of the period's hours is at or after its first hour.
    """
    f = cal.frequency(freq)
    periods = completeness(hours, f, thresholds).where("is_complete").select("idx", "ds", "last_found")
    low, high = _bounds(periods, "idx")
    known = unique_entities(entities).join(first, "repo_id")

    start = F.greatest(cal.period_index(F.col("first_hour"), f), low)
    spine = (
        known.withColumn("last_idx", high)
        .where(start <= F.col("last_idx"))
        .withColumn("idx", F.explode(F.sequence(start, F.col("last_idx"))))
        .join(periods, "idx")
        .where("first_hour <= last_found")
        .select("repo_id", "repo_name", "idx", "ds")
    )
    sums = (
        activity.join(hours.select(F.col("hour").alias("event_hour")).distinct(), "event_hour", "left_semi")
        .join(first, "repo_id")
        .where("event_hour >= first_hour")
        .groupBy("repo_id", cal.period_index(F.col("event_hour"), f).alias("idx"))
        .agg(*[F.sum(m).alias(m) for m in METRICS])
    )
    filled = spine.join(sums, ["repo_id", "idx"], "left").select(
        "repo_id",
        "repo_name",
        "ds",
        *[F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in METRICS],
    )
    return _series_columns(to_long(filled, ["repo_id", "repo_name", "ds"]))


def rollup_series(hourly: DataFrame, hours: DataFrame, freq: str | cal.Frequency) -> DataFrame:
    """Period sums of a dense hourly series, for complete periods only."""
    f = cal.frequency(freq)
    periods = completeness(hours, f).where("is_complete").select("idx", F.col("ds").alias("period_ds"))
    return (
        hourly.withColumn("idx", cal.period_index(F.col("ds"), f))
        .groupBy("repo_id", "repo_name", "metric", "unique_id", "idx")
        .agg(F.sum("y").cast("long").alias("y"))
        .join(periods, "idx")
        .select("repo_id", "repo_name", "metric", "unique_id", F.col("period_ds").alias("ds"), "y")
    )
