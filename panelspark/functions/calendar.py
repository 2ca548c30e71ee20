"""Calendar functions.

A period is addressed by an integer index per frequency, so windows and
horizons are integer arithmetic. ``label`` is the ``ds`` of a period: its start,
except for weeks, which run Monday to Sunday and are labelled by their Sunday.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.constants import ARCHIVE_START

UTC = dt.timezone.utc
HOUR_FORMAT = "yyyy-MM-dd-HH"


@dataclass(frozen=True)
class Frequency:
    """Horizon ``h``, default history ``window`` and ``season``, all in periods."""

    name: str
    h: int
    code: str
    window: int
    season: int


# Horizon, frequency code and history window by frequency.
FREQUENCIES = {
    "hourly": Frequency("hourly", 24, "h", 1024, 24),
    "daily": Frequency("daily", 7, "D", 512, 7),
    "weekly": Frequency("weekly", 1, "W-SUN", 114, 1),
    "monthly": Frequency("monthly", 1, "MS", 24, 12),
}


def frequency(name: str | Frequency) -> Frequency:
    """Look up a frequency by its exact name."""
    if isinstance(name, Frequency):
        return name
    if name not in FREQUENCIES:
        raise ValueError(f"Invalid frequency '{name}'. Valid: {sorted(FREQUENCIES)}")
    return FREQUENCIES[name]


def frequency_of_code(code: str) -> Frequency:
    """Map a frequency code such as ``D`` or ``W-SUN`` to its frequency."""
    by_letter = {f.code[0].upper(): f for f in FREQUENCIES.values()}
    found = by_letter.get(code[:1].upper())
    if found is None:
        raise ValueError(f"Unknown frequency: {code}")
    return found


# --- periods -----------------------------------------------------------------


def period_index(ts: Column, freq: str | Frequency) -> Column:
    """Index of the period that contains ``ts``."""
    name = frequency(freq).name
    days = F.unix_date(ts.cast("date"))
    if name == "hourly":
        idx = F.floor(F.unix_seconds(ts) / 3600)
    elif name == "daily":
        idx = days
    elif name == "weekly":
        idx = F.floor((days + 3) / 7)  # day -3 is a Monday
    else:
        idx = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    return idx.cast("long")


def period_start(idx: Column, freq: str | Frequency) -> Column:
    """First instant of a period."""
    name = frequency(freq).name
    if name == "hourly":
        return F.timestamp_seconds(idx * 3600)
    if name == "daily":
        return F.date_from_unix_date(idx.cast("int")).cast("timestamp")
    if name == "weekly":
        return F.date_from_unix_date((idx * 7 - 3).cast("int")).cast("timestamp")
    first = F.make_date(
        (F.floor(idx / 12) + 1970).cast("int"), (F.pmod(idx, F.lit(12)) + 1).cast("int"), F.lit(1)
    )
    return first.cast("timestamp")


def period_label(idx: Column, freq: str | Frequency) -> Column:
    """The ``ds`` of a period."""
    if frequency(freq).name == "weekly":
        return F.date_from_unix_date((idx * 7 + 3).cast("int")).cast("timestamp")
    return period_start(idx, freq)


def period_last_hour(idx: Column, freq: str | Frequency) -> Column:
    """Last full hour of a period."""
    return period_start(idx + 1, freq) - F.expr("INTERVAL 1 HOUR")


def expected_hours(idx: Column, freq: str | Frequency) -> Column:
    """Number of hours in a period."""
    seconds = F.unix_seconds(period_start(idx + 1, freq)) - F.unix_seconds(period_start(idx, freq))
    return (seconds / 3600).cast("long")


def period_hours(idx: Column, freq: str | Frequency) -> Column:
    """Array of all hours in a period."""
    return F.sequence(
        period_start(idx, freq), period_last_hour(idx, freq), F.expr("INTERVAL 1 HOUR")
    )


def previous_period(ts: Column, freq: str | Frequency) -> Column:
    """Struct ``start, last_hour, ds`` of the period before the one holding ``ts``."""
    idx = period_index(ts, freq) - 1
    return F.struct(
        period_start(idx, freq).alias("start"),
        period_last_hour(idx, freq).alias("last_hour"),
        period_label(idx, freq).alias("ds"),
    )


def on_grid(ts: Column, freq: str | Frequency) -> Column:
    """True if ``ts`` is exactly the label of a period."""
    return period_label(period_index(ts, freq), freq) == ts


def partition_values(ts: Column, freq: str | Frequency) -> dict[str, Column]:
    """Date-part columns that place a period in a partitioned layout (ISO weeks)."""
    name = frequency(freq).name
    if name == "weekly":
        return {
            "year": F.extract(F.lit("YEAROFWEEK"), ts).cast("int"),
            "week": F.weekofyear(ts),
        }
    parts = {"year": F.year(ts), "month": F.month(ts)}
    if name in ("hourly", "daily"):
        parts["day"] = F.dayofmonth(ts)
    if name == "hourly":
        parts["hour"] = F.hour(ts)
    return parts


def partition_path(ts: Column, freq: str | Frequency) -> Column:
    """Relative folder of a period, such as ``year=2026/month=01/day=02``."""
    parts = partition_values(ts, freq)
    pattern = "/".join(f"{name}={'%04d' if name == 'year' else '%02d'}" for name in parts)
    return F.format_string(pattern, *parts.values())


# --- keys and cutoffs ----------------------------------------------------------

# Accepted cutoff formats, as Spark patterns and strptime patterns.
_CUTOFF_PATTERNS = ("yyyy-MM-dd-HH", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
_CUTOFF_STRPTIME = ("%Y-%m-%d-%H", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")


def parse_cutoff(text: Column) -> Column:
    """Timestamp of a cutoff string, null if no accepted format fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in _CUTOFF_PATTERNS])


def cutoff_value(cutoff: str | dt.datetime) -> dt.datetime:
    """UTC datetime of one cutoff argument."""
    if isinstance(cutoff, dt.datetime):
        return cutoff.replace(tzinfo=UTC) if cutoff.tzinfo is None else cutoff.astimezone(UTC)
    for pattern in _CUTOFF_STRPTIME:
        try:
            return dt.datetime.strptime(cutoff, pattern).replace(tzinfo=UTC)
        except ValueError:
            pass
    raise ValueError(f"Could not parse cutoff '{cutoff}'. Expected one of {_CUTOFF_PATTERNS}")


def hour_key(ts: Column) -> Column:
    """Hour or cutoff key, ``YYYY-MM-DD-HH``."""
    return F.date_format(ts, HOUR_FORMAT)


def archive_stamp(ts: Column) -> Column:
    """Stamp used in archive file names; the hour is not padded."""
    return F.date_format(ts, "yyyy-MM-dd-H")


def stamp_hour(stamp: Column) -> Column:
    """Hour of an archive stamp."""
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd-H"))


# --- grids -----------------------------------------------------------------------


def time_grid(
    spark: SparkSession,
    start: dt.datetime,
    end: dt.datetime,
    step: str,
    column: str,
    drop_last: bool = False,
) -> DataFrame:
    """One row per step from ``start`` to ``end`` inclusive; empty if end < start."""
    points = F.sequence(F.lit(start), F.lit(end), F.expr(f"INTERVAL {step}"))
    if drop_last:
        points = F.slice(points, F.lit(1), F.size(points) - 1)
    grid = spark.range(1, numPartitions=1)
    if end < start:
        return grid.where("false").select(F.lit(start).alias(column))
    return grid.select(F.explode(points).alias(column))


def hours_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All hours of a range, ends included."""
    return time_grid(spark, cutoff_value(start), cutoff_value(end), "1 HOUR", "hour")


def previous_hours(spark: SparkSession, n: int, as_of: dt.datetime) -> DataFrame:
    """The ``n`` hours before the one that contains ``as_of``."""
    this_hour = cutoff_value(as_of).replace(minute=0, second=0, microsecond=0)
    return time_grid(
        spark, this_hour - dt.timedelta(hours=n), this_hour - dt.timedelta(hours=1), "1 HOUR", "hour"
    )


def last_day_boundary(as_of: dt.datetime, start: str = ARCHIVE_START) -> dt.datetime:
    """Last multiple of 24 hours after ``start`` that is not later than ``as_of``."""
    first = cutoff_value(start)
    return first + dt.timedelta(days=(cutoff_value(as_of) - first).days)


def _roll_forward(start: dt.datetime, freq: Frequency) -> dt.datetime:
    if freq.name == "weekly":
        return start + dt.timedelta(days=(6 - start.weekday()) % 7)
    if freq.name == "monthly" and start.day > 1:
        return (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return start


# Calendar unit of one period.
_UNITS = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}


def cutoff_range(
    spark: SparkSession,
    freq: str | Frequency,
    start: str | dt.datetime,
    as_of: dt.datetime,
    drop_last: bool | None = None,
) -> DataFrame:
    """Cutoffs from ``start`` to ``as_of``, one horizon apart.

    Weekly and monthly ranges leave out the last cutoff, whose period may still
    be open; ``drop_last`` overrides that.
    """
    f = frequency(freq)
    if drop_last is None:
        drop_last = f.name in ("weekly", "monthly")
    first = _roll_forward(cutoff_value(start), f)
    return time_grid(spark, first, cutoff_value(as_of), f"{f.h} {_UNITS[f.name]}", "cutoff", drop_last)


def aggregation_grid(
    spark: SparkSession, freq: str | Frequency, start: str | dt.datetime, as_of: dt.datetime
) -> DataFrame:
    """Aggregation keys from ``start`` to the last day boundary.

    Key ``k`` stands for the period before the one that contains ``k``.
    """
    f = frequency(freq)
    first = _roll_forward(cutoff_value(start), f)
    return time_grid(spark, first, last_day_boundary(as_of), f"1 {_UNITS[f.name]}", "key")


def label_grid(
    spark: SparkSession, freq: str | Frequency, start: str | dt.datetime, end: str | dt.datetime
) -> DataFrame:
    """Labels of all periods from ``start`` to ``end``."""
    f = frequency(freq)
    first = _roll_forward(cutoff_value(start), f)
    return time_grid(spark, first, cutoff_value(end), f"1 {_UNITS[f.name]}", "ds")
