"""History windows, actuals and rolling statistics for many cutoffs at once.

A panel has the columns ``unique_id, ds, y`` and one row per series and period. Cutoffs are

* a list of values, or a frame with a ``cutoff`` column: they hold for all series. They are points of the frequency's grid,
  so a frame of them has a row for each period at most and is read as a list. Lists bound the scan of the panel,
  and each row picks its own cutoffs without a join;
* a frame ``unique_id, cutoff`` of any size: each series has its own. Histories, actuals and statistics join it by series.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal

Cutoffs = DataFrame | Iterable[str | dt.datetime]

def listed_cutoffs(cutoffs: Iterable[str | dt.datetime], freq: str | cal.Frequency) -> list[dt.datetime]:
    """Listed cutoffs in order; all must be on the frequency's grid."""
    f = cal.frequency(freq)
    values = sorted({cal.cutoff_value(c) for c in cutoffs})
    if not values:
        raise ValueError("no cutoffs given")
    off = [v for v in values if not _value_on_grid(v, f)]
    if off:
        raise ValueError(f"cutoffs not on the {f.name} grid: {off}")
    return values


def own_cutoffs(cutoffs: Cutoffs) -> bool:
    """True for a frame that has cutoffs for each series."""
    return isinstance(cutoffs, DataFrame) and "unique_id" in cutoffs.columns


def _shared(cutoffs: Cutoffs) -> Cutoffs:
    """Cutoffs of all series as a list; those of each series stay a frame."""
    if own_cutoffs(cutoffs):
        return cutoffs
    if isinstance(cutoffs, DataFrame):
        keys = cutoffs.select(F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss").alias("key")).distinct()
        return [cal.cutoff_value(r.key) for r in keys.toLocalIterator()]
    return list(cutoffs)


def _checked(cutoff: Column, freq: cal.Frequency) -> Column:
    text = F.concat(F.lit(f"cutoffs not on the {freq.name} grid: "), cutoff.cast("string"))
    return F.when(cal.on_grid(cutoff, freq), cutoff).otherwise(F.raise_error(text).cast("timestamp"))


def cutoff_frame(spark: SparkSession, cutoffs: Cutoffs, freq: str | cal.Frequency) -> DataFrame:
    """Cutoffs as ``cutoff, cutoff_idx``. One that is not on the frequency's grid is an error, listed or in a frame."""
    f = cal.frequency(freq)
    if isinstance(cutoffs, DataFrame):
        frame = cutoffs.select("cutoff").distinct().select(_checked(F.col("cutoff"), f).alias("cutoff"))
    else:
        points = F.array(*[F.lit(v) for v in listed_cutoffs(cutoffs, f)])
        frame = spark.range(1, numPartitions=1).select(F.explode(points).alias("cutoff"))
    return frame.withColumn("cutoff_idx", cal.period_index(F.col("cutoff"), f))


def _value_on_grid(value: dt.datetime, freq: cal.Frequency) -> bool:
    if value.minute or value.second or value.microsecond:
        return False
    if freq.name == "hourly":
        return True
    if value.hour:
        return False
    return {"daily": True, "weekly": value.weekday() == 6, "monthly": value.day == 1}[freq.name]


# Days that certainly cover one period.
_DAYS = {"hourly": 1 / 24, "daily": 1, "weekly": 7, "monthly": 31}


def _bounded(panel: DataFrame, cutoffs: Cutoffs, freq: cal.Frequency, back: int, ahead: int) -> DataFrame:
    """Limit the panel scan to what the listed cutoffs can reach."""
    if isinstance(cutoffs, DataFrame):
        return panel
    values = [cal.cutoff_value(c) for c in cutoffs]
    low = min(values) - dt.timedelta(days=_DAYS[freq.name] * back)
    high = max(values) + dt.timedelta(days=_DAYS[freq.name] * ahead)
    return panel.where(F.col("ds").between(F.lit(low), F.lit(high)))


def checked_own(cutoffs: DataFrame, freq: cal.Frequency) -> DataFrame:
    """Cutoffs of each series as ``unique_id, cutoff, idx``."""
    own = cutoffs.select("unique_id", _checked(F.col("cutoff"), freq).alias("cutoff")).distinct()
    return own.withColumn("idx", cal.period_index(F.col("cutoff"), freq))


def reachable(panel: DataFrame, cutoffs: Cutoffs, freq: str | cal.Frequency, window: int) -> DataFrame:
    """Panel rows that may lie in the window of a cutoff; prunes the scan for listed ones."""
    f = cal.frequency(freq)
    rows = _bounded(panel, _shared(cutoffs), f, window, 0)
    return rows.join(cutoffs.select("unique_id").distinct(), "unique_id", "left_semi") if own_cutoffs(cutoffs) else rows


def _within(low: Column, high: Column, width: int, listed: list[dt.datetime], freq: cal.Frequency) -> Column:
    """Array of the period indices of listed cutoffs between two indices at most ``width`` apart."""
    points = F.array(*[cal.period_index(F.lit(v), freq) for v in listed])
    if len(listed) <= width:
        return F.filter(points, lambda i: i.between(low, high))
    return F.filter(F.when(low <= high, F.sequence(low, high)), lambda i: F.array_contains(points, i))


def _window_join(
    panel: DataFrame, cutoffs: Cutoffs, freq: cal.Frequency, first: int, last: int
) -> DataFrame:
    """Panel rows whose period is ``first`` to ``last`` periods from a cutoff.

    With cutoffs of each series, both sides are cut into blocks as long as the window: a window meets two blocks of its series
    at most, so the join is an equality of series and block, and the range is checked within.
    """
    cutoffs = _shared(cutoffs)
    rows = _bounded(panel, cutoffs, freq, -first, last)
    rows = rows.withColumn("idx", cal.period_index(F.col("ds"), freq))
    if not isinstance(cutoffs, DataFrame):
        # A cutoff at i holds the rows from i + first to i + last.
        met = _within(F.col("idx") - last, F.col("idx") - first, last - first + 1, listed_cutoffs(cutoffs, freq), freq)
        return rows.withColumn("i", F.explode(met)).withColumn("cutoff", cal.period_label(F.col("i"), freq)).drop("i")
    block = lambda i: F.floor(i / (last - first + 1))
    own = checked_own(cutoffs, freq).withColumnRenamed("idx", "i")
    own = own.withColumn("block", F.explode(F.sequence(block(F.col("i") + first), block(F.col("i") + last))))
    return (
        rows.withColumn("block", block(F.col("idx"))).join(own, ["unique_id", "block"])
        .where(F.col("idx").between(F.col("i") + first, F.col("i") + last)).drop("i", "block")
    )


def history(
    panel: DataFrame, cutoffs: Cutoffs, freq: str | cal.Frequency, window: int | None = None
) -> DataFrame:
    """``cutoff, unique_id, ds, y`` of the last ``window`` periods up to each cutoff."""
    f = cal.frequency(freq)
    rows = _window_join(panel, cutoffs, f, 1 - (window or f.window), 0)
    return rows.select("cutoff", "unique_id", "ds", "y")


def actuals(
    panel: DataFrame, cutoffs: Cutoffs, freq: str | cal.Frequency, h: int | None = None
) -> DataFrame:
    """``cutoff, unique_id, ds, y`` of the ``h`` periods after each cutoff."""
    f = cal.frequency(freq)
    rows = _window_join(panel, cutoffs, f, 1, h or f.h)
    return rows.select("cutoff", "unique_id", "ds", "y")


def _for_all(cutoffs: Cutoffs) -> Cutoffs:
    if own_cutoffs(cutoffs):
        raise ValueError("cutoffs of single series are not for checks of the whole panel")
    return _shared(cutoffs)


def window_presence(
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    window: int | None = None,
    h: int = 0,
) -> DataFrame:
    """Per cutoff: how many of its ``window`` past and ``h`` next periods the panel has."""
    f = cal.frequency(freq)
    w = window or f.window
    cutoffs = _for_all(cutoffs)
    frame = cutoff_frame(panel.sparkSession, cutoffs, f)
    rows = _bounded(panel, cutoffs, f, w, h)
    present = rows.select(cal.period_index(F.col("ds"), f).alias("idx")).distinct()
    present = present.withColumn("present", F.lit(1))
    first, last = F.col("cutoff_idx") + 1 - w, F.col("cutoff_idx") + h
    cells = frame.select("cutoff", "cutoff_idx", F.explode(F.sequence(first, last)).alias("idx"))
    found = cells.join(present, "idx", "left")
    past = F.col("idx") <= F.col("cutoff_idx")
    return found.groupBy("cutoff").agg(
        F.count_if(past & F.col("present").isNotNull()).alias("found_periods"),
        F.count_if(past).alias("expected_periods"),
        F.count_if(~past & F.col("present").isNotNull()).alias("found_actuals"),
        (F.count_if(past & F.col("present").isNull()) == 0).alias("window_ok"),
    )


def require_window(presence: DataFrame) -> None:
    """Raise if a cutoff misses a period of its history."""
    row = presence.where(~F.col("window_ok")).agg(F.count("*").alias("n"), F.min("cutoff").alias("first")).first()
    if row.n:
        raise FileNotFoundError(f"Missing history periods for {row.n} cutoffs, the first of them {row.first}")


def _exact_square(value: Column) -> Column:
    whole = value.cast("decimal(19,0)")
    return (whole * whole).cast("decimal(38,0)")


def _sum_of_squares(value: Column) -> Column:
    """Exact sum of squares of whole numbers. Those of 31 bits are added up in two longs, halves of 32 bits, the rest as decimals."""
    small = F.abs(value) < 2**31
    square = F.when(small, value * value)
    high, low = F.sum(F.shiftright(square, 32)), F.sum(square.bitwiseAND(F.lit(2**32 - 1)))
    rest = F.sum(F.when(~small, _exact_square(value)))
    none = F.lit(0).cast("decimal(19,0)")
    parts = [F.coalesce(part.cast("decimal(19,0)"), none) for part in (high, low)]
    return (parts[0] * F.lit(2**32).cast("decimal(11,0)") + parts[1] + F.coalesce(rest, none)).cast("decimal(38,0)")


def rolling_stats(
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    window: int | None = None,
    m: int = 1,
    season: int | None = None,
) -> DataFrame:
    """Statistics of each series' history window, one row per cutoff and series.

    With whole-number ``y`` every window sum is the difference of two running sums, so the cost is linear
    in the panel and does not grow with the window or the number of cutoffs, and sums are exact.
    Differences of running sums of fractions would lose digits; there the periods are cut into blocks as long as the window, which is
    then the end of one block and the beginning of the next, and only values inside the window are added: linear as well.
    Either way there is one shuffle by series. ``tail`` holds the last ``season`` values. Listed cutoffs whose windows hold
    a row few times are added up directly, one group for each of them and series.

    Differences use the previous rows of the series; windows with missing periods
    are for :func:`window_presence` to refuse.
    """
    f = cal.frequency(freq)
    w, s = window or f.window, season or f.season
    if m >= w:
        raise ValueError("window must be longer than the seasonality")
    cutoffs = _shared(cutoffs)
    whole = panel.schema["y"].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = _bounded(panel, cutoffs, f, w + s, 0).select(
        "unique_id", cal.period_index(F.col("ds"), f).alias("idx"), F.col("y").cast("long" if whole else "double").alias("y")
    )
    if not isinstance(cutoffs, DataFrame):
        listed = listed_cutoffs(cutoffs, f)
        reach = (listed[-1] - listed[0]).days / _DAYS[f.name] + w
        if len(listed) * w <= _MOST_COPIES * reach:
            return _listed_stats(rows, w, m, s, listed, f, whole, reach + s)
    stats = (_whole_stats if whole else _fraction_stats)(rows, w, m, s)
    if isinstance(cutoffs, DataFrame):
        found = stats.join(checked_own(cutoffs, f), ["unique_id", "idx"])
    else:
        met = _within(F.col("idx"), F.col("idx"), 1, listed, f)
        found = stats.where(F.size(met) > 0).withColumn("cutoff", cal.period_label(F.col("idx"), f))
    return found.select("cutoff", *[c for c in stats.columns if c != "idx"])


def _with_differences(rows: DataFrame, m: int, s: int) -> DataFrame:
    series = Window.partitionBy("unique_id").orderBy("idx")
    y = F.col("y")
    return rows.withColumn("_d", F.abs(y - F.lag("y", m).over(series))).withColumn("_sd", y - F.lag("y", s).over(series))


def _tail(s: int) -> Column:
    series = Window.partitionBy("unique_id").orderBy("idx")
    return F.array(*[F.lag("y", s - 1 - j).over(series) for j in range(s)])


# Windows that a row may be copied to, on average.
_MOST_COPIES = 4
# Periods from which on a series is long: its rows shrink so much in a shuffle that partitions merged by size would be large.
_LONG = 100


def _listed_stats(
    rows: DataFrame, w: int, m: int, s: int, listed: list[dt.datetime], freq: cal.Frequency, whole: bool, periods: float
) -> DataFrame:
    """Statistics at listed cutoffs: the rows of each window, added up by series and cutoff.

    Only the differences take a window function. A row is among the last ``s`` rows of a cutoff if the row ``s`` rows later
    lies behind it; such rows have different numbers modulo ``s``, which are their places in the tail.
    """
    if periods >= _LONG:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unique_id")
    series = Window.partitionBy("unique_id").orderBy("idx")
    numbered = _with_differences(rows, m, s)
    numbered = numbered.withColumn("_rn", F.row_number().over(series)).withColumn("_later", F.lead("idx", s).over(series))
    idx, y, at = F.col("idx"), F.col("y"), F.col("_at")
    cells = numbered.withColumn("_at", F.explode(_within(idx, idx + (w - 1), w, listed, freq)))

    zero, long = F.lit(0).cast("long"), "long"
    inside = lambda value, skipped: F.when(idx > at - (w - skipped), value)
    last = F.col("_later").isNull() | (F.col("_later") > at)
    slots = [F.max(F.when(last & (F.col("_rn") % s == j), y)).alias(f"_y{j}") for j in range(s)]
    d, sd, season = inside(F.col("_d"), m), inside(F.col("_sd"), min(s, w)), min(s, w)
    if whole:
        sums = {
            "n_obs": F.count("*"),
            "sum_y": F.coalesce(F.sum(y), zero),
            "sum_abs_y": F.coalesce(F.sum(F.abs(y)), zero),
            "sum_y2": _sum_of_squares(y),
            "n_diff": F.count(d),
            "sum_abs_diff": F.coalesce(F.sum(d), zero),
            "n_sdiff": F.count(sd),
            "sum_sdiff2": _sum_of_squares(sd),
        }
    else:
        spread, square = F.coalesce(F.stddev_samp(y), F.lit(0.0)), F.lit(None).cast("double")
        sums = {
            "n_obs": F.count(y),
            "mean_y": F.avg(y),
            "mean_abs_y": F.avg(F.abs(y)),
            "sd_y": F.when(F.count(y) > 1, spread).otherwise(F.lit(0.0)),
            "mean_abs_diff": F.avg(d),
            "sd_season": F.coalesce(F.sqrt(F.avg(sd * sd) if season < w else square), F.lit(0.0)),
        }
    found = cells.groupBy("unique_id", "_at").agg(
        *[c.alias(n) for n, c in sums.items()],
        *slots,
        F.max("_rn").alias("_last"),
        F.count_if(idx == at).alias("_rows"),
    )
    # A series without a row at the cutoff has no window there; one with repeated rows has as many.
    found = found.where("_rows > 0").withColumn("_row", F.explode(F.sequence(F.lit(1).cast(long), F.col("_rows"))))
    places = F.array(*[F.col(f"_y{j}") for j in range(s)])
    tail = F.array(*[F.get(places, F.pmod(F.col("_last") + (j + 1), F.lit(s)).cast("int")) for j in range(s)])
    found = found.withColumn("_tail", tail)
    columns = _whole_columns(s) if whole else [*sums, F.when(F.col("n_obs") >= s, F.col("_tail")).alias("tail")]
    return found.select(cal.period_label(at, freq).alias("cutoff"), "unique_id", *columns)


def _whole_stats(rows: DataFrame, w: int, m: int, s: int) -> DataFrame:
    """Statistics of whole numbers at every period, from running sums."""
    series = Window.partitionBy("unique_id").orderBy("idx")

    def in_window(value: Column, skipped: int) -> Column:
        upto = F.sum(value).over(series.rangeBetween(Window.unboundedPreceding, 0))
        out = F.sum(value).over(series.rangeBetween(Window.unboundedPreceding, -(w - skipped)))
        return F.coalesce(upto, F.lit(0)) - F.coalesce(out, F.lit(0))

    y, one = F.col("y"), F.lit(1).cast("long")
    stats = _with_differences(rows, m, s).select(
        "unique_id",
        "idx",
        in_window(one, 0).alias("n_obs"),
        in_window(y, 0).alias("sum_y"),
        in_window(F.abs(y), 0).alias("sum_abs_y"),
        in_window(_exact_square(y), 0).alias("sum_y2"),
        in_window(F.when(F.col("_d").isNotNull(), one), m).alias("n_diff"),
        in_window(F.col("_d"), m).alias("sum_abs_diff"),
        in_window(F.when(F.col("_sd").isNotNull(), one), min(s, w)).alias("n_sdiff"),
        in_window(_exact_square(F.col("_sd")), min(s, w)).alias("sum_sdiff2"),
        _tail(s).alias("_tail"),
    )
    return stats.select("idx", "unique_id", *_whole_columns(s))


def _whole_columns(s: int) -> list[Column]:
    """Statistics from exact counts and sums."""
    n = F.col("n_obs").cast("decimal(20,0)")
    spread = (n * F.col("sum_y2") - F.col("sum_y").cast("decimal(19,0)") * F.col("sum_y")).cast("double")
    return [
        F.col("n_obs"),
        (F.col("sum_y") / F.col("n_obs")).alias("mean_y"),
        (F.col("sum_abs_y") / F.col("n_obs")).alias("mean_abs_y"),
        F.when(
            F.col("n_obs") > 1,
            F.sqrt(spread / (F.col("n_obs") * (F.col("n_obs") - 1)).cast("double")),
        ).otherwise(F.lit(0.0)).alias("sd_y"),
        F.when(F.col("n_diff") > 0, F.col("sum_abs_diff") / F.col("n_diff")).alias("mean_abs_diff"),
        F.when(
            F.col("n_sdiff") > 0, F.sqrt(F.col("sum_sdiff2").cast("double") / F.col("n_sdiff"))
        ).otherwise(F.lit(0.0)).alias("sd_season"),
        F.when(F.col("n_obs") >= s, F.col("_tail")).alias("tail"),
    ]


# Count, mean and sum of squared deviations of values; two of them merge without loss of digits.
_Moments = tuple[Column, Column, Column]


def _merged(a: _Moments, b: _Moments) -> _Moments:
    n = a[0] + b[0]
    mean_a, mean_b = F.coalesce(a[1], F.lit(0.0)), F.coalesce(b[1], F.lit(0.0))
    between = (mean_a - mean_b) * (mean_a - mean_b) * a[0] * b[0] / n
    mean = F.when(n > 0, (mean_a * a[0] + mean_b * b[0]) / n)
    return n, mean, F.coalesce(a[2], F.lit(0.0)) + F.coalesce(b[2], F.lit(0.0)) + F.coalesce(between, F.lit(0.0))


def _block_windows(rows: DataFrame, length: int, values: dict[str, Column]) -> DataFrame:
    """Moments of the last ``length`` periods at each row, as ``n_<name>, mean_<name>, m2_<name>``.

    Every row also stands ``length`` periods later, in the next block. A window that ends at ``i`` holds the rows of its own block up
    to ``i``, and those of the block before that stand behind ``i``; both grow row by row and are never taken apart.
    """
    both = rows.select(
        "*", F.explode(F.array(
            F.struct(F.col("idx").alias("_key"), F.lit(True).alias("_own")),
            F.struct((F.col("idx") + length).alias("_key"), F.lit(False).alias("_own")),
        )).alias("_at"),
    ).select(*rows.columns, "_at._key", "_at._own").withColumn("_block", F.floor(F.col("_key") / length))
    block = Window.partitionBy("unique_id", "_block")
    own = block.orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    before = block.orderBy(F.desc("_key")).rangeBetween(Window.unboundedPreceding, -1)

    def moments(value: Column, over) -> _Moments:
        n = F.count(value).over(over)
        return n, F.avg(value).over(over), F.var_pop(value).over(over) * n

    parts = {}
    for name, value in values.items():
        for side, test, over in (("a", F.col("_own"), own), ("b", ~F.col("_own"), before)):
            found = moments(F.when(test, value).cast("double"), over)
            parts |= {f"_{side}{k}_{name}": column for k, column in enumerate(found)}
    wide = both.select(*rows.columns, "_own", *[c.alias(n) for n, c in parts.items()]).where("_own")
    sums = {}
    for name in values:
        a, b = (tuple(F.col(f"_{side}{k}_{name}") for k in range(3)) for side in "ab")
        sums |= dict(zip((f"n_{name}", f"mean_{name}", f"m2_{name}"), _merged(a, b)))
    return wide.select(*rows.columns, *[c.alias(n) for n, c in sums.items()])


def _fraction_stats(rows: DataFrame, w: int, m: int, s: int) -> DataFrame:
    """Statistics of fractions at every period, from sums over blocks."""
    y, season = F.col("y"), min(s, w)
    found = _with_differences(rows, m, s).withColumn("_tail", _tail(s))
    found = _block_windows(found, w, {"y": y, "abs": F.abs(y)})
    found = _block_windows(found, w - m, {"d": F.col("_d")})
    square = F.lit(None).cast("double")
    if season < w:
        found = _block_windows(found, w - season, {"sd": F.col("_sd") * F.col("_sd")})
        square = F.col("mean_sd")
    n = F.col("n_y")
    return found.select(
        "idx",
        "unique_id",
        n.alias("n_obs"),
        F.col("mean_y"),
        F.col("mean_abs").alias("mean_abs_y"),
        F.when(n > 1, F.sqrt(F.col("m2_y") / (n - 1))).otherwise(F.lit(0.0)).alias("sd_y"),
        F.col("mean_d").alias("mean_abs_diff"),
        F.coalesce(F.sqrt(square), F.lit(0.0)).alias("sd_season"),
        F.when(n >= s, F.col("_tail")).alias("tail"),
    )


def alignment(
    panel: DataFrame, cutoffs: Cutoffs, freq: str | cal.Frequency, window: int | None = None
) -> DataFrame:
    """Per cutoff: do all series of its window end exactly at the cutoff.

    A row is its series' last one for the cutoffs between it and the next row, so
    no window has to be read back.
    """
    f = cal.frequency(freq)
    w = window or f.window
    cutoffs = _for_all(cutoffs)
    rows = _bounded(panel, cutoffs, f, w, 0).select(
        "unique_id", cal.period_index(F.col("ds"), f).alias("last_idx")
    )
    following = F.lead("last_idx").over(Window.partitionBy("unique_id").orderBy("last_idx"))
    until = F.coalesce(F.least(following - 1, F.col("last_idx") + w - 1), F.col("last_idx") + w - 1)
    reach = rows.withColumn("_until", until)
    met = _within(F.col("last_idx"), F.col("_until"), w, listed_cutoffs(cutoffs, f), f)
    last = reach.withColumn("cutoff_idx", F.explode(met)).withColumn("cutoff", cal.period_label(F.col("cutoff_idx"), f))
    late = F.col("last_idx") != F.col("cutoff_idx")
    return last.groupBy("cutoff").agg(
        F.count("*").alias("n_series"),
        F.count_if(late).alias("n_misaligned"),
        (F.count_if(late) == 0).alias("aligned"),
    )


def preview(rows: DataFrame) -> DataFrame:
    """Row count, number of series and range of a panel."""
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("unique_id").alias("n_series"),
        F.min("ds").alias("min_ds"),
        F.max("ds").alias("max_ds"),
    )


def head(rows: DataFrame, n: int = 10) -> DataFrame:
    """First rows in series and time order."""
    return rows.orderBy("unique_id", "ds").limit(n)
