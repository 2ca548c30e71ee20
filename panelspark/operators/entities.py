"""Entity selection: yearly statistics, eligibility, strata and the salted sample."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import KEEP_EVENT_TYPES, METRICS, SAMPLE_SALT
from panelspark.functions import calendar as cal
from panelspark.functions.hashing import sample_key
from panelspark.operators.ranking import count_percent_rank, top_per_group
from panelspark.operators.series import metric_counts
from panelspark.session import settle

# Strata as half-open percent-rank ranges; the top one is closed.
STRATA = {"low": (0.0, 0.20), "medium": (0.40, 0.60), "large": (0.90, None)}
# Entities taken from each stratum.
SAMPLE_SIZES = {"large": 200, "medium": 100, "low": 100}
TOP_SHARE = 0.99


def base_events(raw: DataFrame, year: int) -> DataFrame:
    """Kept events of a year with a known entity, and their parsed time."""
    return raw.where(
        (F.col("year") == year)
        & F.col("event_type").isin(*KEEP_EVENT_TYPES)
        & F.col("repo_id").isNotNull()
        & F.col("repo_name").isNotNull()
    ).select("repo_id", "repo_name", "event_type", "action", F.to_timestamp("created_at").alias("ts"))


_WORD = 63  # units kept in one long


def active_words(ts: Column, unit: str, start: dt.datetime, end: dt.datetime) -> list[Column]:
    """Calendar units of ``[start, end)`` that hold an event, as bits of a few longs.

    Units are numbered from the start of the range. Bit sets merge with ``bit_or``,
    so this needs no distinct count, which would multiply the rows.
    """
    freq = {"month": "monthly", "week": "weekly", "day": "daily"}[unit]
    inside = (ts >= F.lit(start)) & (ts < F.lit(end))
    number = cal.period_index(ts, freq) - cal.period_index(F.lit(start), freq)
    months = (end.year - start.year) * 12 + end.month - start.month
    days = (end - start).days
    units = {"month": months, "week": days // 7, "day": days}[unit] + 2
    words = []
    for word in range(-(-units // _WORD)):
        here = inside & (F.floor(number / _WORD) == word)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (number % _WORD).cast("int"))
        words.append(F.bit_or(F.when(here, bit)).alias(f"_active_{word}"))
    return words


def active_count(names: list[str]) -> Column:
    """Number of units set in the given words."""
    counts = [F.bit_count(F.coalesce(F.col(n), F.lit(0).cast("long"))) for n in names]
    return reduce(lambda a, b: a + b, counts).cast("long")


def entity_stats(
    raw: DataFrame,
    year: int,
    active_from: dt.datetime,
    active_to: dt.datetime,
    unit: str = "month",
) -> DataFrame:
    """Yearly counts and active units per entity, in one pass over the raw events.

    The entity's name is the largest one it had in the year. Events are first
    grouped by id and name, because a maximum of strings would make Spark sort the
    raw events; the second grouping only sees one row per name.
    """
    words = active_words(F.col("ts"), unit, active_from, active_to)
    names = [f"_active_{i}" for i in range(len(words))]
    counts = (*METRICS, "total_events")
    by_name = base_events(raw, year).groupBy("repo_id", "repo_name").agg(
        *metric_counts(), F.count("*").alias("total_events"), *words
    )
    merged = by_name.groupBy("repo_id").agg(
        F.max("repo_name").alias("repo_name"),
        *[F.sum(c).alias(c) for c in counts],
        *[F.bit_or(n).alias(n) for n in names],
    )
    return merged.select("repo_id", "repo_name", *counts, active_count(names).alias("active_units"))


def eligible_entities(stats: DataFrame, required_active: int) -> DataFrame:
    """Entities active in every required unit and starred at least once."""
    return stats.where((F.col("active_units") == required_active) & (F.col("stars") > 0))


def star_ranks(eligible: DataFrame, top_share: float = TOP_SHARE) -> DataFrame:
    """Percent ranks by stars, per star count.

    ``star_prank_all`` ranks all eligible entities; ``star_prank_upper`` ranks
    again among those at or above ``top_share``, the only ones returned. Equal
    star counts share both ranks, so the star histogram is all that is needed.
    """
    histogram = eligible.groupBy("stars").agg(F.count("*").alias("n"))
    upper = count_percent_rank(histogram, "stars", "star_prank_all").where(
        F.col("star_prank_all") >= top_share
    )
    return count_percent_rank(upper, "stars", "star_prank_upper").drop("n")


def size_bucket(rank: Column) -> Column:
    """Stratum of a percent rank; null between the strata."""
    bucket = F.lit(None).cast("string")
    for name, (low, high) in STRATA.items():
        inside = rank >= low if high is None else (rank >= low) & (rank < high)
        bucket = F.when(inside, name).otherwise(bucket)
    return bucket


def rank_entities(eligible: DataFrame, top_share: float = TOP_SHARE) -> DataFrame:
    """Top entities with both percent ranks and their stratum.

    Entities below the cut, among them the very many with a few stars, are left
    out before the join on the star count.
    """
    ranks = settle(star_ranks(eligible, top_share), "star-ranks")
    lowest = ranks.select(F.min("stars")).scalar()
    ranked = eligible.where(F.col("stars") >= lowest).join(ranks, "stars")
    return ranked.withColumn("size_bucket", size_bucket(F.col("star_prank_upper")))


def select_entities(
    raw: DataFrame,
    year: int,
    unit: str = "month",
    active_from: dt.datetime | None = None,
    active_to: dt.datetime | None = None,
    required_active: int = 6,
    top_share: float = TOP_SHARE,
    sizes: dict[str, int] | None = None,
    salt: str = SAMPLE_SALT,
    sample_hash: str = "xxh64",
) -> DataFrame:
    """The benchmark's entities: a salted, deterministic sample of each stratum.

    The statistics are staged, so the raw events are read once although the star
    histogram and the final selection both need them.
    """
    active_from = active_from or dt.datetime(year, 7, 1, tzinfo=cal.UTC)
    active_to = active_to or dt.datetime(year + 1, 1, 1, tzinfo=cal.UTC)
    stats = entity_stats(raw, year, active_from, active_to, unit)
    eligible = settle(eligible_entities(stats, required_active), "eligible")
    strata = rank_entities(eligible, top_share).where(F.col("size_bucket").isNotNull())
    order = [sample_key(F.col("repo_id"), salt, sample_hash), F.col("repo_id")]
    sample = top_per_group(strata, "size_bucket", order, sizes or SAMPLE_SIZES)
    return sample.select(
        "repo_id",
        "repo_name",
        "size_bucket",
        "stars",
        "prs_opened",
        "issues_opened",
        "pushes",
        "total_events",
        "active_units",
        "star_prank_all",
        "star_prank_upper",
    )


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """Entity ids that occur more than once; they would be counted twice."""
    counts = entities.groupBy("repo_id").agg(F.count("*").alias("n"))
    return counts.where("n > 1")
