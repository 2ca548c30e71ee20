"""Scoring expressions and forecast column names."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUANTILE = re.compile(r"^q_(\d+)$")
_ALIASED = re.compile(r"^(.+)-q-(\d+)$")


def quantile_column(level: int) -> str:
    """Name of the column that holds the quantile of a level in percent."""
    return f"q_{level}"


def quantile_levels(columns: Iterable[str]) -> list[int]:
    """Levels present among ``columns``, ascending."""
    return sorted(int(m.group(1)) for m in map(_QUANTILE.match, columns) if m)


def detect_alias(columns: Iterable[str]) -> str | None:
    """Model alias of a per-model forecast file, from its quantile column names."""
    return next((m.group(1) for m in map(_ALIASED.match, columns) if m), None)


def aliased_levels(columns: Iterable[str], alias: str) -> list[int]:
    """Levels of one alias in a per-model forecast file, ascending."""
    found = (_ALIASED.match(c) for c in columns)
    return sorted(int(m.group(2)) for m in found if m and m.group(1) == alias)


def clip_lower(value: Column, floor: float) -> Column:
    """Raise ``value`` to ``floor``; null stays null, unlike ``greatest``."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient, or null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def pinball(y: Column, forecast: Column, level: int, convention: str = "reference") -> Column:
    """Quantile loss of one forecast.

    ``reference`` weighs an over-forecast by the level, which is how the
    benchmark defines its scores; ``standard`` is the textbook loss, which weighs
    an under-forecast by the level.
    """
    q = level / 100
    if convention == "reference":
        d = forecast - y
    elif convention == "standard":
        d = y - forecast
    else:
        raise ValueError(f"Unknown convention: {convention}")
    return F.greatest(d * q, d * (q - 1))


def mean_pinball(
    y: Column,
    forecasts: dict[int, Column],
    convention: str = "reference",
) -> Column:
    """Mean quantile loss over all levels of one row."""
    losses = [pinball(y, col, level, convention) for level, col in sorted(forecasts.items())]
    return reduce(lambda a, b: a + b, losses) / len(losses)
