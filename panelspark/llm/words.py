"""Words and their counts as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a word, and a pattern of a run of them.
SPACES = " \t\n\x0b\x0c\r"
BREAK = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, as a long."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAK)
    # Only the first and the last part can be empty.
    empty = (F.element_at(parts, 1) == "").cast("int") + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return (F.size(parts) - empty).cast("long")
