"""Quality rules with adaptive thresholds, with DataFrame functions only.

Each document gets counts of its words, symbols, repeated lines and repeated eight-word windows. Two
fixed base rules reject texts that are too short or repeat themselves. All other limits are learned:
for each language and source, and each measure, a quantile sketch is built, and a document is rejected if a
measure lies beyond the fence ``upper quartile + SPREADS * (upper - lower quartile)``, but at least
a margin above the quartile (for word length also below, alike). The fences are joined back on language
and source.

The sketch counts values in classes of 1/32 of a power of two. It is merged by adding counts, so it is
built within tasks, has a bounded number of rows per group, and gives the same quantiles (within 3 %)
in whatever order parts arrive. Groups with fewer than ``LEAST_ROWS`` documents use the sketch of their
language, merged over its sources, and small languages the one of all documents.

Defined results: a null text has no words and fails the base rules; null is a language or source of its
own; repeated rows are judged alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.mixing import size_class
from panelspark.llm.tasks import column
from panelspark.llm.words import SPACES, words
from panelspark.session import settle

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"

LEAST_ROWS = 100
SPREADS = 3
# Measures with their least margin, in parts of the unit (a millionth, a thousandth of a character).
MARGINS = {"symbol_share": 50_000, "line_share": 400_000, "repeat_share": 250_000, "word_length": 2_000}
TWO_SIDED = ("word_length",)


def _repeat_words(found: Column) -> Column:
    """Words in windows of ``WINDOW_WORDS`` that stand twice or more in the array ``found``."""
    n = F.size(found) - (WINDOW_WORDS - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(found, i, WINDOW_WORDS)))
    return F.when(n >= 1, hashes)


def _covered(hashes: Column) -> Column:
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(p["h"] == F.get(pairs, k)["h"], F.lit(False))
        marked = F.transform(pairs, lambda p, k: F.when(same(p, k + 1) | same(p, k - 1), p["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def length(begin: Column) -> Column:
        gaps = F.transform(begin, lambda b, k: F.least(F.coalesce(F.get(begin, k + 1) - b, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    # A one-element transform names an intermediate array once, so it is not computed at each use.
    named = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return named(named(ordered, starts), length)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every row of ``docs``."""
    text = F.coalesce(column(docs, "text"), F.lit(""))
    base = docs.select(
        column(docs, "doc_id").alias("doc_id"), column(docs, "lang").cast("string").alias("lang"),
        column(docs, "source").cast("string").alias("source"), text.alias("text"), words(text).alias("found"),
    )
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "")
    counted = base.select(
        "doc_id", "lang", "source",
        F.size("found").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _repeat_words(F.col("found")).alias("hashes"),
    )
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes")))
        .otherwise(0).cast("long").alias("n_repeat_words"),
    )


def _share(part: Column, whole: Column, unit: int) -> Column:
    return F.when(whole > 0, F.floor(part * unit / whole)).otherwise(0).cast("long")


def _values() -> dict[str, Column]:
    c = F.col
    return {
        "symbol_share": _share(c("n_symbols"), c("word_chars"), 1_000_000),
        "line_share": _share(c("n_dup_lines"), c("n_lines"), 1_000_000),
        "repeat_share": _share(c("n_repeat_words"), c("n_words"), 1_000_000),
        "word_length": _share(c("word_chars"), c("n_words"), 1_000),
    }


def _class_value(number: Column) -> Column:
    """Least value of a size class."""
    step = F.greatest(F.floor((number - 32) / 32), F.lit(0))
    return ((number - step * 32) * F.pow(F.lit(2.0), step)).cast("long")


def _key(value: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(value)), F.lit("null"))


def sketch(values: DataFrame) -> DataFrame:
    """Quantile sketches: ``lang, source, measure, class, n``. Two of them are merged by adding ``n``."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, MARGINS)), F.array(*MARGINS)))
    return (
        values.select(_key("lang").alias("lang"), _key("source").alias("source"), pairs.alias("measure", "value"))
        .groupBy("lang", "source", "measure", size_class(F.col("value")).alias("class")).agg(F.count("*").alias("n"))
    )


def fences(sketches: DataFrame) -> DataFrame:
    """``lang, source`` and for each measure its ``low_`` and ``high_`` limit."""

    def quartiles(parts: DataFrame, *keys: str) -> DataFrame:
        """Merge sketches over the other keys; the windows hold the classes of one group."""
        merged = parts.groupBy(*keys, "measure", "class").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "measure")
        running = F.sum("n").over(group.orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
        ranked = merged.withColumn("upto", running).withColumn("rows", F.sum("n").over(group))
        reached = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("class")))
        return ranked.groupBy(*keys, "measure").agg(
            F.max("rows").alias("rows"), _class_value(reached(1)).alias("q1"), _class_value(reached(3)).alias("q3")
        )

    own = quartiles(sketches, "lang", "source")
    lang = quartiles(sketches, "lang").select("lang", "measure", *(F.col(c).alias(f"lang_{c}") for c in ("rows", "q1", "q3")))
    every = quartiles(sketches).select("measure", *(F.col(c).alias(f"all_{c}") for c in ("q1", "q3")))
    joined = own.join(lang, ["lang", "measure"]).join(every, "measure")
    pick = lambda q: (
        F.when(F.col("rows") >= LEAST_ROWS, F.col(q)).when(F.col("lang_rows") >= LEAST_ROWS, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    )
    margin = F.element_at(F.create_map(*[F.lit(x) for pair in MARGINS.items() for x in pair]), F.col("measure"))
    joined = joined.withColumns({"q1": pick("q1"), "q3": pick("q3")}).withColumn(
        "reach", F.greatest(SPREADS * (F.col("q3") - F.col("q1")), margin)
    )
    is_own = lambda name: F.col("measure") == name
    return joined.groupBy("lang", "source").agg(
        *[F.max(F.when(is_own(m), F.col("q3") + F.col("reach"))).alias(f"high_{m}") for m in MARGINS],
        *[F.max(F.when(is_own(m), F.col("q1") - F.col("reach"))).alias(f"low_{m}") for m in TWO_SIDED],
    )


def judge(docs: DataFrame) -> DataFrame:
    """Counts of every row of ``docs`` with ``base_failed``, ``kept`` and ``reasons`` (measures beyond their fence)."""
    values = settle(measures(docs).withColumns(_values()), "measures")
    limits = fences(sketch(values))
    beyond = {m: F.col(m) > F.col(f"high_{m}") for m in MARGINS}
    for m in TWO_SIDED:
        beyond[m] |= F.col(m) < F.col(f"low_{m}")
    joined = values.withColumns({"lang_key": _key("lang"), "source_key": _key("source")}).join(
        limits.withColumnsRenamed({"lang": "lang_key", "source": "source_key"}), ["lang_key", "source_key"]
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    reasons = F.filter(F.array(*[F.when(test, F.lit(m)) for m, test in beyond.items()]), lambda m: m.isNotNull())
    return joined.withColumns({"base_failed": failed, "reasons": reasons}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("reasons") == 0)
    )
