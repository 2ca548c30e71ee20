"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's target share of all words is set by weight, but at most ``MAX_REPEATS`` times its own
words; what is over is shared among the other sources by weight until none is above. Each document
of a source then has the same expected number of copies, ``target / source words``. The documents of
a source are put in order of size, the expected copies are summed along it, one random offset per
source is added, and a document is emitted once per integer boundary its interval crosses.

As the order is by size, the words taken come near the target, not only the number of documents. The order
is by size class (1/32 of a power of two), then by a salted hash. A rank in it is found in two steps, cells
of (source, size class, hash prefix) first, so a source with a third of all documents, or a third of them
of one size, is spread over many tasks.

Defined results: a null text has size 0; a source without words has target 0 and no document of it is
taken; null is a source of its own, the last one; repeated rows are documents of their own; other
columns are kept by :func:`mix_documents` and ignored by :func:`expected_copies`; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.tasks import column
from panelspark.llm.words import word_count
from panelspark.session import settle

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = "mix-1"
# Hex digits of the hash that split a size class into cells.
_CELL_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``src, source_size, target`` for a table ``src, source_size`` with one row per source.

    Sources in code point order get the weights in turn. With all targets at
    ``min(max_repeats * size, level * weight)`` there is one level at which they add up to all words: in
    order of ``size / weight``, that of the first source that does not go beyond its limit.
    The windows hold one row per source.
    """
    ordered = Window.orderBy("src")
    number = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everywhere))
    )
    return ranked.select(
        "src", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def size_class(size: Column) -> Column:
    """Order-keeping class of a size: exact below 64, then 32 classes for each power of two."""
    bits = F.length(F.bin(size))
    step = F.greatest(bits - 6, F.lit(0))
    return (step * 32 + F.floor(size / F.pow(F.lit(2.0), step))).cast("int")


def _key(source: Column) -> Column:
    """A source as a text that is never null and keeps the order, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _with_copies(rows: DataFrame, weights: Sequence[float], max_repeats: int, seed: str) -> DataFrame:
    """Add ``source_size, target, copies`` to rows with ``src, size, id``."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    rows = (
        rows.withColumn("class", size_class(F.col("size")))
        .withColumn("digest", digest).withColumn("cell", F.substring("digest", 1, _CELL_DIGITS))
    )
    cells = rows.groupBy("src", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    # At most 16 ** _CELL_DIGITS cells are in a window, and at most a few thousand size classes.
    classes = cells.groupBy("src", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = source_targets(classes.groupBy("src").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    before = lambda *keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda window: F.coalesce(F.sum("n").over(window), F.lit(0))
    class_start = classes.select("src", "class", start(before("src", order="class")).alias("class_start"))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("offset"), "src")), 1, 8), 16, 10).cast("double")
    cells = (
        cells.withColumn("cell_start", start(before("src", "class", order="cell")))
        .join(class_start, ["src", "class"]).join(sources, "src")
        .select(
            "src", "class", "cell", "source_size", "target",
            (F.col("class_start") + F.col("cell_start")).alias("first"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("each"),
            (offset / F.lit(float(16**8))).alias("offset"),
        )
    )
    in_cell = Window.partitionBy("src", "class", "cell").orderBy("digest", "size", F.col("id").asc_nulls_last())
    joined = rows.withColumn("place", F.row_number().over(in_cell)).join(cells, ["src", "class", "cell"])
    rank = F.col("first") + F.col("place")
    upto = lambda n: F.floor(n * F.col("each") + F.col("offset"))
    copies = F.least(upto(rank) - upto(rank - 1), F.lit(max_repeats)).cast("long")
    return joined.withColumn("copies", copies).drop("class", "digest", "cell", "place", "first", "each", "offset")


def expected_copies(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row of ``docs``."""
    source = column(docs, "source")
    rows = settle(
        docs.select(
            column(docs, "doc_id").alias("id"), _key(source).alias("src"), source.alias("source"),
            word_count(column(docs, "text")).alias("size"),
        ),
        "sizes",
    )
    return _with_copies(rows, weights, max_repeats, seed).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies"
    )


def mix_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED
) -> DataFrame:
    """The mix: every row of ``docs`` as often as it is taken, with all its columns."""
    rows = docs.select(
        F.struct(*[column(docs, c) for c in docs.columns]).alias("row"),
        column(docs, "doc_id").alias("id"), _key(column(docs, "source")).alias("src"),
        F.explode(F.array(word_count(column(docs, "text")))).alias("size"),  # so that the words are counted once, not at each use
    )
    taken = _with_copies(rows, weights, max_repeats, seed).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
