"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the ``K`` least distinct 64-bit hashes of a text's five-word shingles, as base64 text.
Fingerprints of parts are merged by taking the least ``K`` of all their hashes, which gives the fingerprint of the
whole shingle set. From one the number of distinct shingles is estimated, from two their resemblance
(Jaccard) and containment.

Defined results: a null text is an empty one; a text of one to four words is one shingle; a text without words
has an empty fingerprint, which is like another empty one (1.0) and unlike all others (0.0); equal
texts have equal fingerprints. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm.tasks import SLICE_BYTES, column, ship_functions, slices

K = 64
SHINGLE_WORDS = 5


# --- one fingerprint and two ---------------------------------------------------------


def sketches(texts: pa.Array, k: int = K, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The ``k`` least distinct shingle hashes of each text, in order."""
    doc, h = arrays.shingles(texts, size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [h[a : min(b, a + k)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0**64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Fingerprint of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the part of the union's least ``k`` hashes that both have."""
    if not len(a) and not len(b):
        return 1.0
    _, count = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((count[:k] == 2).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of ``a``'s shingles that ``b`` has too; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    like = resemblance(a, b, k)
    return min(1.0, like / (1 + like) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


# --- DataFrames ---------------------------------------------------------------------


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made = sketches(batch.column(0))
        yield pa.record_batch(
            [batch.column(1), pa.array([encode(s) for s in made], pa.string()), pa.array([distinct(s) for s in made], pa.float64())],
            ["doc_id", "fingerprint", "shingles"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, shingles`` (estimated distinct shingles) of every row of ``docs``."""
    ship_functions(docs.sparkSession)
    base = docs.select(column(docs, "text").alias("text"), column(docs, "doc_id").cast("long").alias("doc_id"))
    return base.mapInArrow(_fingerprints, "doc_id long, fingerprint string, shingles double")


def merged(prints: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """``keys, fingerprint`` of the union of all texts of a group, from a table with ``fingerprint``.

    Hashes are made distinct and cut to the least ``k`` before and after the shuffle; no group is gathered.
    """
    raw = F.unbase64("fingerprint")
    one = F.transform(F.sequence(F.lit(0), (F.octet_length(raw) / 8 - 1).cast("int")), lambda i: _big_endian(raw, i))
    hashes = prints.where("fingerprint <> ''").select(*keys, F.explode(one).alias("hash")).distinct()
    first = hashes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).where(F.col("place") <= k)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list("hash")).alias("hashes"))
    back = F.array_join(F.transform("hashes", lambda h: _reversed_hex(h)), "")
    return listed.select(*keys, F.translate(F.base64(F.unhex(back)), "\r\n", "").alias("fingerprint"))


def _reversed_hex(text):
    """Hex text with its eight bytes in the other order."""
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(7, -1, -1)])


def _big_endian(raw, i):
    """The i-th hash as hex text that sorts like the number."""
    return _reversed_hex(F.hex(F.substring(raw, (i * 8 + 1).cast("int"), F.lit(8))))


# --- edited texts -------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by the first as many of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block and place in it; each is compared with the next row of its block."""
    held: list[tuple] = []  # rows not yet answered; the last one waits for its successor
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            held.append(row)
            size += len(row[0])
            if size >= SLICE_BYTES:
                yield _answers(held)
                held, size = held[-1:], 0
    if held:
        yield _answers(held)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    own = sketches(pa.array([r[0] for r in rows], pa.large_string()))
    at = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
    texts = [edited(rows[i][0], rows[i + 1][0]) for i in at]
    other = sketches(pa.array(texts, pa.large_string()))
    return pa.record_batch(
        [
            pa.array([rows[i][1] for i in at], pa.int64()),
            pa.array([len(rows[i][0]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            pa.array([encode(own[i]) for i in at], pa.string()),
            pa.array([encode(s) for s in other], pa.string()),
            pa.array([resemblance(own[i], s) for i, s in zip(at, other, strict=True)], pa.float64()),
            pa.array([resemblance(own[i], own[i + 1]) for i in at], pa.float64()),
            pa.array([containment(own[i], s) for i, s in zip(at, other, strict=True)], pa.float64()),
            pa.array([distinct(own[i]) for i in at], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained", "shingles"],
    )


def _deals(spark: SparkSession, partitions: int) -> list[int]:
    """A number for each partition that a shuffle by it puts there, so that every block gets a task of its own."""
    number = F.col("id").cast("int")
    tried = spark.range(40 * partitions).select(number.alias("id"), F.pmod(F.hash(number), F.lit(partitions)).alias("p"))
    found = {r.p: r.id for r in tried.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [found.get(p, p) for p in range(partitions)]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs``, of its edited text, and their likeness.

    The next document is the one with the next smaller id, after the last one the first. Rows are dealt to
    blocks of the id by approximate quantiles and sorted within them, so neighbours meet in one task. A block
    also gets a copy of the first row of the next block. Only one id per block goes through the driver.
    Rows with the same id follow one another in the order of their texts; rows without id come last.
    """
    spark = docs.sparkSession
    ship_functions(spark)
    base = docs.select(F.coalesce(column(docs, "text"), F.lit("")).alias("text"), column(docs, "doc_id").cast("long").alias("doc_id"))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [i / blocks for i in range(1, blocks)]
    found = base.agg(F.percentile_approx("doc_id", wanted, 20 * blocks)).first()[0] if wanted else None
    bounds = sorted(set(found or []))

    deals = _deals(spark, blocks)

    @F.arrow_udf("int")
    def block_of(ids: pa.Array) -> pa.Array:
        place = np.searchsorted(np.array(bounds, np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, place).astype(np.int32))

    placed = base.withColumn("block", block_of("doc_id"))
    heads = sorted(placed.groupBy("block").agg(F.max("doc_id")).collect())
    # The rows that follow block i are those of block i - 1; behind the lowest block comes the highest.
    follows = [(heads[i][0], heads[i - 1][1]) for i in range(len(heads))]
    guests = spark.createDataFrame(follows, "block int, doc_id long")
    copies = (
        base.join(F.broadcast(guests), base["doc_id"].eqNullSafe(guests["doc_id"]))
        .groupBy("block", guests["doc_id"]).agg(F.min("text").alias("text"))
        .select("text", "doc_id", "block", F.lit(True).alias("guest"))
    )
    rows = placed.withColumn("guest", F.lit(False)).unionByName(copies)
    dealt = F.get(F.lit(deals), F.col("block"))
    return (
        rows.repartition(blocks, dealt)
        .sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(
            _compared,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, contained double, shingles double",
        )
    )
