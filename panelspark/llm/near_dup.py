"""Near duplicates by improved consistent weighted sampling (ICWS).

A document is the multiset of its five-word shingles with TF-IDF weights. ``HASHES`` ICWS samples
make its sketch; two documents agree on a sample with a probability equal to their weighted Jaccard
similarity. Sketches are cut into bands; documents that share a band are candidates, and a candidate
pair is a link if its exact weighted Jaccard similarity reaches the threshold. A class is a connected
component of links.

IDF is tempered: a shingle in at most ``COMMON`` of all documents weighs 1 and a more frequent one
``0.5 + 0.5 * ln(N/df) / ln(1/COMMON)``. So boilerplate counts less, a large group of copies still
finds its own members, and only frequent shingles need a table. There are at most
``mean shingles per document / COMMON`` of those, whatever the number of documents.

Candidates are not paired off within a band. First all members of a bucket are compared with one leader (the member
that shares the most bands), which settles most groups of copies at once. Members of buckets that still hold
several components are then judged by exact bounds, before any pair is formed: a text whose own shingles (that no other
open text has) weigh too much cannot reach the threshold with any other and is done. The others of a bucket are dealt to
blocks of bounded size, every two of which meet in a task that compares them exactly and returns links only. So no
candidate pair is left undecided, and no pair that is no link becomes a row.

Defined results: a null text is an empty one; equal texts share a class, empty ones too; a text of one
to four words is one shingle. The class id is the least ``doc_id`` of the class, null if it has none.
Rows with a null id or a repeated id are classed by their text. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm.components import joined_components
from panelspark.llm.tasks import column, ship_functions, slices
from panelspark.session import settle

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_HASHES = 12, 4
HASHES = BANDS * BAND_HASHES
COMMON = 0.05
# Members of a block, and tokens that are compared at once.
_BLOCK, _COLUMNS = 256, 4096

_BUCKETS = 1 << 17
_KEY_BITS = np.uint64(48)
_KEY_MASK = (np.uint64(1) << _KEY_BITS) - np.uint64(1)


# --- shingles and weights ------------------------------------------------------------


def _counts(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, shingle) keys with their term frequency. The row is in the upper 16 bits."""
    doc, h = arrays.shingles(texts, size)
    key = (doc.astype(np.uint64) << _KEY_BITS) | (h >> np.uint64(16))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    return key[start], np.diff(np.append(start, len(key)))


def _weights(key: np.ndarray, tf: np.ndarray, common: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights; ``common`` holds the frequent shingles in order, all others have IDF 1."""
    weight = tf.astype(np.float64)
    if len(common):
        shingle = key & _KEY_MASK
        place = np.minimum(np.searchsorted(common, shingle), len(common) - 1)
        hit = common[place] == shingle
        weight[hit] *= idf[place[hit]]
    return weight


def _bucket_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(_BUCKETS - 1)).astype(np.int64)


def _bucket_counts(size: int):
    """Documents by hash bucket of their shingles, one row per task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for batch in slices(batches):
            key, _ = _counts(batch.column(0), size)
            total += np.bincount(_bucket_of(key & _KEY_MASK), minlength=_BUCKETS)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    return run


def _exact_counts(size: int, wanted: np.ndarray):
    """Documents by shingle, for shingles of the wanted buckets, counted within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, _ = _counts(batch.column(0), size)
            shingle = key & _KEY_MASK
            found, n = np.unique(shingle[wanted[_bucket_of(shingle)]], return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return run


def frequent_shingles(texts: DataFrame, size: int = SHINGLE_WORDS, common: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than ``common`` of all texts, in order, with their IDF.

    A first pass counts hash buckets, a second one counts exactly the shingles of buckets that reach
    the limit. At most ``mean shingles per document / common`` shingles can be in the result.
    """
    total = texts.count()
    least = common * total
    buckets = (
        texts.mapInArrow(_bucket_counts(size), "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("bucket")
    )
    wanted = np.zeros(_BUCKETS, bool)
    wanted[[r.bucket for r in buckets.collect()]] = True  # at most _BUCKETS numbers
    if not wanted.any():
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = (
        texts.mapInArrow(_exact_counts(size, wanted), "shingle long, n long")
        .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > least).orderBy("shingle").collect()
    )
    shingle = np.array([r.shingle for r in rows], np.uint64)
    idf = np.array([0.5 + 0.5 * math.log(total / r.n) / math.log(1 / common) for r in rows])
    return shingle, idf


# --- sketches ----------------------------------------------------------------------


def _gamma_quantiles() -> np.ndarray:
    """65,536 quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return ((low + high) / 2).astype(np.float32)


_TABLES: list[np.ndarray] = []


def _sketch(key: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """ICWS samples (rows with shingles, ``HASHES``), and which rows these are.

    The random draws r, c (Gamma) and beta (uniform) of a shingle and sample come from 16 bits each
    of one hash. A sample is named by 32 bits of that hash and the quantised weight t.
    """
    if not _TABLES:
        r = _gamma_quantiles()
        _TABLES.extend([r, np.log(r)])
    gamma, log_gamma = _TABLES
    doc = (key >> _KEY_BITS).astype(np.int64)
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    element = arrays.mix(key & _KEY_MASK)
    log_weight = np.log(weight).astype(np.float32)
    heavy = np.flatnonzero(log_weight)
    out = np.zeros((len(start), HASHES), np.uint32)
    for k in range(HASHES) if len(start) else ():
        x = element ^ arrays.mix(np.array([k + 1], np.uint64))[0]
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(28)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        r = gamma[x >> np.uint64(48)]
        c = log_gamma[(x >> np.uint64(32)) & np.uint64(0xFFFF)]
        beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        name = x & np.uint64(0xFFFFFFFF)
        a = c - r * (1 - beta)  # ln c - r (t - beta + 1) with t = 0
        if len(heavy):
            t = np.floor(log_weight[heavy] / r[heavy] + beta[heavy])
            a[heavy] -= r[heavy] * t
            name[heavy] ^= (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        bits = a.view(np.int32)
        order = (bits ^ ((bits >> 31) | np.int32(-(2**31)))).view(np.uint32)  # sorts like the floats
        out[:, k] = np.minimum.reduceat((order.astype(np.uint64) << np.uint64(32)) | name, start) & np.uint64(0xFFFFFFFF)
    return out, doc[start]


def _sketches(size: int, common: np.ndarray, idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, tf = _counts(batch.column(0), size)
            found, rows = _sketch(key, _weights(key, tf, common, idf), batch.num_rows)
            made: list[bytes | None] = [None] * batch.num_rows
            for row, sketch in zip(rows.tolist(), found, strict=True):
                made[row] = sketch.tobytes()
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(made, pa.binary())], ["digest", "doc_id", "sketch"])

    return run


# --- exact similarity ----------------------------------------------------------------


def _similarities(size: int, common: np.ndarray, idf: np.ndarray):
    """Exact weighted Jaccard similarity of two texts per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            sides = []
            for side in (0, 1):
                key, tf = _counts(batch.column(side), size)
                sides.append((key, _weights(key, tf, common, idf)))
            (ka, wa), (kb, wb) = sides
            both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            row = lambda key: (key >> _KEY_BITS).astype(np.int64)
            least = np.bincount(row(both), np.minimum(wa[ia], wb[ib]), minlength=n)
            total = np.bincount(row(ka), wa, minlength=n) + np.bincount(row(kb), wb, minlength=n)
            union = total - least
            same = np.divide(least, union, out=np.zeros(n), where=union > 0)
            yield pa.record_batch([batch.column(2), batch.column(3), pa.array(same)], ["a", "b", "similarity"])

    return run


# --- classes ------------------------------------------------------------------------


def text_digest(text: Column) -> Column:
    """Equal texts have equal digests; null is empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def text_classes(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``digest, class_digest, class_id`` of every distinct text of ``docs``.

    ``class_digest`` and ``class_id`` are the text and the id of the row that stands for the class: the
    one with the least id (nulls last), then the least digest.
    """
    ship_functions(docs.sparkSession)
    text = column(docs, "text")
    base = docs.select(text.alias("text"), text_digest(text).alias("digest"), column(docs, "doc_id").cast("long").alias("doc_id"))
    common, idf = frequent_shingles(base.select("text"), size)
    sketched = base.mapInArrow(_sketches(size, common, idf), "digest string, doc_id long, sketch binary")
    units = settle(
        sketched.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("sketch").alias("sketch"))
        .withColumn("unit", F.monotonically_increasing_id()),  # fixed by the write
        "units",
    )
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", 4 * BAND_HASHES * b + 1, 4 * BAND_HASHES)) for b in range(BANDS)])
    banded = units.where("sketch IS NOT NULL").select("unit", F.explode(keys).alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n >= 2")
    shared = settle(banded.join(crowded, "bucket"), "shared-bands")
    central = shared.groupBy("unit").agg(F.sum("n").alias("central"))
    texts = settle(
        base.join(units.join(central, "unit").select("digest", F.col("doc_id").alias("own"), "unit"), "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("own"))).select("unit", "text").dropDuplicates(["unit"]),
        "candidate-texts",
    )

    def compared(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(texts.select(F.col("unit").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("unit").alias("b"), F.col("text").alias("text_b")), "b"
        )
        return joined.select("text_a", "text_b", "a", "b").mapInArrow(
            _similarities(size, common, idf), "a long, b long, similarity double"
        )

    members = shared.join(central, "unit").select("bucket", "unit", "central")
    leaders = members.groupBy("bucket").agg(F.max(F.struct("central", "unit")).alias("lead")).select("bucket", F.col("lead.unit").alias("leader"))
    led = members.join(leaders, "bucket").where("unit <> leader").select(
        "bucket", "unit", F.least("unit", "leader").alias("a"), F.greatest("unit", "leader").alias("b")
    )
    compared_once = settle(compared(led.select("a", "b").distinct()), "compared")
    found = joined_components(None, compared_once.where(F.col("similarity") >= threshold))
    placed = led.join(compared_once, ["a", "b"]).select("bucket", "unit", (1 - F.col("similarity")).alias("distance"))
    undecided = settle(_mixed(_with_component(placed, found)), "undecided")
    if not undecided.isEmpty():
        chosen = texts.join(undecided.select("unit").distinct(), "unit").select("text", "unit")
        weights = _own_weights(chosen, size, common, idf)
        rest = settle(_alive(undecided.join(weights, "unit"), threshold), "rest")
        found = joined_components(found, _links_in_tiles(rest, texts, size, threshold, common, idf))

    classed = _with_component(units, found).select("digest", "doc_id", "component")
    heads = classed.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("head")
    )
    return classed.join(heads, "component").select(
        "digest", F.col("head.digest").alias("class_digest"), F.col("head.doc_id").alias("class_id")
    )


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Add the component of each unit; a unit without links is one of its own."""
    return rows.join(found.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    kept = members.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    return members.join(kept.select("bucket"), "bucket")


def _shingle_rows(size: int, common: np.ndarray, idf: np.ndarray, total: bool):
    """Shingles of each unit with their weight, or the unit's total weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, tf = _counts(batch.column(0), size)
            weight, row = _weights(key, tf, common, idf), (key >> _KEY_BITS).astype(np.int64)
            if total:
                yield pa.record_batch([batch.column(1), pa.array(np.bincount(row, weight, batch.num_rows))], ["unit", "weight"])
            else:
                unit = batch.column(1).to_numpy(zero_copy_only=False)[row]
                yield pa.record_batch([pa.array((key & _KEY_MASK).view(np.int64)), pa.array(unit), pa.array(weight)], ["shingle", "unit", "w"])

    return run


def _own_weights(texts: DataFrame, size: int, common: np.ndarray, idf: np.ndarray) -> DataFrame:
    """``unit, weight, own``: total weight, and that of the shingles which no other of these texts has."""
    shingles = texts.mapInArrow(_shingle_rows(size, common, idf, False), "shingle long, unit long, w double")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("unit").alias("unit"), F.min("w").alias("w")).where("n = 1")
    own = alone.groupBy("unit").agg(F.sum("w").alias("own"))
    whole = texts.mapInArrow(_shingle_rows(size, common, idf, True), "unit long, weight double")
    return whole.join(own, "unit", "left").select("unit", "weight", F.coalesce("own", F.lit(0.0)).alias("own"))


def _alive(rest: DataFrame, threshold: float) -> DataFrame:
    """Members that can reach the threshold with some member of another component of their bucket.

    Two texts have at least both own weights in their union and not in common, so their own weights add up to
    at most ``(1 - threshold) / threshold`` of what they share, and neither shares more than its other weight.
    """
    least = rest.groupBy("bucket").agg(F.min("own").alias("least_own"))
    ratio = (1 - threshold) / threshold + 1e-9
    can = rest.join(least, "bucket").where(F.col("own") + F.col("least_own") <= ratio * (F.col("weight") - F.col("own")))
    return _mixed(can.drop("least_own"))


def _links_in_tiles(rest: DataFrame, texts: DataFrame, size: int, threshold: float, common: np.ndarray, idf: np.ndarray) -> DataFrame:
    """All links ``a, b`` between members of one bucket and two components.

    A bucket's members are dealt to blocks of about ``_BLOCK``, and every two blocks meet in a task of their own, so a
    large bucket is many tasks of bounded size, and only links leave them.
    """
    counts = rest.groupBy("bucket").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(counts, "bucket").select(
        "bucket", "unit", "component", "blocks", F.pmod(F.xxhash64("unit", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    )
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    tiles = dealt.select("bucket", "unit", "component", "block", F.explode(meets).alias("t")).select(
        F.xxhash64("bucket", "t.i", "t.j").alias("tile"), "unit", "component", (F.col("block") == F.col("t.i")).alias("first")
    )
    rows = tiles.join(texts, "unit").select("tile", "unit", "component", "first", "text")
    return rows.groupBy("tile").applyInArrow(_tile_links(size, threshold, common, idf), "a long, b long")


def _tile_links(size: int, threshold: float, common: np.ndarray, idf: np.ndarray):
    """Links between the first and the second block of a tile, or within its only block."""

    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy()
        unit, component = table.column("unit").to_numpy(), table.column("component").to_numpy()
        whole = first.all()
        left = np.flatnonzero(first)
        right = left if whole else np.flatnonzero(~first)
        text = table.column("text").combine_chunks()
        one = _token_table(text.take(pa.array(left)), size, common, idf)
        two = one if whole else _token_table(text.take(pa.array(right)), size, common, idf)
        shared = np.zeros((len(left), len(right)), np.float64)
        tokens = np.intersect1d(one[1], two[1])
        for begin in range(0, len(tokens), _COLUMNS):
            some = tokens[begin : begin + _COLUMNS]
            sides = []
            for (row, token, weight), n, weighted in ((one, len(left), True), (two, len(right), False)):
                place = np.minimum(np.searchsorted(some, token), len(some) - 1)
                hit = some[place] == token
                dense = np.zeros((n, len(some)), np.float32)
                dense[row[hit], place[hit]] = weight[hit] if weighted else 1
                sides.append(dense)
            shared += sides[0] @ sides[1].T
        total = lambda t, n: np.bincount(t[0], t[2], n)
        union = total(one, len(left))[:, None] + total(two, len(right))[None, :] - shared
        similar = (shared >= (threshold - 1e-6) * union) & (union > 0) & (component[left][:, None] != component[right][None, :])
        i, j = np.nonzero(similar)
        return pa.table({"a": pa.array(unit[left][i]), "b": pa.array(unit[right][j])})

    return run


def _token_table(texts: pa.Array, size: int, common: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and weight; a shingle that a text has k times is k tokens, so shared tokens make up the lesser count."""
    key, tf = _counts(texts, size)
    weight = _weights(key, np.ones(len(key), np.int64), common, idf)
    at = np.repeat(np.arange(len(key)), tf)
    number = np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf)
    token = (key[at] & _KEY_MASK) ^ (arrays.mix(number.astype(np.uint64)) * (number > 0).astype(np.uint64))
    return (key[at] >> _KEY_BITS).astype(np.int64), token, weight[at]


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id`` of every row of ``docs``."""
    classes = text_classes(docs, size, threshold).select("digest", "class_id")
    ids = docs.select(column(docs, "doc_id").alias("doc_id"), text_digest(column(docs, "text")).alias("digest"))
    return ids.join(classes, "digest").select("doc_id", "class_id")


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id, then the least digest of its text.

    Of rows equal in both one stays.
    """
    digest, own = "__near_dup_digest", "__near_dup_id"
    heads = text_classes(docs, size, threshold).select(
        F.col("class_digest").alias(digest), F.col("class_id").cast("long").alias(own)
    ).distinct()
    marked = docs.withColumn(digest, text_digest(column(docs, "text"))).withColumn(own, column(docs, "doc_id").cast("long"))
    # A null id cannot be joined on; 0 stands for it beside a flag.
    parts = lambda df: df.withColumns({own + "_": F.coalesce(own, F.lit(0)), own + "_none": F.col(own).isNull()}).drop(own)
    keys = [digest, own + "_", own + "_none"]
    return parts(marked).join(parts(heads), keys, "left_semi").dropDuplicates(keys).drop(*keys)
