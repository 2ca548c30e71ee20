"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of a benchmark item, or the whole of a shorter item. Its set of shingles is that of its
runs of ``SHINGLE_WORDS`` words (of all its words, if it has fewer). A document that holds the window holds all of them, so any
one shingle is a necessary prefix; the rarest makes the fewest candidates.

1. Order by rarity: count the item shingles over all documents. A window with a shingle that never occurs is done.
2. Join on the prefix: find the places of each window's rarest shingle, and join them with the windows it stands for.
   Neighbouring windows mostly share it.
3. Bounds: the window must begin and end inside the document, with the shingle at its own offset.
4. Verify: compare the window's words with those around the place.

Documents are read twice and never shuffled. A bitmap of fixed size keeps shingles that no item has out of the join; it may let
others pass, so a large benchmark costs time and no result. Only places found are stored, each with the words around it.

Defined results: null and empty texts have no words and no hit; items without words match nothing; items with one ``item_id`` are
one item, and items without an id hit words and are not counted; repeated rows and ids of documents are rows of their own; other
columns are ignored; without items, or with an empty documents table, there are no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm.tasks import column, ship_functions, slices
from panelspark.session import settle

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
# Bits of a shingle's hash that choose its place in the bitmap: 2 MB whatever the number of items.
_BITS = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _read(texts: pa.Array) -> tuple[np.ndarray, arrays.Words, np.ndarray, int]:
    """Lower-case bytes, words, their hashes, and the number of texts."""
    data, begin, end = arrays.flat(texts)
    data = _LOWER[data]
    found = arrays.words(data, begin, end, _IS_WORD)
    return data, found, arrays.word_hashes(data, found), len(begin)


def _shingles(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of all runs of ``size`` words."""
    at, h = arrays.grams(hashes, doc, size)
    return at, arrays.mix(h + np.uint64(size)).view(np.int64)


def _spell(data: np.ndarray, found: arrays.Words, first: int, last: int) -> list[str]:
    """Words ``first:last`` as texts."""
    return [data[b:e].tobytes().decode() for b, e in zip(found.begin[first:last].tolist(), found.end[first:last].tolist())]


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, found, hashes, n = _read(batch.column(0))
            count = np.bincount(found.doc, minlength=n).tolist()
            first = (np.cumsum(count) - count).tolist()
            keys = batch.column(1).to_pylist()
            ids, words, tokens = [], [], []
            for row in range(n):
                spelled = _spell(data, found, first[row], first[row] + count[row])
                size = min(count[row], SHINGLE_WORDS)
                own = slice(first[row], first[row] + count[row])
                shingles = _shingles(hashes[own], found.doc[own], size)[1].tolist() if size else []
                for k in range(max(count[row] - window, 0) + 1 if size else 0):
                    ids.append(keys[row])
                    words.append(spelled[k : k + window])
                    tokens.append(shingles[k : k + min(window, count[row]) - size + 1])
            yield pa.record_batch(
                [pa.array(ids, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(tokens, pa.list_(pa.int64()))],
                ["item_id", "words", "tokens"],
            )

    return run


def item_windows(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``item_id, words, tokens``: the windows of each item, and the hashes of their shingles in order."""
    if window < SHINGLE_WORDS:
        raise ValueError(f"window must have {SHINGLE_WORDS} words or more")
    ship_functions(items.sparkSession)
    scan = items.select(column(items, "text").alias("text"), column(items, "item_id").cast("string").alias("item_id"))
    return scan.mapInArrow(_item_windows(window), "item_id string, words array<string>, tokens array<long>")


def _bitmap(tokens: DataFrame) -> bytes:
    """Bits of all hashes in ``token``; has a fixed size, so it may be collected and sent to every task."""
    cell = F.col("token").bitwiseAND((1 << _BITS) - 1)
    rows = (
        tokens.select(F.shiftright(cell, 6).alias("word"), F.expr("shiftleft(1L, CAST(token & 63 AS INT))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits.tobytes()


class _Filter:
    """The bitmap in a task, unpacked at its first use."""

    def __init__(self, packed: bytes):
        self.packed = packed
        self.bits: np.ndarray | None = None

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self.bits = np.unpackbits(np.frombuffer(self.packed, np.uint8), bitorder="little").view(bool)
        return self.bits[tokens & ((1 << _BITS) - 1)]


def _count(passes: _Filter, sizes: list[int]):
    """Shingles that pass the bitmap, counted within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, found, hashes, _ = _read(batch.column(0))
            tokens = [h[passes(h)] for h in (_shingles(hashes, found.doc, size)[1] for size in sizes)]
            token, n = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([pa.array(token), pa.array(n)], ["token", "n"])

    return run


_PLACES = "array<struct<token:bigint,place:int,begin:int,around:array<string>>>"


def _find(passes: _Filter, sizes: list[int], window: int):
    """Each document with its number of words and the places of the shingles that pass, with the words around them."""
    kind = pa.struct([("token", pa.int64()), ("place", pa.int32()), ("begin", pa.int32()), ("around", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, found, hashes, n = _read(batch.column(0))
            count = np.bincount(found.doc, minlength=n)
            first = np.cumsum(count) - count
            places: list[list[dict]] = [[] for _ in range(n)]
            for size in sizes:
                at, h = _shingles(hashes, found.doc, size)
                hit = np.flatnonzero(passes(h))
                reach = (window if size == SHINGLE_WORDS else size) - size
                doc = found.doc[at[hit]]
                low = np.maximum(at[hit] - reach, first[doc])
                high = np.minimum(at[hit] + size + reach, first[doc] + count[doc])
                rows = zip(doc.tolist(), h[hit].tolist(), (at[hit] - first[doc]).tolist(), (low - first[doc]).tolist(), low.tolist(), high.tolist())
                for row, token, place, begin, a, b in rows:
                    places[row].append({"token": token, "place": place, "begin": begin, "around": _spell(data, found, a, b)})
            yield pa.record_batch(
                [batch.column(1), pa.array(count.astype(np.int64)), pa.array(places, pa.list_(kind))], ["doc_id", "n_words", "places"]
            )

    return run


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``docs`` as ``row, doc_id, n_words``, the occurrences ``row, begin, size, window`` in them, and ``window, item_id``.

    ``begin`` counts words from 0; ``row`` is unique.
    """
    spark = docs.sparkSession
    ship_functions(spark)
    listed = settle(item_windows(items, window), "item-windows")
    # A window that many items share is one row here.
    windows = settle(
        listed.groupBy("words").agg(F.first("tokens").alias("tokens")).withColumn("window", F.monotonically_increasing_id()),
        "windows",
    )
    owners = listed.where("item_id IS NOT NULL").select("words", "item_id").distinct().join(windows, "words").select("window", "item_id")
    sizes = [r.size for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE_WORDS)).alias("size")).distinct().collect()]

    shingles = windows.select("window", F.posexplode("tokens").alias("offset", "token"))
    scan = docs.select(column(docs, "text").alias("text"), column(docs, "doc_id").cast("long").alias("doc_id"))
    counts = (
        scan.select("text").mapInArrow(_count(_Filter(_bitmap(shingles)), sizes), "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n"))
    )
    rarest = (
        shingles.join(counts, "token", "left")
        .groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
        .where("rarest.n > 0").select("window", "rarest.token", "rarest.offset")
    )
    prefixes = settle(rarest.join(windows.select("window", "words"), "window"), "prefixes")

    places = settle(
        scan.mapInArrow(_find(_Filter(_bitmap(prefixes.select("token"))), sizes, window), f"doc_id long, n_words long, places {_PLACES}")
        .withColumn("row", F.monotonically_increasing_id()),
        "places",
    )
    begin, size = F.col("place") - F.col("offset"), F.size("words")
    met = (
        places.select("row", "n_words", F.inline("places")).join(prefixes, "token")
        .where((begin >= 0) & (begin + size <= F.col("n_words")))
        .where(F.slice("around", begin - F.col("begin") + 1, size) == F.col("words"))
        .select("row", begin.alias("begin"), size.alias("size"), "window")
    )
    return places.select("row", "doc_id", "n_words"), met, owners


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, spans`` of every row of ``docs``.

    ``spans`` has the stretches of words that windows cover as ``(begin, end)``, the end not included; ``item_ids`` are sorted texts.
    """
    rows, met, owners = find_windows(docs, items, window)
    met = settle(met, "occurrences")
    # Occurrences that touch are one span.
    inside = Window.partitionBy("row").orderBy("begin", "end")
    reached = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        met.select("row", "begin", (F.col("begin") + F.col("size")).alias("end")).distinct()
        .withColumn("opens", F.coalesce(F.col("begin") > reached, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("opens").over(inside))
        .groupBy("row", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    )
    # Copies of a document hold the same windows; their items are looked up once.
    held = met.groupBy("row").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    sets = held.select("windows").distinct().select("windows", F.explode("windows").alias("window"))
    named = sets.join(owners, "window").groupBy("windows").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    found = spans.join(held, "row").join(named, "windows", "left").select("row", "spans", "item_ids")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words",
        F.expr("coalesce(aggregate(spans, 0L, (n, s) -> n + s.end - s.begin), 0L)").alias("n_hit"),
        F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids"),
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<begin:int,end:int>>)")).alias("spans"),
    )
