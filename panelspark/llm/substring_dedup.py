"""Substring dedup: seed and extend on winnowed anchors.

A window is ``window`` consecutive words. Its anchor is the least of its ``ANCHOR_WORDS``-grams, so two
equal windows have the same anchor wherever they stand (winnowing). Consecutive windows with one anchor
are a run: the anchor extended both ways as far as it stays the anchor.

1. Seed: count the anchors of all documents; only those that occur twice or more can lie in a repeat.
2. Extend whole runs: join the shared anchors back to their documents and count their runs. A run
   that occurs again is repeated in full. If all occurrences of an anchor have the same run, it is settled.
3. Extend word by word: for the other anchors (the ends of a repeat, or an edited place) count the single
   windows of the runs that occur once, and of one specimen of each other run.
4. Windows and runs that occur twice or more, put together, are the maximal repeats; their words are removed.

No pair of documents is formed: a passage in a third of all documents costs its own rows only,
counted within tasks first. A 96-bit or 128-bit hash stands for the words of a window or run.

Defined results: null and empty texts have no words and lose none; repeated rows (same or no
``doc_id``) are documents of their own, so their long passages are repeats of each other; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm.tasks import column, ship_functions, slices

WINDOW_WORDS = 35
ANCHOR_WORDS = 8


class Windows(NamedTuple):
    """Windows of some texts, by first word, and the word where the anchor of each begins."""

    words: arrays.Words
    hashes: np.ndarray
    first: np.ndarray
    anchor: np.ndarray
    grams: np.ndarray
    size: int

    def hashed(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the given windows in two parts, 64 and 32 bits."""
        a, b = arrays.span_hashes(self.hashes, self.first[which], self.first[which] + self.size)
        return a, (b.view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Runs(NamedTuple):
    """Runs of windows with one anchor: text, anchor's hash, hash in two parts, first and last window."""

    row: np.ndarray
    seed: np.ndarray
    r1: np.ndarray
    r2: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def some(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in self))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The run, and the number, of every window in these runs."""
        length = self.end - self.begin
        run = np.repeat(np.arange(len(length)), length)
        return run, np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + self.begin[run]


def _windows(texts: pa.Array, size: int) -> Windows:
    data, begin, end = arrays.flat(texts)
    found = arrays.words(data, begin, end)
    hashes = arrays.word_hashes(data, found)
    width = min(ANCHOR_WORDS, size)
    n = len(hashes) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Windows(found, hashes, none, none, np.zeros(0, np.uint64), size)
    at = np.arange(len(hashes) - width + 1)
    grams = arrays.span_hashes(hashes, at, at + width)[0].view(np.uint64)
    bits = np.uint64(max(24, len(grams).bit_length()))
    least = (grams >> bits << bits) | at.astype(np.uint64)  # by hash, then place
    span, done = size - width + 1, 1
    while done * 2 <= span:  # least of 2, 4, 8 ... grams
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if span > done:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    first = np.flatnonzero(found.doc[:n] == found.doc[size - 1 :])
    anchor = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return Windows(found, hashes, first, anchor, grams, size)


def _runs(w: Windows) -> Runs:
    row = w.words.doc[w.first]
    begin = np.flatnonzero((np.diff(w.anchor, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    end = np.append(begin[1:], len(w.first)) if len(begin) else begin
    opens, closes = w.first[begin], w.first[end - 1] + w.size if len(begin) else begin
    a, b = arrays.span_hashes(w.hashes, opens, closes)
    place = w.anchor[begin]
    shape = arrays.mix(((place - opens) << 32 | (closes - opens)).astype(np.uint64)).view(np.int64)
    return Runs(row[begin], w.grams[place].view(np.int64), a ^ shape, b ^ shape, begin, end)


def _tag(seed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for a seed in a row."""
    return arrays.mix(seed.view(np.uint64) ^ arrays.mix(row.astype(np.uint64)))


def _seeds(size: int, with_key: bool):
    """Anchors with the key of their row, or counted within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _runs(_windows(batch.column(0), size))
            if with_key:
                found = found.some(np.unique(_tag(found.seed, found.row), return_index=True)[1])
                key = batch.column(1).to_numpy(zero_copy_only=False)[found.row]
                yield pa.record_batch([pa.array(found.seed), pa.array(key)], ["seed", "row_key"])
            else:
                seed, n = np.unique(found.seed, return_counts=True)
                yield pa.record_batch([pa.array(seed), pa.array(n)], ["seed", "n"])

    return run


def _lists(values: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each list element, and the elements."""
    sizes = np.asarray(values.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(sizes)), sizes), values.flatten()


def _known(a: np.ndarray, b: np.ndarray, found_a: np.ndarray, found_b: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a, b`` are among the found ones, as its place there, else -1."""
    order = np.lexsort((found_b, found_a))
    sorted_a, sorted_b = found_a[order], found_b[order]
    place, out = np.searchsorted(sorted_a, a), np.full(len(a), -1)
    left = np.flatnonzero(place < len(order))
    while len(left):
        left = left[sorted_a[place[left]] == a[left]]
        same = sorted_b[place[left]] == b[left]
        out[left[same]] = order[place[left[same]]]
        left = left[~same]
        place[left] += 1
        left = left[place[left] < len(order)]
    return out


def _run_rows(size: int):
    """Runs of shared anchors: anchor, hash, key of the row and occurrences in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _runs(_windows(batch.column(0), size))
            owner, seeds = _lists(batch.column(2))
            wanted = np.isin(_tag(found.seed, found.row), _tag(seeds.to_numpy(zero_copy_only=False), owner))
            found = found.some(wanted)
            key = batch.column(1).to_numpy(zero_copy_only=False)[found.row]
            order = np.lexsort((found.r2, found.r1, key))
            new = np.ones(len(order), bool)
            for values in (found.r1, found.r2, key):
                values = values[order]
                new[1:] &= values[1:] == values[:-1]
            new[1:] = ~new[1:]
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(order))).astype(np.int64)
            at = order[start]
            yield pa.record_batch(
                [pa.array(found.seed[at]), pa.array(found.r1[at]), pa.array(found.r2[at]), pa.array(key[at]), pa.array(n)],
                ["seed", "r1", "r2", "row_key", "n"],
            )

    return run


def _open_windows(size: int, with_key: bool):
    """Windows of the runs listed with each row: counted, or of runs that occur once with the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = _windows(batch.column(0), size)
            found = _runs(w)
            _, listed = _lists(batch.column(2))
            field = lambda name: listed.field(name).to_numpy(zero_copy_only=False)
            place = _known(found.r1, found.r2, field("r1"), field("r2"))
            weight = field("weight")
            hit = np.flatnonzero((place >= 0) & (weight[place] == 1) if with_key else place >= 0) if len(weight) else np.zeros(0, np.int64)
            # A run that occurs once stands in its own row only; a specimen may meet its like in the slice.
            some = found.some(hit)
            which, number = some.windows()
            a, b = w.hashed(number)
            if with_key:
                tail = batch.column(1).to_numpy(zero_copy_only=False)[some.row[which]]
            else:
                tail = weight[place[hit]][which]
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(tail)], ["w1", "w2", "row_key" if with_key else "n"])

    return run


def _covered(texts: pa.Array, size: int, runs: pa.ListArray, windows: pa.ListArray) -> tuple[Windows, np.ndarray]:
    """Windows of some texts and which of them are repeated; a repeat is one in whatever row it stands."""
    w = _windows(texts, size)
    found = _runs(w)
    repeated = np.zeros(len(w.first), bool)
    known = _lists(runs)[1]
    full = _known(found.r1, found.r2, known.field("r1").to_numpy(zero_copy_only=False), known.field("r2").to_numpy(zero_copy_only=False)) >= 0
    repeated[found.some(full).windows()[1]] = True
    known = _lists(windows)[1]
    if len(known):
        rest = found.some(~full).windows()[1]
        a, b = w.hashed(rest)
        repeated[rest] = _known(a, b, known.field("w1").to_numpy(zero_copy_only=False), known.field("w2").to_numpy(zero_copy_only=False)) >= 0
    return w, repeated


def _removed(size: int):
    """Per text: words, removed words, kept words' hash, and its maximal repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            touched = np.flatnonzero(
                np.asarray(batch.column(2).value_lengths().fill_null(0)) + np.asarray(batch.column(3).value_lengths().fill_null(0))
            )
            cover: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            if len(touched):
                some = batch.take(pa.array(touched))
                w, repeated = _covered(some.column(0), size, some.column(2), some.column(3))
                n, doc = len(w.hashes), w.words.doc
                change = np.bincount(w.first[repeated], minlength=n + 1) - np.bincount(w.first[repeated] + size, minlength=n + 1)
                gone = np.cumsum(change)[:n] > 0
                apart = np.flatnonzero(np.diff(doc)) + 1
                inner = apart[gone[apart] & gone[apart - 1]]  # a repeat ends with its text
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                opens = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
                closes = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
                bounds = np.searchsorted(doc, np.arange(len(touched) + 1))
                marks = np.searchsorted(opens, bounds)
                for k, row in enumerate(touched.tolist()):
                    own = slice(marks[k], marks[k + 1])
                    cover[row] = (gone[bounds[k] : bounds[k + 1]], opens[own] - bounds[k], closes[own] - bounds[k])
            n_words, n_removed, digest, begins, ends = [], [], [], [], []
            for row, text in enumerate(batch.column(0).cast(pa.large_binary()).to_pylist()):
                parts = kept = (text or b"").split()  # at the bytes that end a word here too
                begin = end = ()
                if row in cover:
                    gone, begin, end = cover[row]
                    kept = [parts[i] for i in np.flatnonzero(~gone)]
                n_words.append(len(parts))
                n_removed.append(len(parts) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                begins.append(list(begin))
                ends.append(list(end))
            places = pa.list_(pa.int32())
            yield pa.record_batch(
                [batch.column(4), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(begins, places), pa.array(ends, places)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "repeat_begin", "repeat_end"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, repeat_begin, repeat_end`` of every row of ``docs``.

    The last two list the maximal repeats by word, begin included and end not.
    """
    ship_functions(docs.sparkSession)
    # Whether a seed, run or window repeats holds for all rows, so rows that share a key would only see longer lists. Rows
    # without an id, or with a repeated one, differ by their text; equal rows have the same lists anyway.
    base = docs.select(
        column(docs, "text").alias("text"),
        F.xxhash64(column(docs, "doc_id"), column(docs, "text")).alias("row_key"),
        column(docs, "doc_id").cast("long").alias("doc_id"),
    )
    scan = base.select("text", "row_key")
    shared = (
        scan.mapInArrow(_seeds(window, False), "seed long, n long")
        .groupBy("seed").agg(F.sum("n").alias("n")).where("n >= 2").select("seed")
    )
    seeds = (
        scan.mapInArrow(_seeds(window, True), "seed long, row_key long").join(shared, "seed")
        .groupBy("row_key").agg(F.collect_set("seed").alias("seeds"))
    )
    # Dealt once: all four joins use the same exchange, as they ask for the same columns of it (and of the runs).
    texts = base.repartition("row_key")

    def with_lists(lists: DataFrame, how: str = "inner") -> DataFrame:
        return texts.join(lists.hint("shuffle_hash"), "row_key", how)

    found = (
        with_lists(seeds).select("text", "row_key", "seeds", "doc_id")
        .mapInArrow(_run_rows(window), "seed long, r1 long, r2 long, row_key long, n long")
    )
    kinds = found.groupBy("seed", "r1", "r2").agg(F.sum("n").alias("total"), F.min("row_key").alias("specimen"))
    mixed = kinds.groupBy("seed").agg(F.count("*").alias("kinds"))
    kinds = kinds.join(mixed, "seed").select(
        "r1", "r2", F.least("total", F.lit(2)).alias("weight"), "specimen", (F.col("kinds") > 1).alias("mixed")
    ).where("weight = 2 OR mixed")
    runs = (
        found.select("r1", "r2", "row_key").join(kinds, ["r1", "r2"])
        .groupBy("row_key")
        .agg(
            F.collect_set(F.when(F.col("weight") == 2, F.struct("r1", "r2"))).alias("full"),
            F.collect_set(
                F.when(F.col("mixed") & ((F.col("weight") == 1) | (F.col("specimen") == F.col("row_key"))), F.struct("r1", "r2", "weight"))
            ).alias("open"),
        )
    )
    opened = with_lists(runs.where(F.size("open") > 0)).select("text", "row_key", "open", "full", "doc_id")
    repeated = (
        opened.mapInArrow(_open_windows(window, False), "w1 long, w2 int, n long")
        .groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n >= 2").select("w1", "w2")
    )
    windows = (
        opened.mapInArrow(_open_windows(window, True), "w1 long, w2 int, row_key long").join(repeated, ["w1", "w2"])
        .groupBy("row_key").agg(F.collect_set(F.struct("w1", "w2")).alias("windows"))
    )
    lists = runs.join(windows, "row_key", "left")
    none = {"full": "array<struct<r1:bigint,r2:bigint>>", "windows": "array<struct<w1:bigint,w2:int>>"}
    lists_or_none = [F.coalesce(k, F.expr(f"CAST(array() AS {v})")).alias(k) for k, v in none.items()]
    return (
        with_lists(lists, "left").select("text", "row_key", *lists_or_none, "doc_id", "open")
        .mapInArrow(
            _removed(window),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, "
            "repeat_begin array<int>, repeat_end array<int>",
        )
    )
