"""Periodic runs: stretches of words that repeat with one period, by block convolution.

A run is a stretch with least period ``q`` and ``LEAST_POWER`` periods or more (and ``LEAST_WORDS`` words) that cannot grow either way.
At every dyadic scale ``B`` the words fall into blocks of ``B``. The squared differences between a block
and the words ``B`` to ``2B - 1`` behind it are a convolution, done for all blocks at once by a number-theoretic transform in exact
integers modulo a prime. A sum of zero is an occurrence of the block, at a distance that is a candidate period:

* a run of a period in ``[B, 2B)`` has at least two neighbouring blocks inside it, with the same words one period later, so distances
  that are zero for two neighbouring blocks find every run at its scale;
* those inside a known run of a smaller period are multiples of that period and are dropped; of the rest each block has one at most,
  so there are never more seeds than blocks;
* seeds are compared word by word (a zero modulo the prime may be none) and extended both ways.

Before that, words that occur fewer than ``LEAST_POWER`` times in a stretch are taken out of it, as no run can hold them; this is repeated on the
stretches between them. What is left of plain prose is little. Blocks below ``_DIRECT`` words are compared as
they are, which the convolution of so few words amounts to.

All texts of a slice are worked on side by side. Work is ``n log^2 n`` and memory linear in the words of a slice, or of one
long text. Within a slice a word stands for its 64-bit hash.

Defined results: null and empty texts have no words and no run; a null ``doc_id`` plants nothing; repeated rows are judged each on its own;
ties of the longest run go to the smallest start, then period; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm.tasks import column, ship_functions, slices

LEAST_POWER = 4
LEAST_WORDS = 6
# Prime of the transform and a generator of its units; 2**23 divides PRIME - 1, so one transform takes blocks of 2**22 words.
PRIME = 998_244_353
_GENERATOR = 3
_WIDEST = 1 << 22
_DIRECT = 16
# Numbers that one transform holds at once.
_AT_ONCE = 1 << 19
# Times that rare words are taken out; what stays then is searched all the same.
_ROUNDS = 8


def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order ``size``, the first half of them."""
    root = pow(_GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(max(size // 2, 1), np.uint64)
    done, power = 1, root
    while done < len(out):  # 1, r, then times r**2, r**4, ...
        out[done : 2 * done] = out[:done] * np.uint64(power) % np.uint64(PRIME)
        done, power = done * 2, power * power % PRIME
    return out


def transform(values: np.ndarray) -> np.ndarray:
    """Transform of each row (a power of two long); the result is in bit-reversed order."""
    rows, size = values.shape
    p, out = np.uint64(PRIME), values
    width = size
    while width > 1:
        half = width // 2
        pairs = out.reshape(rows, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([(a + b) % p, (a + p - b) * _roots(width, False) % p], axis=2)
        width = half
    return out.reshape(rows, size)


def inverse_transform(values: np.ndarray) -> np.ndarray:
    """Rows from their transform in bit-reversed order."""
    rows, size = values.shape
    p, out = np.uint64(PRIME), values
    width = 2
    while width <= size:
        half = width // 2
        pairs = out.reshape(rows, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * _roots(width, True) % p
        out = np.stack([(a + b) % p, (a + p - b) % p], axis=2)
        width *= 2
    return out.reshape(rows, size) * np.uint64(pow(size, -1, PRIME)) % p


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences modulo ``PRIME`` of each block with its window at offsets ``0 .. B-1``.

    Rows of ``blocks`` have ``B`` numbers below ``PRIME``, those of ``windows`` ``2B``.
    """
    p = np.uint64(PRIME)
    n, size = blocks.shape
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]  # a cyclic correlation, which offsets up to B do not wrap
    product = inverse_transform(transform(turned) * transform(windows) % p)[:, :size]
    own = (blocks * blocks % p).sum(axis=1, dtype=np.uint64)[:, None]
    total = np.zeros((n, 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % p, axis=1, out=total[:, 1:])
    other = total[:, size : 2 * size] - total[:, :size]
    return (own + other + 2 * (p - product)) % p


def _block_mismatches(ids: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Sums of squared differences of blocks with the words ``size`` to ``2 * size - 1`` behind them.

    Blocks wider than a transform are summed over parts, each at all distances.
    """
    part = min(size, _WIDEST)
    out = np.zeros((len(first), size), np.uint64)
    for begin in range(0, size, part):
        blocks = ids[(first + begin)[:, None] + np.arange(part)]
        for offset in range(0, size, part):
            windows = ids[(first + begin + size + offset)[:, None] + np.arange(2 * part)]
            out[:, offset : offset + part] += mismatches(blocks, windows)
    return out % np.uint64(PRIME)


def _zeros(ids: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (by place in ``first``) and distances in ``[size, 2 * size)`` without a mismatch."""
    span = np.arange(size)
    if size < _DIRECT:
        block, distance = [], []
        own = ids[first[:, None] + span]
        for d in range(size, 2 * size):
            hit = np.flatnonzero((own == ids[first[:, None] + (span + d)]).all(axis=1))
            block.append(hit)
            distance.append(np.full(len(hit), d))
        return np.concatenate(block), np.concatenate(distance)
    block, distance = [], []
    rows = max(_AT_ONCE // (2 * size), 1)
    for k in range(0, len(first), rows):
        b, d = np.nonzero(_block_mismatches(ids, first[k : k + rows], size) == 0)
        block.append(b + k)
        distance.append(d + size)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *block]), np.concatenate([none, *distance])


def _live(word: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that a run may hold, and the stretch of each.

    ``part`` numbers the texts. A word stays if its stretch holds it ``LEAST_POWER`` times; stretches end at words that go.
    """
    at = np.arange(len(word))
    for _ in range(_ROUNDS):
        if not len(at):
            break
        key = arrays.mix(word[at] ^ arrays.mix(part.astype(np.uint64)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        stays = count[which] >= LEAST_POWER
        stays &= np.bincount(part)[part] >= LEAST_WORDS
        if stays.all():
            break
        at, part = at[stays], part[stays]
        part = np.cumsum((np.diff(at, prepend=-2) != 1) | (np.diff(part, prepend=-1) != 0)) - 1
    return at, part


def _extend(ids: np.ndarray, edge: np.ndarray, distance: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
    """How many words from ``edge`` on, in steps of 1 or -1, equal those ``distance`` further on; ``limit`` at most."""
    length, open_, size = np.zeros(len(edge), np.int64), np.arange(len(edge)), 8
    while len(open_):
        k = np.arange(size)
        here = edge[open_] + step * length[open_]
        place = here[:, None] + step * k
        inside = k < (limit[open_] - length[open_])[:, None]
        place = np.where(inside, place, 0)
        same = inside & (ids[place] == ids[np.where(inside, place + distance[open_][:, None], 0)])
        full = same.all(axis=1)
        length[open_] += np.where(full, size, same.argmin(axis=1))
        open_ = open_[full]
        size = min(size * 2, max(_AT_ONCE // max(len(open_), 1), 8))
    return length


def runs(ids: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all runs in ``ids`` (numbers below ``PRIME``).

    ``end`` has for each word the end of its stretch; runs do not leave stretches.
    """
    n = len(ids)
    longest = int((end - np.arange(n)).max()) if n else 0
    out = [np.zeros((0, 3), np.int64)]
    reach = np.arange(n)  # end of the known runs that begin at a place or before
    begin_of = np.zeros(n, np.int64)
    if n:
        opens = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        begin_of = np.repeat(opens, np.diff(np.append(opens, n)))
    padded = np.concatenate([ids, np.zeros(1, ids.dtype)])
    size = 1
    while LEAST_POWER * size <= longest:
        first = np.arange(0, n - 2 * size + 1, size)
        # A window's tail may lie beyond the stretch or the words; distances into it are dropped below.
        first = first[first + 2 * size <= end[first]]
        window = np.concatenate([padded, np.zeros(3 * size, ids.dtype)])
        block, distance = _zeros(window, first, size)
        at = first[block]
        # The same distance at the next block.
        key = at * (2 * size) + distance - size
        key.sort()
        at, distance = key // (2 * size), key % (2 * size) + size
        good = np.isin(key + 2 * size * size, key, assume_unique=True)
        at, distance = at[good], distance[good]
        good = at + 2 * size + distance <= end[at]
        at, distance = at[good], distance[good]
        good = reach[at] < at + 2 * size + distance  # not within a run of a smaller period
        at, distance = at[good], distance[good]
        # Neighbouring blocks with one distance are one seed.
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        good = np.append(True, (np.diff(at) != size) | (np.diff(distance) != 0))[: len(at)]
        at, distance = at[good], distance[good]
        if len(at):
            right = _extend(padded, at, distance, 1, end[at] - distance - at)
            left = _extend(padded, at - 1, distance, -1, at - begin_of[at])
            start, stop = at - left, at + right + distance
            period = distance
            good = (right >= 2 * size) & (stop - start >= LEAST_POWER * period) & (stop - start >= LEAST_WORDS)
            found = np.unique(np.stack([start[good], stop[good], period[good]], axis=1), axis=0)
            out.append(found)
            np.maximum.at(reach, found[:, 0], found[:, 1])
            reach = np.maximum.accumulate(reach)
        size *= 2
    found = np.concatenate(out)
    # A stretch is a run of its least period only.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.append(True, (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0))[: len(found)]
    found = found[new]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _residues(word: np.ndarray) -> np.ndarray:
    """A number below ``PRIME`` for each word, one to one within the slice."""
    kinds, which = np.unique(word, return_inverse=True)
    if len(kinds) >= PRIME:
        raise ValueError("too many distinct words in one text")
    # Spread over the residues, so that sums of squares are rarely zero by chance.
    step = np.uint64(48_271)
    return (which.astype(np.uint64) + np.uint64(1)) * step % np.uint64(PRIME)


def find(texts: pa.Array) -> tuple[arrays.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts, and begin, end and period of their runs by word of the whole slice."""
    data, begin, end = arrays.flat(texts)
    found = arrays.words(data, begin, end)
    word = arrays.word_hashes(data, found)
    at, part = _live(word, found.doc)
    if not len(at):
        none = np.zeros(0, np.int64)
        return found, none, none, none
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
    start, stop, period = runs(_residues(word[at]), np.repeat(ends, np.diff(ends, prepend=0)))
    return found, at[start], at[stop - 1] + 1, period


_RESULT = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in slices(batches):
        found, start, stop, period = find(batch.column(0))
        n = len(found.doc)
        rest = np.minimum(start + period, stop)
        change = np.bincount(rest, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
        gone = np.cumsum(change)[:n] > 0
        bounds = np.searchsorted(found.doc, np.arange(batch.num_rows + 1)).tolist()
        marks = np.searchsorted(start, bounds).tolist()
        listed, texts = [], []
        for row, text in enumerate(batch.column(0).cast(pa.large_binary()).to_pylist()):
            a, b = bounds[row], bounds[row + 1]
            own = slice(marks[row], marks[row + 1])
            listed.append([
                {"start": s, "length": k, "period": q}
                for s, k, q in zip((start[own] - a).tolist(), (stop[own] - start[own]).tolist(), period[own].tolist())
            ])
            parts = (text or b"").split()  # at the bytes that end a word here too
            if marks[row] < marks[row + 1]:
                parts = [parts[i] for i in np.flatnonzero(~gone[a:b]).tolist()]
            texts.append(b" ".join(parts))
        yield pa.record_batch(
            [batch.column(1), pa.array([b - a for a, b in zip(bounds, bounds[1:])], pa.int64()), pa.array(listed, pa.list_(kind)), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    ``runs`` are ``(start, length, period)`` by start, then period. ``collapsed`` is the text without the words that a run holds behind its
    first period, its words set apart by single spaces.
    """
    ship_functions(docs.sparkSession)
    scan = docs.select(column(docs, "text").alias("text"), column(docs, "doc_id").cast("long").alias("doc_id"))
    return scan.mapInArrow(_collapse, _RESULT)


def _planted(text: str | None, doc_id: int | None) -> str | None:
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or doc_id is None or not text:
        return text
    words = text.encode().split()
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]).decode()


def plant(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the tail of one document in ten, chosen by a checksum of the id, repeats a stretch of words."""
    ship_functions(docs.sparkSession)

    @F.arrow_udf("string")
    def planted(texts: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array(list(map(_planted, texts.to_pylist(), ids.to_pylist())), pa.string())

    doc_id = column(docs, "doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), planted(column(docs, "text"), doc_id).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("minus_start"), (-r["period"]).alias("minus_period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.minus_start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.minus_period")).alias("period"), F.expr("1000 * top.length DIV -top.minus_period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
