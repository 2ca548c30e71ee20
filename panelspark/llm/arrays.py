"""Words, n-grams and their hashes over a whole Arrow array of texts at once.

All functions work on one flat byte buffer. A word is a run of bytes other than
space and 0x09-0x0D; these bytes are never part of a longer UTF-8 character.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

# Odd multipliers of the rolling polynomials, with their inverses modulo 2**64.
_BYTE_BASE = 0x9E3779B97F4A7C15
_GRAM_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least ``n`` of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), np.uint64(base))
        known[0] = 1
        known = np.multiply.accumulate(known)
        _POWERS[base] = known
    return known[:n]


def _rolling(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[begin:end]`` for each pair, independent of its place."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=total[1:])
    return (total[end] - total[begin]) * _powers(pow(base, -1, 2**64), n + 1)[begin]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins and ends; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = at[:-1], at[1:]
    first = int(at[0]) if len(at) else 0
    last = int(at[-1]) if len(at) else 0
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[first:last] if body is not None else np.zeros(0, np.uint8)
    return data, begin - first, end - first


class Words(NamedTuple):
    """Words of a flat buffer: the row of each, and its bytes."""

    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, is_word: np.ndarray = _IS_WORD) -> Words:
    """All words, in order. Words do not run over the end of a text."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    full = end > begin
    edges, stops = begin[full], end[full]
    opens[edges] = inside[1:-1][edges]
    closes[stops - 1] = inside[1:-1][stops - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    rows = np.flatnonzero(full)
    doc = rows[np.searchsorted(edges, first, side="right") - 1] if len(rows) else np.zeros(0, np.int64)
    return Words(doc, first, last)


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return mix(_rolling(data.astype(np.uint64) + np.uint64(1), found.begin, found.end, _BYTE_BASE))


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words ``begin:end``, as signed longs."""
    return tuple(mix(_rolling(hashes, begin, end, base)).view(np.int64) for base in _GRAM_BASES)


def grams(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, mix(_rolling(hashes, at, at + size, _GRAM_BASES[0]))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word shingle; a text of 1 to ``size - 1`` words is one shingle."""
    data, begin, end = flat(texts)
    found = words(data, begin, end)
    hashes = word_hashes(data, found)
    at, h = grams(hashes, found.doc, size)
    doc = found.doc[at]
    count = np.bincount(found.doc, minlength=len(begin))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        whole = mix(_rolling(hashes, first[short], first[short] + count[short], _GRAM_BASES[0]))
        whole = mix(whole + count[short].astype(np.uint64))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h
