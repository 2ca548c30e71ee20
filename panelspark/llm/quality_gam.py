"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes over the features in turn, again and again: a
shallow tree on one feature's bins is fitted to the gradient of the log loss and added, shrunk, to
that feature's lookup table. The strongest pairs of features then get tables over both their bins in
the same way. A score is the sum of one table entry per feature and pair, so whole batches are scored
by array lookups.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their id; their features
(a few numbers per row) are the only thing that comes to the driver. All texts are scored, whole.

Defined results: a null or empty text is scored with its features all 0; label rows without label, or whose
document is not there, are not used, and without any label all scores are 0.5; of labels with the same id
the largest counts; repeated rows are scored alike; other columns are kept by :func:`with_score`;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm.tasks import SLICE_BYTES, column, ship_functions

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
CYCLES, PAIR_CYCLES = 150, 60
RATE = 0.1
LEAVES = 4
PAIRS = 8
_SMOOTH = 5.0  # added to the second derivative of a leaf

FEATURES = [
    "words", "word_bytes", "symbols", "digits", "upper", "exclaims", "stops", "pipes", "lines", "beyond_ascii",
    "distinct_words", "repeated_grams", "top_word", "short_words", "repeated_pairs", "symbol_words",
]


# --- features -----------------------------------------------------------------------


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _DIGIT, _UPPER = _flags("#*$%&|<>@^~=_\\{}[]"), _flags("0123456789"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_EXCLAIM, _STOP, _PIPE, _LINE = _flags("!?"), _flags(".,;:"), _flags("|"), _flags("\n")
_BEYOND = np.arange(256) > 127


def _repeated(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: values, distinct values, and how often the most frequent one occurs."""
    total = np.bincount(doc, minlength=rows)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, doc[start], np.diff(np.append(start, len(h))))
    return total, np.bincount(doc[start], minlength=rows), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, begin, end = arrays.flat(texts)
    rows, size = len(begin), np.maximum(end - begin, 1)
    found = arrays.words(data, begin, end)
    h = arrays.word_hashes(data, found)

    def share(flags: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        return (running[end] - running[begin]) / size

    words, distinct, top = _repeated(found.doc, h, rows)
    some = np.maximum(words, 1)
    lengths = found.end - found.begin
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    marked = marks[found.end] > marks[found.begin]
    shares = {}
    for n in (2, 5):
        at, gram = arrays.grams(h, found.doc, n)
        total, single, _ = _repeated(found.doc[at], gram, rows)
        shares[n] = 1 - single / np.maximum(total, 1)
        shares[n][total == 0] = 0
    columns = [
        np.log1p(words), np.bincount(found.doc, lengths, rows) / some, share(_SYMBOL), share(_DIGIT), share(_UPPER), share(_EXCLAIM),
        share(_STOP), share(_PIPE), share(_LINE), share(_BEYOND), distinct / some, shares[5], top / some,
        np.bincount(found.doc, lengths <= 3, rows) / some, shares[2], np.bincount(found.doc, marked, rows) / some,
    ]
    return np.stack(columns, axis=1)


# --- model --------------------------------------------------------------------------


class Model(NamedTuple):
    """Bin edges by feature, lookup tables by feature, and tables of feature pairs over coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at quantiles of the distinct part of the values."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))


def _leaf(gradient: float, curvature: float) -> float:
    return gradient / (curvature + _SMOOTH)


def _tree(gradient: np.ndarray, curvature: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values of a shallow tree over ordered bins: the best cut of any part, again until there are enough leaves."""
    g, c = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(curvature)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (c[b] - c[a] + _SMOOTH)
    cuts = [0, len(gradient)]
    while len(cuts) <= leaves:
        best, place = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            middle = np.arange(a + 1, b)
            gain = worth(a, middle) + worth(middle, b) - worth(a, b)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, place = gain[k], int(middle[k])
        if place is None:
            break
        cuts = sorted([*cuts, place])
    return np.concatenate([np.full(b - a, _leaf(g[b] - g[a], c[b] - c[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _pair_tree(gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, float]:
    """Values and gain of a tree over two features: one cut of the first, one of the second on either side; or the other way round."""
    best: tuple[np.ndarray, float] = (np.zeros_like(gradient), 0.0)
    whole = gradient.sum() ** 2 / (curvature.sum() + _SMOOTH)
    for turned in (False, True):
        g, c = (gradient.T, curvature.T) if turned else (gradient, curvature)
        for cut in range(1, g.shape[0]):
            parts = [_tree(g[side].sum(0), c[side].sum(0), 2) for side in (slice(cut), slice(cut, None))]
            gain = -whole
            for side, values in zip((slice(cut), slice(cut, None)), parts, strict=True):
                for value in np.unique(values):
                    here = values == value
                    gain += g[side][:, here].sum() ** 2 / (c[side][:, here].sum() + _SMOOTH)
            if gain > best[1]:
                table = np.concatenate([np.tile(parts[0], (cut, 1)), np.tile(parts[1], (g.shape[0] - cut, 1))])
                best = (table.T if turned else table, gain)
    return best


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the model to rows ``x`` with labels ``y`` (0 or 1)."""
    n_features = x.shape[1]
    if not len(y):
        none = [np.zeros(0)] * n_features
        return Model(none, [np.zeros(1)] * n_features, none, [], 0.0)
    edges = [_edges(x[:, f], BINS) for f in range(n_features)]
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(n_features)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rate = np.clip(y.mean(), 0.001, 0.999)
    base = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), base)
    for _ in range(CYCLES):
        for f in range(n_features):
            p = _sigmoid(total)
            size = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size))
            tables[f] += step
            total += step[bins[f]]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(n_features)]
    wide = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(n_features)]

    def grid(a: int, b: int, weight: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(wide[a] * shape[1] + wide[b], weight, shape[0] * shape[1]).reshape(shape)

    p = _sigmoid(total)
    gains = [
        (_pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1], a, b) for a in range(n_features) for b in range(a + 1, n_features)
    ]
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    pairs = {ab: np.zeros((len(coarse[ab[0]]) + 1, len(coarse[ab[1]]) + 1)) for ab in chosen}
    for _ in range(PAIR_CYCLES):
        for a, b in chosen:
            p = _sigmoid(total)
            step = RATE * _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0]
            pairs[a, b] += step
            total += step[wide[a], wide[b]]
    return Model(edges, tables, coarse, [(a, b, t) for (a, b), t in pairs.items()], base)


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: a sum of table entries."""
    total = np.full(len(x), model.base)
    for f, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
        total += table[np.searchsorted(edges, x[:, f], side="right")]
    for a, b, table in model.pairs:
        total += table[np.searchsorted(model.coarse[a], x[:, a], side="right"), np.searchsorted(model.coarse[b], x[:, b], side="right")]
    return _sigmoid(total)


# --- DataFrames ---------------------------------------------------------------------


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts with about ``SLICE_BYTES``, and of at most 30,000 texts."""
    _, begin, end = arrays.flat(texts)
    first = 0
    for k in range(len(texts)):
        if end[k] - begin[first] >= SLICE_BYTES or k + 1 - first == 30_000 or k + 1 == len(texts):
            yield texts.slice(first, k + 1 - first)
            first = k + 1


def by_text(text: Column, kind: str, use: Callable[[pa.Array], list | np.ndarray | pa.Array]) -> Column:
    """A column computed from texts, a slice at a time."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        made = [pa.array(use(part)) for part in parts(texts)]
        return pa.concat_arrays(made) if made else pa.array([])

    return run(text)


def folds(doc_id: Column, count: int) -> Column:
    """``crc32`` of the id as text, modulo ``count``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % count


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents with ``fold`` true, chosen by a hash of the id."""
    known = (
        labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(fold)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    return texts.join(F.broadcast(known), "doc_id")  # at most ``rows`` pairs of numbers


def train(docs: DataFrame, labels: DataFrame, label: str, fold: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Model of a label, fitted on a bounded sample of labelled documents."""
    ship_functions(docs.sparkSession)
    chosen = sample(docs, labels, label, fold, rows)
    found = chosen.select("doc_id", "label", by_text(F.col("text"), "array<double>", lambda t: features(t).tolist()).alias("x"))
    # The document of a label may be repeated; one row per label keeps the bound.
    table = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, table.column("label").to_numpy().astype(float))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    ship_functions(docs.sparkSession)
    return docs.withColumn(name, by_text(column(docs, "text"), "double", lambda t: score(model, features(t))))
