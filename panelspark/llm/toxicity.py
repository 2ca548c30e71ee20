"""Toxicity of deobfuscated texts: a noisy channel before the classifier.

1. A character language model (interpolated n-grams up to four bytes, all that occur) is counted over all documents.
2. A token that may be disguised - digits or signs for letters (leetspeak) anywhere beside a letter, letters drawn out or doubled
   in a row in any case, or set apart by spaces, dots and the like - is read as a lattice: each sign may stand for the letters it looks like, a run of letters for
   one or two, a separator for nothing. Viterbi decoding finds the path with the best sum of channel
   costs and language model scores. All other tokens have a lattice of one path and stay as they are.
3. A lexicon of words and word beginnings that mark label 1 is learned on one half of a bounded sample of
   labelled documents, and an additive model over a text's lexicon hits on the other half. It scores the
   restored words of each text, per text length, so a chance hit in a long text weighs little.

Copies are taken into the sample once: of sample documents with the same label and least shingle one counts.

Defined results: a null or empty text has no hits; without labels all scores are 0.5; repeated
rows are scored alike; other columns are kept by :func:`with_score`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import arrays, quality_gam
from panelspark.llm.tasks import column, ship_functions, slices

SAMPLE_ROWS = 30_000
LEAST_DOCUMENTS = 4  # with a feature, for the lexicon
LEAST_LOG_ODDS, LEAST_Z = 1.5, 3.5
PREFIXES = (4, 5, 6, 7)

_SPACE = 0x20
_FEATURE_BITS = 20


# --- plain form: lower case letters between single spaces -----------------------------


def _plain_table() -> np.ndarray:
    table = np.full(256, _SPACE, np.uint8)
    table[128:] = np.arange(128, 256)
    lower = np.arange(ord("a"), ord("z") + 1)
    table[lower] = lower
    table[lower - 32] = lower
    return table


_PLAIN = _plain_table()
_IS_LETTER = _PLAIN != _SPACE


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case (ASCII and Latin-1 letters), all but letters as spaces."""
    out = _PLAIN[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    return out


# --- language model -----------------------------------------------------------------


def _grams(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all 4-grams of a byte stream, and of its last n-grams for n = 3, 2 and 1, which begin no 4-gram."""
    s = stream.astype(np.uint32)
    four = (s[:-3] << np.uint32(24)) | (s[1:-2] << np.uint32(16)) | (s[2:-1] << np.uint32(8)) | s[3:]
    last = (int(s[-3]) << 16) | (int(s[-2]) << 8) | int(s[-1])
    return four, np.array([last, last & 0xFFFF, last & 0xFF], np.int64)


def _summed(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of ``seen``."""
    order = np.argsort(keys, kind="stable")
    keys, seen = keys[order], seen[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(seen, first) if len(keys) else seen


def _model_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task's texts, a row per n-gram. Shorter ones are sums of those that begin with them."""
    four = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    ends: list[np.ndarray] = []
    for batch in slices(batches):
        data, begin, end = arrays.flat(batch.column(0))
        stream = np.insert(plain(data), np.append(begin[end > begin], len(data)), _SPACE)
        keep = np.ones(len(stream), bool)
        keep[1:] = (stream[1:] != _SPACE) | (stream[:-1] != _SPACE)
        stream = stream[keep]
        if len(stream) >= 4:
            grams, last = _grams(stream)
            keys, seen = np.unique(grams, return_counts=True)
            four.append((keys.astype(np.int64), seen))
            ends.append(last)
            if sum(len(k) for k, _ in four) > 4 * len(four[0][0]) + 1_000_000:
                four = [_summed(*(np.concatenate(part) for part in zip(*four, strict=True)))]
    keys, seen = _summed(*(np.concatenate(part) for part in zip(*four, strict=True)))
    for n in (4, 3, 2, 1):
        yield pa.record_batch([pa.array(np.full(len(keys), n, np.int32)), pa.array(keys), pa.array(seen)], ["n", "gram", "seen"])
        if n > 1:
            more = np.array([e[4 - n] for e in ends], np.int64)
            keys, seen = _summed(np.concatenate([keys >> 8, more]), np.concatenate([seen, np.ones(len(more), np.int64)]))


class Grams(NamedTuple):
    """Counts of the n-grams that occur, by their number in order."""

    keys: np.ndarray
    seen: np.ndarray

    def __getitem__(self, number: int) -> int:
        at = int(self.keys.searchsorted(np.uint32(number)))
        return int(self.seen[at]) if at < len(self.keys) and self.keys[at] == number else 0


# Probabilities remembered by a model, and bytes of readings remembered by a task with those of each entry.
_REMEMBERED = 1 << 17
_REMEMBERED_BYTES, _ENTRY_BYTES = 16 << 20, 180


class Language:
    """Interpolated n-gram probabilities of the next byte."""

    def __init__(self, counts: list[np.ndarray | Grams]):
        self.counts = counts
        self.known: dict[tuple[bytes, int], float] = {}

    def log_p(self, context: bytes, byte: int) -> float:
        """log P(byte | last three bytes of the text)."""
        found = self.known.get((context, byte))
        if found is None:
            p = (float(self.counts[0][byte]) + 1) / (float(self.counts[0].sum()) + 256)
            for n in range(1, 4):
                if len(context) < n:
                    break
                gram = context[len(context) - n :] + bytes([byte])
                p = (self._seen(gram) + 4 * p) / (self._seen(gram[:-1]) + 4)
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            found = self.known[context, byte] = math.log(p)
        return found

    def _seen(self, gram: bytes) -> float:
        return float(self.counts[len(gram) - 1][int.from_bytes(gram, "big")])


def language_model(docs: DataFrame) -> Language:
    """Language model of all texts, with the exact count of every n-gram that occurs."""
    ship_functions(docs.sparkSession)
    counted = (
        docs.select(column(docs, "text").alias("text")).mapInArrow(_model_counts, "n int, gram long, seen long")
        .groupBy("n", "gram").agg(F.sum("seen").alias("seen")).toArrow()
    )
    n, gram, seen = (counted.column(c).to_numpy() for c in ("n", "gram", "seen"))
    counts: list[np.ndarray | Grams] = []
    for order in (1, 2):
        table = np.zeros(1 << 8 * order, np.int64)
        table[gram[n == order]] = seen[n == order]
        counts.append(table)
    for order in (3, 4):
        keys, sums = _summed(gram[n == order], seen[n == order])
        counts.append(Grams(keys.astype(np.uint32), sums))
    return Language(counts)


# --- channel ------------------------------------------------------------------------

# Letters that a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "2": "z",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "€": "e", "£": "l", "(": "c",
}
_SEPARATORS = " .-_*~'/\\,:;"
_SIGN_COST, _STAR_COST, _DROP_COST, _BREAK_COST = -1.0, -2.5, -0.3, -2.0
_COLLAPSE_COST, _PAIR_COST, _DRAWN_COST = -0.5, -2.0, -6.0


def _edges(text: str, i: int) -> list[tuple[int, str, float]]:
    """Ways to read on at position ``i``: characters used, letters meant, cost."""
    char = text[i]
    if char.isalpha():
        run = 1
        while i + run < len(text) and text[i + run] == char:
            run += 1
        if run == 1:
            return [(1, char, 0.0)]
        if run == 2:
            return [(2, char * 2, 0.0), (2, char, _PAIR_COST)]
        return [(run, char, _COLLAPSE_COST), (run, char * 2, _COLLAPSE_COST), (run, char * run, _DRAWN_COST)]
    cost = _STAR_COST if char == "*" else _SIGN_COST
    out = [(1, letter, cost) for letter in LOOKS_LIKE.get(char, "")]
    if char in _SEPARATORS:
        out.append((1, "", _DROP_COST))
    return [*out, (1, " ", _BREAK_COST if out else 0.0)]


# Characters read between two looks for a place that all readings go through.
_PART = 256


def restore(token: str, language: Language) -> str:
    """Most likely plain reading of a token, by Viterbi over the lattice; states are the last three bytes.

    Readings of a long token soon agree on its beginning, which is then fixed and its lattice given up.
    """
    text = token.lower()
    at: dict[int, dict[bytes, tuple[float, int, bytes, str]]] = {0: {b" ": (0.0, -1, b"", "")}}
    done: list[str] = []
    fixed, look = 0, _PART  # all readings go through the one state at ``fixed``
    for i in range(len(text)):
        if i not in at:
            continue
        if i >= look:
            fixed = _fix(at, i, fixed, done)
            look = i + max(_PART, i - fixed)
        edges = _edges(text, i)
        for state, (score, *_) in at[i].items():
            for used, letters, cost in edges:
                total, context = score + cost, state
                for byte in letters.encode():
                    if byte == _SPACE and context[-1:] == b" ":
                        continue
                    total += language.log_p(context, byte)
                    context = (context + bytes([byte]))[-3:]
                ahead = at.setdefault(i + used, {})
                known = ahead.get(context)
                if known is None or total > known[0]:
                    ahead[context] = (total, i, state, letters)
    last = at[len(text)]
    end = lambda c: 0.0 if c[-1:] == b" " else language.log_p(c, _SPACE)
    state = max(last, key=lambda c: (last[c][0] + end(c), c))
    done += _read_back(at, len(text), state, fixed)
    return " ".join("".join(done).split())


def _read_back(at: dict, i: int, state: bytes, stop: int) -> list[str]:
    """Letters of the best reading from position ``stop`` to a state at ``i``."""
    parts = []
    while i > stop:
        _, before, previous, letters = at[i][state]
        parts.append(letters)
        i, state = before, previous
    return parts[::-1]


def _fix(at: dict, i: int, fixed: int, done: list[str]) -> int:
    """Move ``fixed`` on to the last state that the readings of all states from ``i`` on go through."""
    open_ = {k: set(states) for k, states in at.items() if k >= i}
    for k in range(max(open_), fixed, -1):
        states = open_.pop(k, None)
        if not states:
            continue
        if len(states) == 1 and not open_:
            state = states.pop()
            done += _read_back(at, k, state, fixed)
            for before in [p for p in at if p < k]:
                del at[before]
            return k
        for state in states:
            _, before, previous, _ = at[k][state]
            open_.setdefault(before, set()).add(previous)
    return fixed


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKS_LIKE if ord(c) < 128]] = True
_JOINER = np.zeros(256, bool)
_JOINER[[ord(c) for c in _SEPARATORS if c not in " '"]] = True
_WIDE_SIGNS = [c.encode() for c in LOOKS_LIKE if ord(c) >= 128]


def _count_in(flags: np.ndarray, found: arrays.Words) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[found.end] - running[found.begin]


def disguised(data: np.ndarray, found: arrays.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that may be disguised: text, begin and end. ``found`` are tokens between white space."""
    n = len(data)
    if not n or not len(found.begin):
        none = np.zeros(0, np.int64)
        return none, none, none
    letter, sign, joiner = _IS_LETTER[data], _SIGN[data], _JOINER[data]
    for char in _WIDE_SIGNS:
        place = np.flatnonzero(data == char[0])
        for k, byte in enumerate(char):
            place = place[place + k < n]
            place = place[data[place + k] == byte]
        for k in range(len(char)):
            letter[place + k], sign[place + k] = False, True
    folded = plain(data)
    same = folded[1:] == folded[:-1]
    beside = sign & np.append(letter[1:], False)  # h3llo, $illy
    behind = np.append(letter[:-1] & sign[1:], False)  # shi+
    drawn, doubled, set_apart = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    if n > 2:
        drawn[:-2] = letter[:-2] & same[:-1] & same[1:]  # stUuUpid
    if n > 3:
        doubled[:-3] = letter[:-3] & letter[2:-1] & same[:-2] & same[2:]  # iiddiioott
    if n > 4:
        set_apart[:-4] = letter[:-4] & joiner[1:-3] & letter[2:-2] & joiner[3:-1] & letter[4:]
    for marks, ahead in ((beside, 1), (behind, 1), (drawn, 2), (doubled, 3), (set_apart, 4)):  # what lies ahead must be in the same token
        for k in range(1, ahead + 1):
            place = found.end - k
            marks[place[place >= found.begin]] = False
    some = _count_in(beside | behind | drawn | doubled | set_apart, found) > 0
    some &= _count_in(letter, found) > 0
    whole = (data & 0xC0) != 0x80  # first bytes of characters
    letters, chars = _count_in(letter & whole, found), _count_in(whole, found)
    marked = letter | sign
    lone = marked[found.begin] & (letters <= 1) & (chars == 1)
    last = letter[found.begin] & (letters == 1) & (_count_in(marked & whole, found) == 1)  # 't.' ends a run
    near = found.doc[1:] == found.doc[:-1]
    same = (lone[1:] | last[1:]) & lone[:-1] & near
    edge = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # tokens of a run: opens to closes
    running = np.concatenate([[0], np.cumsum(letters)])
    held, size = running[closes + 1] - running[opens], closes - opens + 1
    long = (held >= 2) | (held >= 1) & (size >= 3) | (size >= 4)
    opens, closes = opens[long], closes[long]
    spaced = np.zeros(len(lone) + 1, np.int64)
    spaced[opens] += 1
    spaced[closes + 1] -= 1
    some &= np.cumsum(spaced)[:-1] == 0
    doc = np.concatenate([found.doc[some], found.doc[opens]])
    return doc, np.concatenate([found.begin[some], found.begin[opens]]), np.concatenate([found.end[some], found.end[closes]])


class Restorer:
    """Restores disguised spans within a task and remembers them."""

    def __init__(self, language: Language):
        self.language = language
        self.known: dict[bytes, str] = {}
        self.size = 0

    def __call__(self, span: bytes) -> str:
        out = self.known.get(span)
        if out is None:
            if self.size > _REMEMBERED_BYTES:
                self.known.clear()
                self.size = 0
            self.size += 2 * len(span) + _ENTRY_BYTES
            text = span.decode("utf-8", "replace")
            out = restore(" ".join(text.split()), self.language)
            if out == " ".join(plain(np.frombuffer(text.encode(), np.uint8)).tobytes().decode("utf-8", "replace").split()):
                out = text  # nothing was disguised
            self.known[span] = out
        return out


def restored_texts(texts: pa.Array, restorer: Restorer) -> list[str]:
    """Texts with disguised spans replaced by their reading."""
    data, begin, end = arrays.flat(texts)
    doc, first, last = disguised(data, arrays.words(data, begin, end))
    order = np.lexsort((first, doc))
    spans: dict[int, list[tuple[int, int]]] = {}
    for k in order.tolist():
        spans.setdefault(int(doc[k]), []).append((int(first[k]), int(last[k])))
    out, raw = [], data.tobytes()
    for row in range(len(texts)):
        at, parts = int(begin[row]), []
        for a, b in spans.get(row, ()):
            parts += [raw[at:a], restorer(raw[a:b]).encode()]
            at = b
        out.append(b"".join([*parts, raw[at : int(end[row])]]).decode("utf-8", "replace"))
    return out


def restored_words(texts: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, arrays.Words]:
    """Plain bytes and words of the restored texts: clear words first, then restored ones."""
    data, begin, end = arrays.flat(texts)
    doc, first, last = disguised(data, arrays.words(data, begin, end))
    clear = plain(data)
    raw = data.tobytes()
    readings = [restorer(raw[a:b]).encode() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    change = np.bincount(first, minlength=len(data) + 1) - np.bincount(last, minlength=len(data) + 1)
    clear[np.cumsum(change)[:-1] > 0] = _SPACE
    one = arrays.words(clear, begin, end, _IS_LETTER)
    more = plain(np.frombuffer(b"".join(readings), np.uint8))
    ends = np.cumsum([0, *map(len, readings)])
    two = arrays.words(more, ends[:-1], ends[1:], _IS_LETTER)
    both = arrays.Words(
        np.concatenate([one.doc, doc[two.doc] if len(two.doc) else two.doc]),
        np.concatenate([one.begin, two.begin + len(clear)]), np.concatenate([one.end, two.end + len(clear)]),
    )
    return np.concatenate([clear, more]), doc, both


# --- lexicon and score --------------------------------------------------------------


def _word_features(data: np.ndarray, found: arrays.Words) -> list[np.ndarray]:
    """Feature numbers of each word: the whole word, then its beginnings (the word's own number where it is shorter)."""
    mask = np.uint64((1 << _FEATURE_BITS) - 1)
    wide = data.astype(np.uint64) + np.uint64(1)
    hashed = lambda end, salt: arrays.mix(arrays.mix(arrays._rolling(wide, found.begin, end, arrays._BYTE_BASE)) + np.uint64(salt)) & mask
    out = [hashed(found.end, 0).astype(np.int64)]
    for length in PREFIXES:
        longer = found.end - found.begin > length
        begun = hashed(np.where(longer, found.begin + length, found.end), length).astype(np.int64)
        out.append(np.where(longer, begun, out[0]))
    return out


def _lexicon_counts(language: Language):
    """Documents of either label by feature, in total for a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(language)
        total = np.zeros((2, 1 << _FEATURE_BITS), np.int64)
        for batch in slices(batches):
            data, _, found = restored_words(batch.column(0), restorer)
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            key = np.unique(np.concatenate([(found.doc << _FEATURE_BITS) | f for f in _word_features(data, found)]))
            row, feature = key >> _FEATURE_BITS, key & ((1 << _FEATURE_BITS) - 1)
            for label in (0, 1):
                total[label] += np.bincount(feature[labels[row] == label], minlength=1 << _FEATURE_BITS)
        some = np.flatnonzero(total.sum(0))
        yield pa.record_batch([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["feature", "n0", "n1"])

    return run


class Model(NamedTuple):
    """Language model, lexicon weights by feature, and the additive model over a text's hits."""

    language: Language
    weights: np.ndarray
    hits: quality_gam.Model


def hit_features(texts: pa.Array, restorer: Restorer, weights: np.ndarray) -> np.ndarray:
    """What the lexicon finds in each restored text, in total and against its length."""
    rows = len(texts)
    data, _, found = restored_words(texts, restorer)
    weight = np.zeros(len(found.doc), np.float32)
    for feature in _word_features(data, found):
        np.maximum(weight, weights[feature], out=weight)
    words = np.bincount(found.doc, minlength=rows)
    some = np.maximum(words, 1)
    total = np.bincount(found.doc, weight, rows)
    hit = weight > 0
    hits = np.bincount(found.doc[hit], minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, found.doc[hit], weight[hit])
    strong = np.bincount(found.doc[weight > 3], minlength=rows)
    return np.stack([np.log1p(words), total, total / np.sqrt(some), 100 * total / some, hits, 100 * hits / some, most, strong], axis=1)


def least_shingles(texts: pa.Array) -> np.ndarray:
    """Least five-word shingle hash of each text; 0 for a text without words."""
    doc, h = arrays.shingles(texts, 5)
    out = np.full(len(texts), np.uint64(2**64 - 1))
    np.minimum.at(out, doc, h)
    out[np.bincount(doc, minlength=len(texts)) == 0] = 0
    return out.view(np.int64)


def train(docs: DataFrame, labels: DataFrame, fold: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Model of the label ``toxic``, learned from at most ``rows`` labelled documents with ``fold`` true."""
    ship_functions(docs.sparkSession)
    language = language_model(docs)
    chosen = quality_gam.sample(docs, labels, "toxic", fold, rows)
    copies = chosen.withColumn("copies", quality_gam.by_text(F.col("text"), "long", least_shingles))
    single = copies.groupBy("copies", "label").agg(F.min(F.struct("doc_id", "text")).alias("d")).select(
        "d.doc_id", "d.text", "label", (F.pmod(F.xxhash64("copies", F.lit("half")), F.lit(2)) == 0).alias("first_half")
    )
    totals = {bool(r.label): r.n for r in single.where("first_half").groupBy("label").agg(F.count("*").alias("n")).collect()}
    counted = (
        single.where("first_half").select("text", "label").mapInArrow(_lexicon_counts(language), "feature long, n0 long, n1 long")
        .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= LEAST_DOCUMENTS)
    )
    odds = F.log((F.col("n1") + 0.5) / (totals.get(True, 0) + 1)) - F.log((F.col("n0") + 0.5) / (totals.get(False, 0) + 1))
    z = odds / F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    lexicon = counted.select("feature", odds.alias("odds"), z.alias("z")).where((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("z") >= LEAST_Z))
    weights = np.zeros(1 << _FEATURE_BITS, np.float32)  # the number of features bounds what is collected
    for r in lexicon.collect():
        weights[r.feature] = r.odds

    half = single.where("NOT first_half")
    seen = half.select("doc_id", "label", _hits(F.col("text"), language, weights, "array<double>", lambda x: x.tolist()).alias("x")).toArrow()
    order = np.argsort(seen.column("doc_id").to_numpy())
    x = np.array(seen.column("x").to_pylist(), float).reshape(-1, 8)[order]
    return Model(language, weights, quality_gam.fit(x, seen.column("label").to_numpy()[order].astype(float)))


def _hits(text: Column, language: Language, weights: np.ndarray, kind: str, use) -> Column:
    restorers: list[Restorer] = []

    def run(texts: pa.Array):
        if not restorers:
            restorers.append(Restorer(language))
        return use(hit_features(texts, restorers[0], weights))

    return quality_gam.by_text(text, kind, run)


def score(docs: DataFrame, model: Model) -> Column:
    """Probability that a text of ``docs`` is toxic, as a column."""
    ship_functions(docs.sparkSession)
    hits = model.hits
    return _hits(column(docs, "text"), model.language, model.weights, "double", lambda x: quality_gam.score(hits, x))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    return docs.withColumn(name, score(docs, model))


def with_restored(docs: DataFrame, language: Language, name: str = "restored") -> DataFrame:
    """``docs`` with the restored text."""
    ship_functions(docs.sparkSession)
    restorers: list[Restorer] = []

    def run(texts: pa.Array) -> list[str]:
        if not restorers:
            restorers.append(Restorer(language))
        return restored_texts(texts, restorers[0])

    return docs.withColumn(name, quality_gam.by_text(column(docs, "text"), "string", run))
