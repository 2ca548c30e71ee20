"""SentencePiece encoding and decoding with a public vocabulary.

All pieces are in one Aho-Corasick automaton. A text is read once, character by character; at each
position the automaton's state and its output links name the pieces that end there, and each relaxes the
best score of that position (Viterbi). A character that is no piece of its own may be written as its
UTF-8 byte pieces, at a score below every piece. The segmentation with the greatest sum of piece scores
wins; of equal ones the one whose last piece is longer.

No piece holds a space behind another character, or a line feed, so a text falls into units (spaces and the
word behind them, or a line feed) that are segmented on their own. Distinct units of a batch go
through the automaton side by side, one numpy step per position; units seen before are remembered.

The leading space that SentencePiece puts before a text is added and taken off again; spaces stay as
they are, so decoding gives back the exact text, whatever characters it holds.

Defined results: null and empty texts have no pieces and decode to an empty text; repeated rows are encoded
alike; other columns are kept by :func:`with_pieces`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tasks import column, ship_functions

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_UNITS = re.compile(r" *[^ \n]+|\n| +")
# Bytes of units that a task remembers, about so many for each besides its text and pieces, and characters sent through
# the automaton at once.
_REMEMBERED_BYTES = 24 << 20
_ENTRY_BYTES = 160
_AT_ONCE = 1 << 18
_BYTE_PENALTY = 10.0


class Automaton(NamedTuple):
    """Pieces as flat tables. Node 0 is the root; keys are ``node << 21 | code point``, sorted."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    piece: np.ndarray  # piece that ends at a node, or -1
    link: np.ndarray  # next shorter piece's node along the output links, 0 if none
    length: np.ndarray  # characters of the piece at a node
    score: np.ndarray
    byte_score: float
    byte_pieces: np.ndarray  # piece of each of the 256 bytes
    spelled: list[bytes]  # bytes of each piece


def build(pieces: list[tuple[str, float]], byte_pieces: list[int], ignored: Iterable[int] = ()) -> Automaton:
    """Automaton of ``(piece, score)`` pairs; byte and ignored pieces are not matched in texts."""
    skipped = {*byte_pieces, *ignored}
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for number, (piece, _) in enumerate(pieces):
        if number in skipped or not piece:
            continue
        text = piece.replace(_SPACE, " ")
        if "\n" in text or " " in text.lstrip(" "):
            raise ValueError(f"A piece crosses a unit: {piece!r}")
        node = 0
        for char in text:
            if char not in children[node]:
                children[node][char] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][char]
        ends[node] = number
    count = len(children)
    fail, link, depth = [0] * count, [0] * count, [0] * count
    queue = list(children[0].values())
    for node in queue:
        depth[node] = 1
    for node in queue:  # by depth, as children are appended behind
        for char, child in children[node].items():
            back = fail[node]
            while back and char not in children[back]:
                back = fail[back]
            fail[child] = children[back].get(char, 0)
            depth[child] = depth[node] + 1
            queue.append(child)
        link[node] = fail[node] if ends[fail[node]] >= 0 else link[fail[node]]
    keys = np.array([node << 21 | ord(c) for node, row in enumerate(children) for c in row], np.int64)
    targets = np.array([t for row in children for t in row.values()], np.int64)
    order = np.argsort(keys)
    spelled = [p.replace(_SPACE, " ").encode() for p, _ in pieces]
    for value, number in enumerate(byte_pieces):
        spelled[number] = bytes([value])
    piece = np.array(ends)
    score = np.where(piece >= 0, np.array([s for _, s in pieces])[piece], 0.0)
    least = min(s for k, (_, s) in enumerate(pieces) if k not in skipped)
    return Automaton(
        keys[order], targets[order], np.array(fail), piece, np.array(link), np.array(depth), score,
        least - _BYTE_PENALTY, np.array(byte_pieces, np.int32), spelled,
    )


def load(path: str = VOCABULARY) -> Automaton:
    """Automaton of a SentencePiece model file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    table = [(model.id_to_piece(i), model.get_score(i)) for i in range(n)]
    by_byte = {int(p[3:5], 16): i for i, (p, _) in enumerate(table) if model.is_byte(i)}
    if len(by_byte) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    ignored = [i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
    return build(table, [by_byte[b] for b in range(256)], ignored)


def _step(machine: Automaton, state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Next state of each unit: along failure links until the character leads on."""
    out = np.zeros_like(state)
    open_ = np.arange(len(state))
    while len(open_):
        key = state[open_] << 21 | code[open_]
        place = np.minimum(np.searchsorted(machine.keys, key), len(machine.keys) - 1)
        hit = machine.keys[place] == key
        out[open_[hit]] = machine.targets[place[hit]]
        open_ = open_[~hit]
        open_ = open_[state[open_] > 0]
        state = state.copy() if len(open_) else state
        state[open_] = machine.fail[state[open_]]
    return out


def segment(machine: Automaton, units: list[str]) -> list[bytes]:
    """Pieces of each unit, as the bytes of an int32 array."""
    order = sorted(range(len(units)), key=lambda k: -len(units[k]))
    sizes = np.array([len(units[k]) for k in order])
    codes = np.frombuffer("".join(units[k] for k in order).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.cumsum(sizes) - sizes  # of the unit's characters
    base = first + np.arange(len(order))  # of its positions, one more than characters
    best = np.full(len(codes) + len(order), -np.inf)
    best[base] = 0.0
    by = np.full(len(best), -1)  # node of the last piece; -1 for byte pieces
    state = np.zeros(len(order), np.int64)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        active = int(np.searchsorted(-sizes, -i))  # units longer than i are in front
        state = _step(machine, state[:active], codes[first[:active] + i])
        at = base[:active] + i + 1
        node = np.where(machine.piece[state] >= 0, state, machine.link[state])
        single = np.zeros(active, bool)
        some = np.flatnonzero(node)
        while len(some):
            here = node[some]
            length = machine.length[here]
            single[some] |= length == 1
            score = best[at[some] - length] + machine.score[here]
            better = score > best[at[some]]
            best[at[some[better]]] = score[better]
            by[at[some[better]]] = here[better]
            node[some] = machine.link[here]
            some = some[node[some] > 0]
        alone = np.flatnonzero(~single)
        score = best[at[alone] - 1] + machine.byte_score
        better = score > best[at[alone]]
        best[at[alone[better]]] = score[better]
        by[at[alone[better]]] = -1
    steps, counts = [], np.zeros(len(order), np.int64)
    position, left = sizes.copy(), np.flatnonzero(sizes)
    while len(left):  # from the last piece to the first, all units at once
        node = by[base[left] + position[left]]
        spelled = node < 0
        for value, rest in _utf8(codes[(first[left] + position[left] - 1)[spelled]]):
            steps.append((left[spelled][rest], counts[left[spelled][rest]], machine.byte_pieces[value]))
            counts[left[spelled][rest]] += 1
        whole = left[~spelled]
        steps.append((whole, counts[whole], machine.piece[node[~spelled]]))
        counts[whole] += 1
        position[left] -= np.where(spelled, 1, machine.length[node])
        left = left[position[left] > 0]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for unit, step, piece in steps:
        ids[ends[unit] - 1 - step] = piece
    data, out = ids.tobytes(), [b""] * len(units)
    for k, end, count in zip(order, (ends * 4).tolist(), (counts * 4).tolist(), strict=True):
        out[k] = data[end - count : end]
    return out


def _utf8(codes: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes of characters from the last to the first: the bytes, and which characters have them."""
    size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    for k in range(int(size.max()) if len(size) else 0):
        rest = np.flatnonzero(size > k)
        bits = codes[rest] >> (6 * k)
        last = size[rest] == k + 1
        yield np.where(last, bits | lead[rest], 0x80 | (bits & 0x3F)), rest


def score_of(machine: Automaton, text: str, ids: Iterable[int]) -> float:
    """Sum of the piece scores of an encoded text."""
    scores = dict(zip(machine.piece.tolist(), machine.score.tolist(), strict=True))
    ids, chars = list(ids), {int(b) for b in machine.byte_pieces}
    whole = sum(scores[i] for i in ids if i not in chars)
    spelt = b"".join(machine.spelled[i] for i in ids if i in chars).decode()
    return whole + machine.byte_score * len(spelt)


class Encoder:
    """Encodes texts within a task and remembers units."""

    def __init__(self, machine: Automaton):
        self.machine = machine
        self.known: dict[str, bytes] = {}
        self.size = 0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [_UNITS.findall(" " + t) if t else [] for t in texts]
        units = set(chain.from_iterable(split))
        if self.size > _REMEMBERED_BYTES:
            self.known, self.size = {}, 0
        new = list(units.difference(self.known))
        begin, size = 0, 0
        for end, unit in enumerate(new, 1):
            size += len(unit)
            if size >= _AT_ONCE or end == len(new):
                found = segment(self.machine, new[begin:end])
                self.known.update(zip(new[begin:end], found, strict=True))
                self.size += size + sum(map(len, found)) + _ENTRY_BYTES * (end - begin)
                begin, size = end, 0
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, units)), np.int32) for units in split]


def _lists(out: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, out)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))


def decode_ids(machine: Automaton, ids: Iterable[int]) -> str:
    """Text of a piece sequence."""
    text = b"".join(map(machine.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _groups(texts: list[str]) -> Iterable[tuple[int, int]]:
    """Runs of texts with about ``_AT_ONCE`` characters."""
    begin, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= _AT_ONCE or end == len(texts):
            yield begin, end
            begin, size = end, 0


def pieces_of(text: Column, machine: Automaton) -> Column:
    """Piece ids of a text column, as an array."""
    encoders: list[Encoder] = []

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        if not encoders:
            encoders.append(Encoder(machine))
        values = [t or "" for t in texts.to_pylist()]
        out = [ids for a, b in _groups(values) for ids in encoders[0](values[a:b])]
        return _lists(out)

    return run(text)


def text_of(ids: Column, machine: Automaton) -> Column:
    """Text of a column of piece ids; null ids are an empty text."""
    spelled = machine.spelled

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        out = []
        for ids in lists:
            text = b"".join(map(spelled.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else b""
            text = text.decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return pa.array(out, pa.string())

    return run(ids)


def with_pieces(docs: DataFrame, path: str = VOCABULARY, name: str = "pieces") -> DataFrame:
    """``docs`` with a column of piece ids."""
    ship_functions(docs.sparkSession)
    return docs.withColumn(name, pieces_of(column(docs, "text"), load(path)))


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_pieces, pieces, decoded_sha256, lossless`` of every row of ``docs``."""
    ship_functions(docs.sparkSession)
    machine = load(path)
    text = F.coalesce(column(docs, "text"), F.lit(""))
    spelled = machine.spelled
    encoders: list[Encoder] = []

    def run(batches):
        if not encoders:
            encoders.append(Encoder(machine))
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in _groups(values):
                out = encoders[0](values[a:b])
                decoded = [b"".join(map(spelled.__getitem__, ids.tolist()))[1:] for ids in out]
                lossless = [d == t.encode() for d, t in zip(decoded, values[a:b], strict=True)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(ids) for ids in out], pa.int64()),
                        _lists(out),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                        pa.array(lossless),
                    ],
                    ["doc_id", "n_pieces", "pieces", "decoded_sha256", "lossless"],
                )

    return docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        run, "doc_id long, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean"
    )
