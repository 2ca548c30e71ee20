"""Spelling variants, benchmark leaks and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_samples import CLASHES, SCHEMA, table

from panelspark.llm import decontamination, periodic_runs, spelling

# --- spelling variants ------------------------------------------------------------------


def one_edit_away(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + c + word[i + 1 :] for c in letters} | {word[:i] + word[i + 1 :]}
    return out - {word}


def variants(counts):
    letters = {c for w in counts for c in w}
    forms, near = {}, {}
    for word, n in counts.items():
        found = [w for w in one_edit_away(word, letters) if w in counts]
        near[word] = len(found)
        best = min(found, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        out.append((word, forms[word], root, n, near[word], counts.get(forms[word])))
    return sorted(out, key=repr)


@pytest.fixture(params=[1, 7])
def parts(request, spark):
    """Few and many tasks, so that tries run over their borders."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_variants_match_brute_force(spark, parts):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))): 2 ** rng.randrange(12) for _ in range(300)}
    counts |= {"a" * k: 2**k for k in range(1, 12)} | {"x": 1, "日本語のテ": 3, "日本語テ": 9, "日本誤のテ": 3}
    words = spark.createDataFrame(list(counts.items()), "word STRING, n BIGINT")
    assert table(spelling.group_variants(words), "*") == variants(counts)


def test_hot_prefix_and_long_words(spark, parts):
    """A third of all words begin alike, and words of many letters differ by one."""
    long = "q" * 4_000
    counts = {f"samebeginning{k:03d}": k + 1 for k in range(60)} | {f"w{k:05d}": 5 for k in range(0, 120_000, 1_000)}
    counts |= {long: 3, long + "q": 9, long[:2_000] + "z" + long[2_000:]: 4, long[:-1] + "y": 40}
    found = {r.word: r for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word STRING, n BIGINT")).collect()}
    assert len(found) == len(counts)
    assert found[long].n_near == 3 and found[long].form == long[:-1] + "y"
    assert found["samebeginning000"].n_near == 9 + 5 and found["samebeginning000"].form == "samebeginning050"


def test_words_and_typos(spark, odd_rows, none):
    rng = random.Random(2)
    names = [rng.choice(["Hello", "hellÖ", "wörld", "ÀÉÿßa", "straße", "İstanbul", "a×b÷c"]) for _ in range(400)]
    rows = [*odd_rows, *((20 + k % 30, " ".join(names[k : k + 9]), None, None, None) for k in range(390)), (None, "Hello " * 9, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    expected = sorted((w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3)
    assert expected and table(spelling.count_words(docs, 7), "word", "n") == sorted(expected, key=repr)
    crowded = docs.withColumns({name: docs.doc_id for name in CLASHES})
    assert table(spelling.count_words(crowded, 7), "word", "n") == sorted(expected, key=repr)
    assert spelling.group_variants(spelling.count_words(none)).collect() == []


# --- benchmark leaks --------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        words = plain_words(text)
        for k in range(max(len(words) - size, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(words[k : k + n])]
        out.append((doc_id, len(words), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=repr)


def test_leaks_match_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "d", "ÉÉ", "7", "naïve", "日本"])
    text = lambda n: " ".join(word() + rng.choice(["", ".", ",\n", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 25]) + (4 if k < 20 else 0))) for k in range(25)]
    items += [(1, text(12)), (None, "gamma gamma gamma d d"), (99, None), (98, "..."), (97, items[0][1])]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(60)]
    for k in range(20):
        a, b = rng.choice(items)[1] or "", text(rng.randrange(5))
        docs.append((100 + k, b + " " + a.upper().replace("É", "É") + " " + text(3)))
    docs += [(5, docs[5][1]), (5, "again"), (None, items[3][1]), (None, None), (7, ""), (8, " ".join(["d"] * 5_000))]
    found = decontamination.find_leaks(
        spark.createDataFrame([(i, t, "en", "a", None) for i, t in docs], SCHEMA).repartition(3),
        spark.createDataFrame(items, "item_id BIGINT, text STRING"),
    ).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found), key=repr) == leaks(docs, items)
    for r in found:
        spans = [(s.begin, s.end) for s in r.spans]
        assert sum(e - b for b, e in spans) == r.n_hit and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_rarest_shingle_of_a_window(spark):
    """Windows of an item whose beginning is everywhere are sought by what is rare in them."""
    common = "a b c d e f g h i"
    docs = [(k, f"{common} x{k}", "en", "a", None) for k in range(200)] + [(999, f"y {common} rare z", "en", "a", None)]
    items = spark.createDataFrame([(1, f"{common} rare")], "item_id BIGINT, text STRING")
    _, met, _ = decontamination.find_windows(spark.createDataFrame(docs, SCHEMA), items)
    assert [(r.begin, r.size) for r in met.collect()] == [(1, 10)]


# --- periodic runs ----------------------------------------------------------------------


def runs_of(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the least period comes first
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(rng):
    words = []
    for _ in range(rng.randrange(8)):
        letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])]
        if rng.random() < 0.6:
            unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 33, 40, 70]))]
            if rng.random() < 0.3:
                unit = ["a"] * (len(unit) - 1) + ["b"]
            words += [unit[i % len(unit)] for i in range(int(len(unit) * rng.uniform(2.5, 7)))]
        else:
            words += [rng.choice(letters) for _ in range(rng.randrange(50))]
    return words


@pytest.mark.parametrize("direct, widest", [(2, 1 << 22), (16, 1 << 22), (2, 8)])
def test_runs_match_brute_force(monkeypatch, direct, widest):
    """With the transform at nearly all scales, with short blocks compared as they are, and with blocks in parts."""
    monkeypatch.setattr(periodic_runs, "_DIRECT", direct)
    monkeypatch.setattr(periodic_runs, "_WIDEST", widest)
    rng = random.Random(direct)
    for _ in range(30):
        docs = [repeating(rng) for _ in range(6)]
        found, start, stop, period = periodic_runs.find(pa.array([" ".join(d) for d in docs]))
        bounds = np.searchsorted(found.doc, np.arange(len(docs) + 1))
        for k, words in enumerate(docs):
            own = (start >= bounds[k]) & (start < bounds[k + 1])
            got = list(zip((start[own] - bounds[k]).tolist(), (stop[own] - start[own]).tolist(), period[own].tolist()))
            assert got == runs_of(words)


def test_squared_differences():
    rng = np.random.default_rng(1)
    for size in (1, 2, 16, 64):
        blocks, windows = (rng.integers(0, periodic_runs.PRIME, (3, k * size)).astype(np.uint64) for k in (1, 2))
        found = periodic_runs.mismatches(blocks, windows)
        for row in range(3):
            for offset in range(size):
                exact = sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[row], windows[row, offset : offset + size]))
                assert int(found[row, offset]) == exact % periodic_runs.PRIME


@pytest.mark.parametrize("words", [["a"] * 60_000, [f"w{i % 7_919}" for i in range(50_000)], ["a", "b"] * 3 + ["a"] * 5_000 + ["b", "a"] * 9])
def test_long_runs(words):
    found, start, stop, period = periodic_runs.find(pa.array([" ".join(words)]))
    kept = [(int(s), int(e - s), int(q)) for s, e, q in zip(start, stop, period)]
    if len(set(words)) == 1:
        assert kept == [(0, 60_000, 1)]
    elif len(words) == 50_000:
        assert kept == [(0, 50_000, 7_919)]
    else:
        assert (6, 5_001, 1) in kept or (6, 5_000, 1) in kept


def digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_of(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(listed), sha(kept))


def test_digest_matches_brute_force(spark):
    rng = random.Random(21)
    docs = [(k, " ".join(repeating(rng) or [""])) for k in range(120)] + [(None, "a a a a a a"), (None, None), (3, ""), (3, "b b")]
    frame = spark.createDataFrame([(i, t, "en", "a", None) for i, t in docs], SCHEMA).repartition(3)
    found = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.plant(frame)))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert table(found, *columns) == sorted((digest(*d) for d in docs), key=repr)
    wide = frame.withColumns({name: frame.doc_id for name in CLASHES})
    assert table(periodic_runs.digest(periodic_runs.find_runs(wide)), *columns) == table(periodic_runs.digest(periodic_runs.find_runs(frame)), *columns)
