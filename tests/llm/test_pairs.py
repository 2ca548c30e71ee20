"""Near duplicates, fingerprints and substring dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import arrays, fingerprints, near_dup, substring_dedup
from panelspark.llm.components import components

from llm_samples import SCHEMA, sentence


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", None) for k, t in enumerate(texts)], SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies in a star and in a chain, shared passages, and texts of their own."""
    rng = random.Random(3)
    passage = sentence(rng, 60)
    out = [sentence(rng, rng.randrange(40, 200), 3_000) for _ in range(60)]
    out += [f"{a} {passage} {b}" for a, b in zip(out[:20], out[20:40], strict=True)]
    base = sentence(rng, 150, 3_000).split()
    out.append(" ".join(base))
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(150)] = "other"
        out.append(" ".join(copy))
    chain = sentence(rng, 300, 3_000).split()
    for step in range(6):
        chain = chain[8:] + sentence(rng, 8, 3_000).split()
        out.append(" ".join(chain))
    return [*out, out[0], out[0], "", " ", "a b", "a b", "a  b"]


def shingle_counts(text):
    w = text.split()
    if len(w) < 5:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_similarity_matches_brute_force(texts):
    """The exact check, without frequent shingles, is the Jaccard similarity of shingle multisets."""
    run = near_dup._similarities(5, np.zeros(0, np.uint64), np.zeros(0))
    pairs = [(a, b) for a in range(0, len(texts), 7) for b in range(len(texts))]
    batch = pa.record_batch(
        [pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs]), pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])],
        ["text_a", "text_b", "a", "b"],
    )
    found = [s for out in run(iter([batch])) for s in out.column(2).to_pylist()]
    for (a, b), s in zip(pairs, found, strict=True):
        x, y = shingle_counts(texts[a]), shingle_counts(texts[b])
        union = sum((x | y).values())
        assert s == pytest.approx(sum((x & y).values()) / union if union else 0.0)


def test_sketch_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    key = np.arange(400, dtype=np.uint64)
    a, b = rng.integers(1, 6, 400) * 0.7, rng.integers(1, 6, 400) * 0.7
    agreed = []
    for seed in range(60):
        moved = arrays.mix(key + np.uint64(1000 * seed)) & near_dup._KEY_MASK
        order = np.argsort(moved)
        one, _ = near_dup._sketch(moved[order], a[order], 1)
        two, _ = near_dup._sketch(moved[order], b[order], 1)
        agreed.append((one == two).mean())
    assert np.mean(agreed) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.02)


def test_near_duplicates_match_brute_force(spark, texts):
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    n, parent = len(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    df = collections.Counter(s for t in texts for s in shingle_counts(t))
    weight = lambda s: 1.0 if df[s] <= near_dup.COMMON * n else 0.5 + 0.5 * np.log(n / df[s]) / np.log(1 / near_dup.COMMON)
    counts = [{s: k * weight(s) for s, k in shingle_counts(t).items()} for t in texts]
    for a in range(n):
        for b in range(a):
            least = sum(min(w, counts[b][s]) for s, w in counts[a].items() if s in counts[b])
            union = sum(counts[a].values()) + sum(counts[b].values()) - least
            if texts[a] == texts[b] or (union and least / union >= 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert found == {k: root(k) for k in range(n)}


def test_frequent_shingles(spark, texts):
    from panelspark.llm.tasks import ship_functions

    ship_functions(spark)
    shingle, idf = near_dup.frequent_shingles(frame(spark, texts).select("text"))
    df = collections.Counter(s for t in texts for s in shingle_counts(t))
    wanted = [c for c in df.values() if c > near_dup.COMMON * len(texts)]
    assert len(shingle) == len(wanted) > 0 and (np.diff(shingle.astype(float)) > 0).all()
    assert sorted(idf) == pytest.approx(sorted(0.5 + 0.5 * np.log(len(texts) / c) / np.log(20) for c in wanted))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).collect() == []


def test_keep_one(spark, texts):
    docs = frame(spark, texts)
    classes = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in near_dup.keep_one(docs).collect()) == sorted(set(classes.values()))


def test_fingerprints(spark, texts):
    found = {r.doc_id: r for r in fingerprints.compare_edited(frame(spark, texts)).collect()}
    n = len(texts)
    for k, text in enumerate(texts):
        after = texts[(k - 1) % n]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        row = found[k]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(shingle_counts(t)) for t in (text, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert row.near_edited == pytest.approx(like(a, b), abs=0.2) and row.near_next == pytest.approx(like(a, c), abs=0.2)
        assert row.shingles == pytest.approx(len(a), rel=0.5)
        assert (row.fingerprint == found[0].fingerprint) == (text == texts[0])


def test_merged_fingerprints(spark, texts):
    prints = fingerprints.fingerprints(frame(spark, texts)).selectExpr("doc_id % 3 AS part", "fingerprint")
    for row in fingerprints.merged(prints, "part").collect():
        made = fingerprints.sketches(pa.array([t for k, t in enumerate(texts) if k % 3 == row.part]))
        union = np.zeros(0, np.uint64)
        for sketch in made:
            union = fingerprints.merge(union, sketch)
        assert fingerprints.decode(row.fingerprint).tolist() == union.tolist()
    assert fingerprints.containment(made[0], fingerprints.merge(made[0], made[1])) > 0.7


@pytest.mark.parametrize("window", [35, 5])
def test_repeats_match_brute_force(spark, texts, window):
    rng = random.Random(8)
    docs = [*texts, "z " * 100, sentence(rng, 3_000, 3), None]
    split = [(t or "").split() for t in docs]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, docs), window).collect()}
    assert len(found) == len(docs)
    for k, w in enumerate(split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        row = found[k]
        assert (row.n_words, row.n_removed) == (len(w), sum(gone))
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        marked = [False] * len(w)
        for a, b in zip(row.repeat_begin, row.repeat_end, strict=True):
            assert b - a >= window
            marked[a:b] = [True] * (b - a)
        assert marked == gone


def test_words_and_shingles():
    data, begin, end = arrays.flat(pa.array(["a b  c\td", None, "", " y\n", "é ü"]).slice(0, 5))
    found = arrays.words(data, begin, end)
    assert [(int(d), bytes(data[a:b])) for d, a, b in zip(*found, strict=True)] == [
        (0, b"a"), (0, b"b"), (0, b"c"), (0, b"d"), (3, b"y"), (4, "é".encode()), (4, "ü".encode()),
    ]
    one = arrays.shingles(pa.array(["x a b c d e", "", "a b c d e y"]), 5)[1]
    assert one[1] == one[2] and len({*one.tolist()}) == 3


def test_many_rows_without_id(spark):
    """5,000 rows without id do not share their lists of seeds."""
    rng = random.Random(8)
    passage = sentence(rng, 40)
    docs = [(None, f"{sentence(rng, 20)} {passage if k % 3 == 0 else sentence(rng, 40)} end{k}", "en", "a", None) for k in range(5_000)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(found) == 5_000 and all(r.doc_id is None for r in found)
    gone = [r.n_removed for r in found if r.n_removed]
    assert len(gone) == len(range(0, 5_000, 3)) and min(gone) == 40


def test_recall_against_all_pairs(spark):
    """Queries are the ids divisible by 50, against all rows: links of 0.8 and more, and those of 0.80 to 0.85 on their own."""
    rng = random.Random(50)
    docs = {}
    for k in range(1_500):
        if k % 50 == 0:
            base = sentence(rng, 150, 3_000).split()
        elif k % 50 <= 12:
            at, edits = rng.randrange(5, 130), k % 50  # so many words in a row are others: 0.93 to 0.80
            docs[k] = " ".join([*base[:at], *(f"edit{k}x{j}" for j in range(edits)), *base[at + edits :]])
            continue
        docs[k] = " ".join(base) if k % 50 == 0 else sentence(rng, 150, 3_000)
    classes = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame([(k, t, "en", "a", None) for k, t in docs.items()], SCHEMA)).collect()}
    counts = {k: shingle_counts(t) for k, t in docs.items()}
    links = []
    for a in range(0, 1_500, 50):
        for b in docs:
            both = sum((counts[a] & counts[b]).values())
            similar = both / (sum(counts[a].values()) + sum(counts[b].values()) - both)
            if a != b and similar >= 0.8:
                links.append((similar, classes[a] == classes[b]))
    low = [found for similar, found in links if similar <= 0.85]
    assert len(links) >= 300 and len(low) >= 100
    assert sum(found for _, found in links) >= 0.99 * len(links) and sum(low) >= 0.98 * len(low)
