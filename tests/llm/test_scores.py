"""Quality and toxicity: the model parts, and held-out accuracy on the sample tables."""

import collections
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_samples import sentence
from pyspark.sql import functions as F

from panelspark.llm import arrays, quality_gam, toxicity

SF_DIR = os.environ.get("SAMPLE_DIR", "/root/testdata/sf0.01")


def test_tree_is_the_best_cut():
    rng = np.random.default_rng(0)
    g, c = rng.normal(size=12), rng.uniform(0.5, 1, 12)
    values = quality_gam._tree(g, c, 2)
    gains = [g[:k].sum() ** 2 / (c[:k].sum() + 5) + g[k:].sum() ** 2 / (c[k:].sum() + 5) for k in range(1, 12)]
    k = int(np.argmax(gains)) + 1
    assert values[:k] == pytest.approx(g[:k].sum() / (c[:k].sum() + 5)) and values[k:] == pytest.approx(g[k:].sum() / (c[k:].sum() + 5))


def test_model_learns_steps_and_interactions():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(6_000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature helps alone
    model = quality_gam.fit(x[:4_000], y[:4_000])
    assert ((quality_gam.score(model, x[4_000:]) >= 0.5) == y[4_000:]).mean() > 0.95
    y = (x[:, 2] > 0.3).astype(float)
    model = quality_gam.fit(x[:4_000], y[:4_000])
    assert ((quality_gam.score(model, x[4_000:]) >= 0.5) == y[4_000:]).mean() > 0.98


def test_features_match_brute_force():
    texts = ["a a a b | #x 1 É\nA!", "", None, "w " * 50, sentence(random.Random(1), 200)]
    found = quality_gam.features(pa.array(texts))
    for text, row in zip(texts, found, strict=True):
        words, raw = (text or "").split(), (text or "").encode()
        value = dict(zip(quality_gam.FEATURES, row, strict=True))
        assert value["words"] == pytest.approx(np.log1p(len(words)))
        assert value["distinct_words"] == pytest.approx(len(set(words)) / max(1, len(words)))
        assert value["pipes"] == pytest.approx(raw.count(b"|") / max(1, len(raw)))
        pairs = list(zip(words[:-1], words[1:], strict=True))
        assert value["repeated_pairs"] == pytest.approx(1 - len(set(pairs)) / len(pairs) if pairs else 0)
        assert value["top_word"] == pytest.approx(max([words.count(w) for w in words], default=0) / max(1, len(words)))


@pytest.fixture(scope="module")
def language(spark):
    rng = random.Random(9)
    vocabulary = ["stupid", "idiot", "trash", "loser", "moron", "hello", "hill", "book", "tree", "apple", "banana", "spoon"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=80))) for k in range(60)]
    return toxicity.language_model(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))


@pytest.mark.parametrize(
    ("token", "plain"),
    [
        ("1d10t", "idiot"), ("tr@sh", "trash"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("s t u p i d", "stupid"), ("m0r0n", "moron"),
        ("iiiidiot", "idiot"), ("trrrrash", "trash"), ("hello", "hello"), ("b@n@n@", "banana"), ("l o s e r", "loser"), ("h3llo", "hello"),
    ],
)
def test_disguises_are_undone(language, token, plain):
    assert toxicity.restore(token, language) == plain


def test_viterbi_finds_the_best_path(language):
    """Against all paths of the lattice."""

    def paths(text):
        def walk(i):
            if i == len(text):
                yield "", 0.0
                return
            for used, letters, cost in toxicity._edges(text, i):
                for rest, more in walk(i + used):
                    yield letters + rest, cost + more

        return walk(0)

    def score(reading, cost):
        context, total = b" ", cost
        for byte in reading.encode():
            if byte == 32 and context[-1:] == b" ":
                continue
            total += language.log_p(context, byte)
            context = (context + bytes([byte]))[-3:]
        return total + (0.0 if context[-1:] == b" " else language.log_p(context, 32))

    for text in ["1d10t", "tr@sh", "h3ll0", "l.o", "aabb1", "s+up1d"]:
        best = max(score(*p) for p in paths(text))
        made = toxicity.restore(text, language)
        assert any(" ".join(r.split()) == made and score(r, c) == pytest.approx(best) for r, c in paths(text))


def test_language_model_counts_all_text(spark):
    rows = [(1, "ab ab"), (2, "AB"), (3, None), (4, "a-b")]
    found = toxicity.language_model(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).counts
    assert found[0][ord("a")] == 4 and found[1][(ord("a") << 8) | ord("b")] == 3
    assert toxicity.Language(found).log_p(b" ", ord("a")) > toxicity.Language(found).log_p(b" ", ord("z"))


def test_language_model_is_exact(spark):
    """Against counts of all n-grams; no cell is shared, so nothing is likelier than its context."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéßжд ", k=rng.randrange(4000))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").coalesce(1)
    stream = b" " + b" ".join(t.encode() for t in texts) + b" "
    stream = b" " + b" ".join(stream.split()) + b" "
    found = toxicity.language_model(docs)
    for n in (1, 2, 3, 4):
        want = collections.Counter(stream[i : i + n] for i in range(len(stream) - n + 1))
        assert n < 4 or len(want) > 40_000
        for gram in want:
            assert found._seen(gram) == want[gram]
        assert n < 4 or found._seen(b"\xff" * n) == 0
        assert n == 1 or all(found._seen(g) <= found._seen(g[:-1]) for g in want)


def test_clear_text_stays(language):
    restorer = toxicity.Restorer(language)
    texts = ["hello tree, the book. 12 of 30 apples!", "call +1 (446) 555-8962", "%%% the### of$$$", "", None, "É été ÉTÉ"]
    assert toxicity.restored_texts(pa.array(texts), restorer) == [t or "" for t in texts]
    assert toxicity.restored_texts(pa.array(["you 1d10t, s t u p i d tree"]), restorer)[0] == "you idiot stupid tree"


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("you i d i o t. tree", "idiot"), ("you s  t  u  p  i  d tree", "stupid"), ("you iiddiioott tree", "idiot"), ("you stUuUpid tree", "stupid"),
        ("l/o/s/e/r", "loser"), ("£oser tree", "loser"),
    ],
)
def test_all_disguises_reach_the_lattice(language, text, plain):
    made = toxicity.restored_texts(pa.array([text]), toxicity.Restorer(language))[0]
    assert plain in made.split()


@pytest.mark.parametrize("span", ["a s s", "f u", "d a m n.", "i\td\n i", "shi+", "shi|.", "id!ot", "€vil", "bb££uu", "a$$.", "aAa", "b:a:d"])
def test_gate_takes_the_span(span):
    data, begin, end = arrays.flat(pa.array([f"so {span} ok"]))
    doc, first, last = toxicity.disguised(data, arrays.words(data, begin, end))
    assert [data[a:b].tobytes().decode() for a, b in zip(first, last, strict=True)] == [span]


def test_restored_words(language):
    data, _, found = toxicity.restored_words(pa.array(["you 1d10t x", "ÉTÉ s t u p i d", None]), toxicity.Restorer(language))
    words = sorted((int(d), bytes(data[a:b]).decode()) for d, a, b in zip(*found, strict=True))
    assert words == [(0, "idiot"), (0, "x"), (0, "you"), (1, "stupid"), (1, "été")]


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"))
    return (rank[label].mean() - (label.sum() - 1) / 2) / max(1, (~label).sum())


def held_out(spark, name, column, folds, fold):
    from panelspark.llm import queries

    found = queries.all_queries()[name](spark, SF_DIR).toPandas()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    assert len(found) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert [zlib.crc32(str(i).encode()) % folds == fold for i in found.doc_id] == found.held_out.tolist()
    assert ((found.score >= 0.5).astype(int) == found.predicted).all() and found.score.between(0, 1).all()
    both = found[found.held_out].merge(labels, on="doc_id")
    return both.score.to_numpy(), both[column].to_numpy() > 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")
def test_quality_on_held_out_labels(spark):
    score, label = held_out(spark, "op4_quality_gam", "quality", 3, 1)
    assert auc(score, label) > 0.98 and ((score >= 0.5) == label).mean() > 0.97


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")
def test_toxicity_on_held_out_labels(spark):
    score, label = held_out(spark, "op1_toxicity", "toxic", 5, 0)
    assert ((score >= 0.5) == label).mean() > 0.9


def test_labels_of_the_held_out_fold_change_nothing(spark, odd, labels):
    fold = quality_gam.folds(F.col("doc_id"), 3) == 1
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [
        sorted(r.score for r in quality_gam.with_score(odd, quality_gam.train(odd, table, "quality", ~fold)).collect()) for table in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_least_shingle():
    found = toxicity.least_shingles(pa.array(["a b c d e f", "a b c d e", "", None]))
    assert found[2] == found[3] == 0
    assert found[0].view(np.uint64) == min(arrays.shingles(pa.array(["a b c d e f"]), 5)[1])
