"""Mixing, licence scan and adaptive rules."""

import collections
import re

import pytest
from llm_samples import SCHEMA, sentence

from panelspark.llm import adaptive_rules, license_scan, mixing


# --- mixing -------------------------------------------------------------------------


def targets(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > 3 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= set(over)
    return out


@pytest.fixture(scope="module")
def sources(spark):
    import random

    rng = random.Random(4)
    rows = []
    for k, (source, count) in enumerate([("a", 400), ("b", 10), ("ä", 60), (None, 80), ("c", 3), ("d", 30), ("empty", 5)]):
        for i in range(count):
            words = 0 if source == "empty" else rng.randrange(1, 60)
            rows.append((1000 * k + i, sentence(rng, words), "en", source, None))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_mix_targets(sources):
    rows, docs = sources
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    found = mixing.expected_copies(docs).collect()
    wanted, taken = targets(sizes), collections.Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 120  # two of the largest documents
    assert found == mixing.expected_copies(docs).collect() or sorted(found) == sorted(mixing.expected_copies(docs).collect())


def test_mixed_documents_repeat(sources):
    _, docs = sources
    copies = {r.doc_id: r.copies for r in mixing.expected_copies(docs).collect()}
    mixed = collections.Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    assert mixed == {k: n for k, n in copies.items() if n}


def test_size_classes_keep_the_order(spark):
    sizes = [*range(2_000), 10**6, 10**9]
    df = spark.createDataFrame([(s,) for s in sizes], "size BIGINT")
    found = [r[0] for r in df.orderBy("size").select(mixing.size_class(df["size"])).collect()]
    assert found == sorted(found) and found[:64] == list(range(64))


# --- licences -----------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shortest(pattern):
    """A text that the pattern matches: first choices, least repeats."""
    from re import _constants as kind, _parser

    def spell(tokens):
        out = ""
        for what, value in tokens:
            if what is kind.LITERAL:
                out += chr(value)
            elif what is kind.SUBPATTERN:
                out += spell(value[-1])
            elif what is kind.BRANCH:
                out += spell(value[1][0])
            elif what is kind.MAX_REPEAT:
                out += spell(value[2]) * value[0]
            elif what is kind.IN:
                out += chr(value[0][1] if value[0][0] is kind.LITERAL else value[0][1][0])
            else:
                raise AssertionError(what)
        return out

    return spell(_parser.parse(pattern))


def test_rules_are_many_and_distinct():
    found = license_scan.rules()
    assert len(found) > 300 and len({(r.label, r.pattern) for r in found}) == len(found)
    for r in found:
        text = f" {shortest(r.pattern)} "
        assert re.search(r.pattern, text) and f" {r.keyword} " in text
        assert re.search(license_scan._GATE, text), text


def test_rights_statements(spark):
    cases = {"No rights reserved.": "no-rights-reserved", "some rights reserved": "some-rights-reserved", "All Rights Reserved": "reserved"}
    assert [r.labels for r in scan(spark, *cases)] == list(cases.values())


def scan(spark, *texts):
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    return sorted(license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.doc_id)


def test_base_phrases_match_brute_force(spark):
    texts = [
        "CC-BY cc by, cc/by; ccby cc by-sa", "GNU General Public License v3. general public LICENSE", "All rights reserved. all rights  reserved",
        "", None, "İ cc by İ", "é" * 50 + " all rights reservedé all rights reserved", "by cc", "x" * 3_000,
    ]
    for row, text in zip(scan(spark, *texts), texts, strict=True):
        words = plain_words(text)
        places = sorted(
            (i, i + len(p.split()), label)
            for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        )
        assert row.n_words == len(words) and sorted(map(tuple, row.base)) == places
        assert row.base_labels == ",".join(sorted({p[2] for p in places}))


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("distributed under the terms of the GNU Lesser General Public License version 2.1 or later", "lgpl-2.1"),
        ("SPDX-License-Identifier: MPL-2.0", "spdx:mpl-2-0"),
        ("made available under CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
        ("Creative Commons Attribution 3.0", "cc-by-3.0"),
        ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ],
)
def test_signatures(spark, text, label):
    row = scan(spark, "a b c " + text + " d e f")[0]
    assert label in row.labels.split(",") and row.score >= 0.7


def test_contained_detections_are_suppressed(spark):
    row = scan(spark, "licensed under the apache license version 2.0 and the mit license")[0]
    assert [(d.begin, d.end, d.label) for d in row.detections] == [(0, 8, "apache-2.0"), (9, 12, "mit")]
    assert scan(spark, "wir sind mit der Lizenz; the mit and the bsd")[0].detections == []


def test_suppression_matches_brute_force(spark):
    R = license_scan.Rule
    table = [R("long", "license", "license a b c", 1, 0.1), R("mid", "license", "a b", 2, 0.2), R("same", "license", "b c", 1, 0.3), R("top", "license", "b", 9, 0.4)]
    docs = spark.createDataFrame([(1, "license a b c b c", "en", "s", None)], SCHEMA)
    kept = [(d.begin, d.end, d.label) for d in license_scan.scan(docs, table).first().detections]
    places = [(0, 4, 1, "long"), (1, 3, 2, "mid"), (2, 4, 1, "same"), (2, 3, 9, "top"), (4, 6, 1, "same"), (4, 5, 9, "top")]
    inside = lambda x, y: x != y and y[0] <= x[0] and x[1] <= y[1] and y[2] >= x[2]
    assert kept == [(a, b, label) for a, b, p, label in places if not any(inside((a, b, p, label), y) for y in places)]


# --- rules --------------------------------------------------------------------------


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark, odd_rows):
    import random

    rng = random.Random(6)
    texts = [r[1] for r in odd_rows] + [sentence(rng, 300, 2), "a b c d e f g h " * 3, "\x1c a\x85b \x0b\n \n a", "<>|&% $$$ 🎉", "l1\nl2\nl1\n\n\nl1 "]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in enumerate(texts)], SCHEMA)
    for r in adaptive_rules.measures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id])


def test_glued_licence_names(spark):
    cases = {
        "licensed under GPLv3": "gpl-3", "GPLv2+": "gpl-2", "LGPLv2.1": "lgpl-2.1", "code is Apache2": "apache-2", "under Apache2.0 here": "apache-2.0",
        "AGPLv3 or later": "agpl-3", "released under the GNU GPL3 license": "gpl-3", "MPLv2.0": "mpl-2.0", "EUPLv1.2": "eupl-1.2", "gplv9 apache22": "",
    }
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in enumerate(cases)], SCHEMA)
    found = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert [found[k] for k in range(len(cases))] == list(cases.values())


def test_fences_follow_the_group(spark):
    """What is usual in one source is out of line in another."""
    import random

    rng = random.Random(7)
    rows = [(k, sentence(rng, 50), "en", "prose", None) for k in range(200)]
    code = lambda: " ".join(f"##{rng.randrange(400):02d}" for _ in range(50))
    rows += [(1000 + k, code(), "en", "code", None) for k in range(200)]
    rows += [(5000, code(), "en", "prose", None), (5001, " ".join("#" * 12 + f"{rng.randrange(400)}" for _ in range(50)), "en", "code", None)]
    found = {r.doc_id: r for r in adaptive_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[k].kept for k in [*range(200), *range(1000, 1200)])
    assert not any(found[k].base_failed for k in found)
    assert "symbol_share" in found[5000].reasons and not found[5000].kept
    assert "symbol_share" in found[5001].reasons and not found[5001].kept


def test_sketches_merge(spark, odd):
    """Adding the counts of two parts gives the sketch of the whole."""
    from pyspark.sql import functions as F

    values = adaptive_rules.measures(odd).withColumns(adaptive_rules._values())
    keys = ["lang", "source", "measure", "class"]
    halves = [adaptive_rules.sketch(values.where(test)) for test in ("n_words < 100", "n_words >= 100")]
    merged = halves[0].unionAll(halves[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, adaptive_rules.sketch(values).select(*keys, "n").collect()))
