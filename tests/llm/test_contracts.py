"""Every operator on nulls, odd texts, repeated rows, no rows and clashing columns."""

import pytest

from panelspark.llm import (
    adaptive_rules, decontamination, fingerprints, license_scan, mixing, near_dup, periodic_runs, pieces, pseudonyms, quality_gam,
    substring_dedup, toxicity,
)
from pyspark.sql import functions as F

from llm_samples import CLASHES, SCHEMA, table


@pytest.fixture(scope="session")
def gam(odd, labels):
    return quality_gam.train(odd, labels, "quality", F.lit(True))


@pytest.fixture(scope="session")
def toxic(odd, labels):
    return toxicity.train(odd, labels, F.lit(True))


OPERATORS = {
    "toxicity": lambda d, m: toxicity.with_score(d, m["toxic"], "p").select("doc_id", "p"),
    "fingerprints": lambda d, m: fingerprints.compare_edited(d),
    "fingerprint_only": lambda d, m: fingerprints.fingerprints(d),
    "mixing": lambda d, m: mixing.expected_copies(d),
    "quality": lambda d, m: quality_gam.with_score(d, m["gam"], "p").select("doc_id", "p"),
    "licenses": lambda d, m: license_scan.scan(d),
    "near_duplicates": lambda d, m: near_dup.near_duplicates(d),
    "pieces": lambda d, m: pieces.round_trip(d),
    "rules": lambda d, m: adaptive_rules.judge(d),
    "pseudonyms": lambda d, m: pseudonyms.with_findings(d),
    "leaks": lambda d, m: decontamination.find_leaks(d, m["items"]),
    "leaks_without_items": lambda d, m: decontamination.find_leaks(d, m["items"].limit(0)),
    "periodic_runs": lambda d, m: periodic_runs.digest(periodic_runs.find_runs(periodic_runs.plant(d))),
    "substrings": lambda d, m: substring_dedup.remove_repeats(d),
}


@pytest.fixture(scope="session")
def models(gam, toxic, odd, spark):
    words = odd.where("doc_id = 1").first().text.split()
    items = [(1, " ".join(words[5:30])), (1, "same line"), (2, None), (3, " "), (None, "two"), (4, "no such words here")]
    return {"gam": gam, "toxic": toxic, "items": spark.createDataFrame(items, "item_id BIGINT, text STRING")}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, crowded, none, models):
    run = OPERATORS[name]
    found = run(odd, models)
    rows = table(found, "*")
    ids = sorted((r.doc_id for r in odd.collect()), key=repr)
    assert sorted((r.doc_id for r in found.collect()), key=repr) == ids  # a row for each row, repeated ones too
    assert table(run(crowded, models).select(*found.columns), "*") == rows
    assert run(none, models).collect() == [] and run(none, models).columns == found.columns


KEEPING = {
    "near_duplicates": lambda d: near_dup.keep_one(d),
    "mixing": lambda d: mixing.mix_documents(d),
    "pseudonyms": lambda d: pseudonyms.pseudonymise(d),
}


@pytest.mark.parametrize("name", KEEPING)
def test_stages_keep_all_columns(name, odd, crowded, none):
    run = KEEPING[name]
    quoted = ["`" + c.replace("`", "``") + "`" for c in odd.columns]
    wide = run(crowded)
    assert wide.columns == crowded.columns and run(odd).columns == odd.columns
    assert table(wide, *quoted) == table(run(odd), *quoted)
    assert {tuple(r[k] for k in CLASHES) for r in wide.collect()} <= {tuple(range(len(CLASHES)))}
    assert run(none).collect() == []


def test_models_without_labels(odd, none, spark):
    no_labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    model = quality_gam.train(odd, no_labels, "quality", F.lit(True))
    assert {r.score for r in quality_gam.with_score(odd, model).collect()} == {0.5}
    model = toxicity.train(odd, no_labels, F.lit(True))
    assert {r.score for r in toxicity.with_score(odd, model).collect()} == {0.5}
    toxicity.train(none, no_labels, F.lit(True))


def test_one_row(spark, models):
    one = spark.createDataFrame([(1, "only one text", "en", "a", 13)], SCHEMA)
    for run in OPERATORS.values():
        assert run(one, models).count() == 1
