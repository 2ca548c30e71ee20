"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from llm_samples import SCHEMA, sentence

import corpus_pipeline
from panelspark.llm import queries

SF_DIR = os.environ.get("SAMPLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")

SQL = queries.all_sql()


def test_one_query_per_operator():
    assert [name.split("_")[0] for name in queries.all_queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(SQL) == {"op3_mixing", "op8_adaptive_rules", "op10_substring_dedup", "op11_spelling_variants", "op12_decontamination"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{SF_DIR}/{name_of}.parquet'")
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    expected = sorted(map(plain, result.fetchall()), key=repr)
    df = queries.all_queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted((plain(r) for r in df.select(*names).collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["op2_fingerprints", "op5_license_scan", "op6_near_duplicates", "op7_pieces", "op9_pseudonyms"])
def test_a_row_per_document(spark, name):
    df = queries.all_queries()[name](spark, SF_DIR)
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pseudonyms", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF_DIR)
        if k < 4:
            assert after.columns == columns
        before = spark.createDataFrame(after.toPandas(), after.schema)
    rows = before.collect()
    assert rows and all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Nulls, repeated rows and no rows go through all stages."""
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in (("odd", odd), ("none", none)):
        folder = tmp_path / name
        folder.mkdir()
        os.symlink(tmp_path / "labels.parquet", folder / "labels.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns[0] == "doc_id" and (out.count() > 0 or name == "none")


def test_near_duplicate_stage_keeps_one_of_each_class(spark):
    import random

    rng = random.Random(1)
    texts = [sentence(rng, 80) for _ in range(5)]
    rows = [(10 * k + j, t + (f" end{j}" if j else ""), "en", "s", None) for k, t in enumerate(texts) for j in range(4)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF_DIR)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40]
