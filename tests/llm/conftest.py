import random

import pytest

from llm_samples import CLASHES, SCHEMA, sentence


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and long texts, repeated rows and ids, copies and near copies."""
    rng = random.Random(5)
    base, other = sentence(rng, 120), sentence(rng, 90)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "de", "b"),
        (4, None, "en", "a"), (5, "", None, "b"), (6, "  \n\t ", "en", None), (None, other, "fr", "c"), (None, None, None, None),
        (7, "one two", "en", "c"), (7, "three four five", "en", "c"), (8, sentence(rng, 30_000, 5_000), "en", "a"),
        (9, "\n".join(["same line here"] * 40), "es", "c"), (10, "x" * 5_000, "en", "a"), (11, "naïve 日本語 🎉 ▁ text\r\nend", "en", "b"),
        (12, other + " " + base, "en", "b"),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """A documents table without rows."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(odd):
    """The odd rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return odd.withColumns({name: F.lit(k) for k, name in enumerate(CLASHES)})


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(r[0], (r[0] or 0) % 2, (r[0] or 0) % 3 % 2) for r in odd_rows] + [(1, 0, 1), (99, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id BIGINT, quality INT, toxic INT")

