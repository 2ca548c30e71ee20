import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import ranking, sparsity


def test_percent_rank(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, int(rng.paretovariate(0.7))) for i in range(800)], "id INT, stars BIGINT")
    histogram = df.groupBy("stars").agg(F.count("*").alias("n"))
    ours = df.join(ranking.count_percent_rank(histogram, "stars", "r"), "stars")
    both = ours.withColumn("e", F.percent_rank().over(Window.orderBy("stars")))
    assert both.where("r <> e").count() == 0
    one = spark.createDataFrame([(5, 1)], "stars BIGINT, n BIGINT")
    assert ranking.count_percent_rank(one, "stars", "r").first().r == 0.0


def test_running_total_over_ranges(spark):
    """No task sees all rows, and every range starts where the one before ended."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(3 * k, k % 5) for k in range(1000)], "v BIGINT, n BIGINT").repartition(3)
        placed, total = ranking.running_total(df, "v", "n", "below")
        assert total == sum(k % 5 for k in range(1000))
        found = {r.v: r.below for r in placed.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert found == {3 * k: sum(j % 5 for j in range(k)) for k in range(1000)}
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    nothing, total = ranking.running_total(df.limit(0), "v", "n", "below")
    assert nothing.collect() == [] and total == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 500])
def test_ntile(spark, size):
    rng = random.Random(size)
    data = [("m" if i % 4 else "k", f"id{i}", rng.choice([0.0, 0.25, 0.5, 1.0, 1.0, 1.0])) for i in range(size)]
    df = spark.createDataFrame(data, "metric STRING, uid STRING, rate DOUBLE")
    w = Window.partitionBy("metric").orderBy("rate", F.md5(F.col("uid").cast("binary")), "uid")
    both = ranking.exact_ntile(df, 3, "metric", "rate", "uid", "t").withColumn("e", F.ntile(3).over(w))
    assert both.count() == size
    assert both.where("t <> e").count() == 0


def test_percentiles(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        group = "hot" if i % 3 else f"g{i % 40}"  # one group holds two thirds of the rows
        value = rng.choice([0.0, 1.5, None, rng.gauss(0, 100), rng.random() * 1e-9, -2.0, rng.expovariate(1)])
        data.append((group, None if i % 7 == 0 else "b", value))
    df = spark.createDataFrame(data, "g STRING, k STRING, v DOUBLE")
    probs = {"p10": 0.1, "med": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    ours = ranking.grouped_percentiles(df, ["g", "k"], "v", probs, {"pos": 0.1}).collect()
    expected = df.where("v IS NOT NULL").groupBy("g", "k").agg(
        *[F.percentile("v", p).alias(n) for n, p in probs.items()],
        F.percentile(F.when(F.col("v") > 0, F.col("v")), 0.1).alias("pos"),
    ).collect()
    expected = {(r.g, r.k): r for r in expected}
    assert len(ours) == len(expected)
    for r in ours:
        for name in [*probs, "pos"]:
            value = expected[r.g, r.k][name]
            assert r[name] == (value if value is None else pytest.approx(value, rel=1e-12, abs=1e-300))


def test_percentiles_of_close_values(spark):
    """All values in one magnitude bucket, some equal, and groups without positives."""
    df = spark.range(5000).selectExpr("'a' AS g", "1000 + id % 700 * 1e-7 AS v")
    df = df.unionByName(spark.range(9).selectExpr("'b' AS g", "-id * 1.0D AS v"))
    found = {r.g: r for r in ranking.grouped_percentiles(df, ["g"], "v", {"p": 0.37}, {"pos": 0.5}).collect()}
    expected = {r.g: r for r in df.groupBy("g").agg(F.percentile("v", 0.37).alias("p"), F.median("v").alias("m")).collect()}
    assert found["a"].p == pytest.approx(expected["a"].p, rel=1e-14) and found["a"].pos == pytest.approx(expected["a"].m, rel=1e-14)
    assert found["b"].p == expected["b"].p and found["b"].pos is None


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 5.0, float("nan")], [1.0, 2.0, 5.0, float("inf")], [float("-inf"), 1.0, 2.0, float("inf"), float("inf")],
    [float("nan")] * 3, [float("-inf"), float("-inf"), 0.0, -0.0, 1e-320, 1e308], [7.0],
])
def test_percentiles_of_special_values(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g STRING, v DOUBLE")
    probs = {f"p{k}": k / 10 for k in range(11)}
    found = ranking.grouped_percentiles(df, ["g"], "v", probs, {"pos": 0.5}).first()
    expected = df.groupBy("g").agg(
        *[F.percentile("v", p).alias(n) for n, p in probs.items()], F.percentile(F.when(F.col("v") > 0, F.col("v")), 0.5).alias("pos")
    ).first()
    for name in [*probs, "pos"]:
        assert found[name] == expected[name] or pytest.approx(expected[name], nan_ok=True) == found[name], name


def test_top_per_group_limits_before_shuffle(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    top = ranking.top_per_group(df, "g", [F.col("id")], {"a": 5, "b": 2})
    assert sorted((r.g, r.id) for r in top.collect()) == [("a", i) for i in (0, 3, 6, 9, 12)] + [("b", 1), ("b", 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sparsity(spark):
    data = []
    for i in range(12):
        for d in range(10):
            data.append((f"{i}:stars", "stars", 0 if d < min(i, 8) else 1))
    df = spark.createDataFrame(data, "unique_id STRING, metric STRING, y BIGINT")
    found = {r.unique_id: r for r in sparsity.series_sparsity(df).collect()}
    assert (found["3:stars"].n_obs, found["3:stars"].n_zero, found["3:stars"].zero_rate) == (10, 3, 0.3)
    levels = [found[f"{i}:stars"].sparsity_level for i in range(8)]
    assert levels == ["low"] * 4 + ["medium"] * 4
    assert sum(r.sparsity_level == "high" for r in found.values()) == 4
