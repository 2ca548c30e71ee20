import datetime as dt
import random

import xxhash
from helpers import rows, utc
from pyspark.sql import functions as F

from panelspark.functions import hashing
from panelspark.operators import entities as ent


def test_xxh64_vectors(spark):
    texts = ["", "a", "abc", "1234:v0.1.0", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    found = {r.t: r.h & (2**64 - 1) for r in df.select("t", hashing.xxh64(F.col("t")).alias("h")).collect()}
    assert found == {t: xxhash.xxh64_intdigest(t) for t in texts}
    # Public XXH64 test vectors for seed 0.
    assert (found[""], found["a"], found["abc"]) == (0xEF46DB3751D8E999, 0xD24EC4F1A98C6E5B, 0x44BC2CF5AD770999)
    ordered = [r.t for r in df.orderBy(hashing.xxh64_order(F.col("t"))).collect()]
    assert ordered == sorted(texts, key=xxhash.xxh64_intdigest)


def fake_raw(spark, repos=400):
    rng = random.Random(5)
    data = []
    for repo in range(repos):
        months = range(1, 13) if repo % 5 else range(1, 12)  # every fifth misses December
        stars = int(rng.paretovariate(0.8))
        for m in months:
            data.append((repo, f"n{repo}" + ("z" if m > 6 else ""), "PushEvent", None, f"2025-{m:02d}-10T01:00:00Z", 2025))
        data += [(repo, f"n{repo}", "WatchEvent", None, "2025-08-01T00:00:00Z", 2025)] * min(stars, 60)
    data.append((0, "old", "PushEvent", None, "2024-12-31T00:00:00Z", 2024))
    data.append((None, "x", "PushEvent", None, "2025-01-01T00:00:00Z", 2025))
    data.append((7, None, "PushEvent", None, "2025-01-01T00:00:00Z", 2025))
    schema = "repo_id BIGINT, repo_name STRING, event_type STRING, action STRING, created_at STRING, year INT"
    return spark.createDataFrame(data, schema), data


def test_selection(spark):
    raw, data = fake_raw(spark)
    sizes = {"large": 6, "medium": 4, "low": 5}
    found = ent.select_entities(raw, 2025, top_share=0.3, sizes=sizes).collect()

    stats = {}
    for repo, name, kind, _, at, year in data:
        if repo is None or name is None or year != 2025:
            continue
        s = stats.setdefault(repo, {"name": "", "stars": 0, "total": 0, "months": set()})
        s["name"] = max(s["name"], name)
        s["stars"] += kind == "WatchEvent"
        s["total"] += 1
        if at >= "2025-07-01":
            s["months"].add(at[:7])
    good = {r: s for r, s in stats.items() if len(s["months"]) == 6 and s["stars"] > 0}

    def ranks(values):
        values = list(values)
        return {v: sum(x < v for x in values) / (len(values) - 1) for v in set(values)}

    rank_all = ranks(s["stars"] for s in good.values())
    upper = {r: s for r, s in good.items() if rank_all[s["stars"]] >= 0.3}
    rank_up = ranks(s["stars"] for s in upper.values())
    buckets = {}
    for repo, s in upper.items():
        p = rank_up[s["stars"]]
        name = "low" if p < 0.2 else "medium" if 0.4 <= p < 0.6 else "large" if p >= 0.9 else None
        if name:
            buckets.setdefault(name, []).append(repo)
    expected = set()
    for name, members in buckets.items():
        members.sort(key=lambda r: xxhash.xxh64_intdigest(f"{r}:v0.1.0"))
        expected |= {(r, name) for r in members[: sizes[name]]}
    assert {(r.repo_id, r.size_bucket) for r in found} == expected
    for r in found:
        s = stats[r.repo_id]
        assert (r.repo_name, r.stars, r.total_events, r.active_units) == (s["name"], s["stars"], s["total"], 6)
        assert r.star_prank_all == rank_all[s["stars"]] and r.star_prank_upper == rank_up[s["stars"]]


def test_active_units_beyond_a_long(spark):
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=d) for d in (0, 1, 1, 80, 99, 100)]
    df = spark.createDataFrame([(1, utc(str(d))) for d in days], "repo_id INT, ts TIMESTAMP")
    start, end = utc("2025-01-01"), utc("2025-04-11")  # 100 days: the last date is outside
    for unit, expected in (("day", 4), ("week", 3), ("month", 3)):
        words = ent.active_words(F.col("ts"), unit, start, end)
        found = df.groupBy("repo_id").agg(*words)
        names = [c for c in found.columns if c != "repo_id"]
        assert len(names) == (2 if unit == "day" else 1)
        assert found.select(ent.active_count(names)).first()[0] == expected, unit


def test_entities_cut_the_events(spark):
    from panelspark.operators import series

    raw, _ = fake_raw(spark, 20)
    raw = raw.withColumn("event_hour", F.to_timestamp("created_at"))
    few = spark.createDataFrame([(3,), (4,)], "repo_id BIGINT")
    whole = series.hourly_activity(raw).where("repo_id IN (3, 4)")
    assert sorted(map(tuple, series.hourly_activity(raw, few).collect())) == sorted(map(tuple, whole.collect())) != []
    assert rows(series.first_events(raw, few)) == [(3, dt.datetime(2025, 1, 10, 1)), (4, dt.datetime(2025, 1, 10, 1))]


def test_stats_do_not_sort_the_events(spark):
    raw, _ = fake_raw(spark, 5)
    stats = ent.entity_stats(raw, 2025, utc("2025-07-01"), utc("2026-01-01"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    bottom = plan[plan.index("Exchange hashpartitioning(repo_id", plan.index("Exchange") + 1) :]
    assert "Sort" not in bottom


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "repo_id INT")
    assert [tuple(r) for r in ent.duplicate_entities(df).collect()] == [(2, 2)]
