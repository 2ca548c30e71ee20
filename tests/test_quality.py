import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import rows

from panelspark.operators import quality


def ledger(spark, *entries):
    """Ledger of ``(key, status, num_rows)``."""
    data = [(k, f"{k}.parquet", s, n, None if s == "ok" else f"{s}!") for k, s, n in entries]
    df = spark.createDataFrame(data, "key STRING, path STRING, status STRING, num_rows BIGINT, error STRING")
    return df.selectExpr("*", "current_timestamp() AS checked_at")


def test_files(spark, tmp_path):
    pq.write_table(pa.table({"x": [1, 2]}), tmp_path / "good.parquet")
    pq.write_table(pa.table({"x": pa.array([], pa.int64())}), tmp_path / "empty.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    names = ["good", "empty", "bad", "gone"]
    files = spark.createDataFrame([(n, str(tmp_path / f"{n}.parquet")) for n in names], "key STRING, path STRING")
    found = {r.key: r for r in quality.validate_files(files).collect()}
    assert {k: (r.status, r.num_rows) for k, r in found.items()} == {
        "good": ("ok", 2), "empty": ("empty", 0), "bad": ("unreadable", 0), "gone": ("missing", 0)
    }
    assert found["good"].error is None and "not found" in found["gone"].error and found["bad"].error
    uri = spark.createDataFrame([("good", f"file://{tmp_path}/good.parquet")], "key STRING, path STRING")
    assert quality.validate_files(uri).first().status == "ok"


def test_keys(spark):
    expected = spark.createDataFrame([(k,) for k in "abc"], "key STRING")
    present = spark.createDataFrame([("a", 5), ("a", 1), ("b", 0), ("x", 1)], "key STRING, num_rows BIGINT")
    found = quality.validate_keys(expected, present)
    assert rows(found.select("key", "status", "num_rows")) == [("a", "ok", 6), ("b", "empty", 0), ("c", "missing", 0)]


def test_counts_and_reports(spark):
    df = ledger(spark, ("a", "ok", 3), ("b", "missing", 0), ("c", "empty", 0), ("d", "unreadable", 0), ("e", "known_issue", 0))
    row = quality.status_counts(df).first()
    assert (row.total, row.ok, row.missing, row.empty, row.unreadable, row.known_issue, row.all_ok) == (5, 1, 1, 1, 1, 1, False)
    assert [r[0] for r in rows(quality.problems(df).select("key"))] == ["b", "c", "d"]
    assert rows(quality.ok_paths(df)) == [("a.parquet",)]
    lines = {tuple(r) for r in quality.report(df).collect()}
    assert {("counts", "total", "5"), ("counts", "missing", "1"), ("problems", "b.parquet", "missing!"), ("known", "e.parquet", "known_issue!")} <= lines
    assert len(lines) == 6 + 4


def test_good_reports(spark):
    good = ledger(spark, ("a", "ok", 3))
    assert {r.section for r in quality.report(good).collect()} == {"counts"}
    known = ledger(spark, ("a", "ok", 3), ("b", "known_issue", 0))
    assert quality.status_counts(known).first().all_ok
    assert rows(quality.report(known).where("section = 'known'").select("name")) == [("b.parquet",)]
    empty = good.limit(0)
    row = quality.status_counts(empty).first()
    assert (row.total, row.all_ok) == (0, True)


def test_known_issues(spark):
    df = ledger(spark, ("a", "ok", 3), ("b", "missing", 0), ("c", "empty", 0))
    marked = quality.mark_known_issues(df, ["a", "b"])
    assert rows(marked.select("key", "status", "error")) == [
        ("a", "ok", None), ("b", "known_issue", "known upstream issue"), ("c", "empty", "empty!")
    ]


def test_pending_and_merge(spark):
    old = ledger(spark, ("a", "ok", 3), ("b", "missing", 0), ("c", "known_issue", 0))
    expected = spark.createDataFrame([(k,) for k in "abcd"], "key STRING")
    assert rows(quality.pending(expected, old)) == [("b",), ("d",)]
    merged = quality.merge_ledgers(old, ledger(spark, ("b", "ok", 9)))
    assert rows(merged.select("key", "status")) == [("a", "ok"), ("b", "ok"), ("c", "known_issue")]


class Store:
    """Outputs by key; builds succeed except for keys that cannot be made."""

    def __init__(self, spark, present, impossible=()):
        self.spark, self.present, self.impossible = spark, dict(present), set(impossible)
        self.checked, self.built = [], []

    def validate(self, keys):
        self.checked.append(sorted(r.key for r in keys.collect()))
        present = self.spark.createDataFrame(list(self.present.items()) or [("-", 1)], "key STRING, num_rows BIGINT")
        return quality.validate_keys(keys, present)

    def build(self, keys):
        names = sorted(r.key for r in keys.collect())
        self.built.append(names)
        self.present.update({k: 1 for k in names if k not in self.impossible})


def test_refresh(spark, tmp_path):
    path = str(tmp_path / "ledger")
    expected = spark.createDataFrame([(k,) for k in "abcd"], "key STRING")
    store = Store(spark, {"a": 4, "b": 0}, impossible="d")
    found = quality.refresh(spark, path, expected, store.validate, store.build, known=["d"])
    assert rows(found.select("key", "status")) == [("a", "ok"), ("b", "ok"), ("c", "ok"), ("d", "known_issue")]
    assert store.built == [["b", "c"]] and store.checked == [["a", "b", "c", "d"], ["b", "c"]]
    # All keys are acceptable now: nothing is checked or built again.
    again = quality.refresh(spark, path, expected, store.validate, store.build, known=["d"])
    assert len(store.checked) == 2 and again.count() == 4
    full = quality.refresh(spark, path, expected, store.validate, store.build, known=["d"], force_full=True)
    assert store.checked[-1] == ["a", "b", "c", "d"] and full.count() == 4


def test_refresh_raises(spark, tmp_path):
    expected = spark.createDataFrame([("a",), ("b",)], "key STRING")
    store = Store(spark, {"a": 1}, impossible="b")
    with pytest.raises(RuntimeError, match="missing"):
        quality.refresh(spark, str(tmp_path / "ledger"), expected, store.validate, store.build)
    # The problem is on record, and is tried again until it is made.
    assert rows(quality.load_ledger(spark, str(tmp_path / "ledger")).select("key", "status")) == [("a", "ok"), ("b", "missing")]
    store.impossible.clear()
    found = quality.refresh(spark, str(tmp_path / "ledger"), expected, store.validate, store.build)
    assert store.checked[-1] == ["b"] and rows(found.select("status")) == [("ok",), ("ok",)]


def test_no_ledger(spark, tmp_path):
    assert quality.load_ledger(spark, str(tmp_path / "none")).count() == 0


def test_period_files(spark, tmp_path):
    for day, n in (("01", 5), ("02", 3), ("03", 0)):
        folder = tmp_path / "daily" / "year=2026" / "month=01" / f"day={day}"
        folder.mkdir(parents=True)
        pq.write_table(pa.table({"y": pa.array(range(n), pa.int64())}), folder / "series.parquet")

    def check():
        found = quality.validate_period_files(spark, str(tmp_path / "daily"), "daily", "2026-01-01", "2026-01-05")
        return rows(found.select("key", "status", "num_rows"))

    keys = [f"2026-01-{d:02d}-00" for d in range(1, 6)]
    found = [("ok", 5), ("ok", 3), ("empty", 0), ("missing", 0), ("missing", 0)]
    assert check() == [(k, *f) for k, f in zip(keys, found)]
    (tmp_path / "daily/year=2026/month=01/day=02/series.parquet").write_bytes(b"garbage")
    assert check()[1] == (keys[1], "unreadable", 0)


def test_partition_paths(spark):
    from helpers import utc
    from pyspark.sql import functions as F

    from panelspark.functions import calendar as cal

    at = F.lit(utc("2023-01-01T05:00"))
    found = spark.range(1).select(*[cal.partition_path(at, f).alias(f) for f in cal.FREQUENCIES]).first()
    # Folders of the hour 2023-01-01 05:00, whose ISO week is 2022/52.
    assert found.asDict() == {
        "hourly": "year=2023/month=01/day=01/hour=05",
        "daily": "year=2023/month=01/day=01",
        "weekly": "year=2022/week=52",
        "monthly": "year=2023/month=01",
    }
