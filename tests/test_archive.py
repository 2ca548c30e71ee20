import gzip
import json

import pytest
from helpers import rows

from panelspark.sources import archive, tables


def line(**fields):
    base = {"id": "1", "type": "PushEvent", "repo": {"id": 1, "name": "a/b"}, "created_at": "2024-01-01T00:00:00Z"}
    return json.dumps(base | fields)


def flat(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "line STRING")
    return [r.asDict() for r in archive.flatten_events(archive.parse_lines(df)).collect()]


def test_columns(spark):
    (row,) = flat(spark, [line(actor={"id": 7, "login": "x"}, payload={"action": "opened", "distinct_size": 3})])
    assert tuple(row) == archive.RAW_COLUMNS
    assert row == {
        "event_id": "1",
        "created_at": "2024-01-01T00:00:00Z",
        "event_type": "PushEvent",
        "repo_id": 1,
        "repo_name": "a/b",
        "actor_id": 7,
        "actor_login": "x",
        "action": "opened",
        "push_distinct_size": 3,
    }


def test_dropped_events(spark):
    lines = [
        line(type="ForkEvent"),
        line(repo={"id": 1, "name": 5}),
        line(repo={"id": 1}),
        line(repo=None),
        "",
        "   ",
        '{"broken"',
        "17",
    ]
    assert flat(spark, lines) == []


@pytest.mark.parametrize(
    "value,expected", [(2.0, 2), (2, 2), (-3.9, -3), (True, 1), ("2", None), (None, None), ([1], None), (1e30, None)]
)
def test_whole_numbers(spark, value, expected):
    (row,) = flat(spark, [line(repo={"id": value, "name": "a"}, actor={"id": value})])
    assert (row["repo_id"], row["actor_id"]) == (expected, expected)


@pytest.mark.parametrize("value,expected", [(3.7, 3), (True, 1), (2**40, None), ("3", None)])
def test_push_size(spark, value, expected):
    (row,) = flat(spark, [line(payload={"distinct_size": value})])
    assert row["push_distinct_size"] == expected


def test_odd_payloads(spark):
    found = flat(spark, [line(payload=[1]), line(payload=None), line(payload={"action": 5}), line(actor={"login": 5}), line(id=None), line(id=12)])
    assert all(r["action"] is None and r["actor_login"] is None for r in found)
    assert [r["event_id"] for r in found] == ["1", "1", "1", "1", None, "12"]


def write_hour(folder, stamp, lines):
    folder.mkdir(exist_ok=True)
    with gzip.open(folder / f"{stamp}.json.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")


def test_hour_files(spark, tmp_path):
    src = tmp_path / "archive"
    write_hour(src, "2024-01-01-0", [line(), "", line(id="2")])
    write_hour(src, "2024-01-01-11", [line(id="3"), '{"broken"'])
    found = archive.read_archive(spark, str(src))
    assert rows(found.select("event_id", "year", "month", "day", "hour")) == [("1", 2024, 1, 1, 0), ("2", 2024, 1, 1, 0)]
    lenient = archive.read_archive(spark, str(src), strict=False)
    assert rows(lenient.select("event_id", "hour")) == [("1", 0), ("2", 0), ("3", 11)]
    one = archive.read_archive(spark, str(src), strict=False, hours=["2024-01-01-11"])
    assert rows(one.select("event_id", "hour")) == [("3", 11)]


def test_raw_table(spark, tmp_path):
    src, out = tmp_path / "archive", str(tmp_path / "raw")
    for h in range(3):
        write_hour(src, f"2024-01-01-{h}", [line(id=str(h)), line(id=f"{h}b")])
    events = archive.read_archive(spark, str(src), strict=False)
    tables.write_partitions(events, out, archive.HOUR_PARTS)
    assert spark.read.parquet(out).columns == [*archive.RAW_COLUMNS, *archive.HOUR_PARTS]
    # Rewriting one hour leaves the others alone.
    tables.write_partitions(events.where("hour = 1 AND event_id = '1'"), out, archive.HOUR_PARTS)
    counts = tables.present_hours(spark, out)
    assert [(r[0].hour, r[1]) for r in rows(counts)] == [(0, 2), (1, 1), (2, 2)]
    picked = tables.read_raw_hours(spark, out, "2024-01-01-01", "2024-01-01-02")
    assert picked.count() == 3
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    with pytest.raises(FileNotFoundError):
        tables.read_raw_hours(spark, out, "2025-01-01-00", "2025-01-01-02")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "absent"))


def test_filter_does_not_repeat_the_parse(spark):
    df = spark.createDataFrame([(line(),)], "line STRING")
    plan = archive.flatten_events(archive.parse_lines(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_mixed_tree(spark, tmp_path):
    a, b = tmp_path / "t" / "daily" / "year=2024", tmp_path / "t" / "weekly" / "week=01"
    spark.sql("SELECT 1 AS x, 'a' AS unique_id").write.parquet(str(a))
    spark.sql("SELECT 2 AS x").write.parquet(str(b))
    found = tables.read_tree(spark, str(tmp_path / "t"))
    assert rows(found.select("x", "unique_id")) == [(1, "a"), (2, None)]


def test_opaque_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": [1, 2], "b": [3, 4]}), tmp_path / "20240101_part0")
    assert rows(tables.read_opaque(spark, str(tmp_path), ["a"])) == [(1,), (2,)]
