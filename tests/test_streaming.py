import gzip
import json

from helpers import rows, utc
from pyspark.sql import functions as F

from panelspark.operators import series
from panelspark.streaming import completeness, hourly


def event(i, repo=1, kind="PushEvent"):
    return json.dumps({"id": str(i), "type": kind, "repo": {"id": repo, "name": f"r{repo}"}, "created_at": "x"})


def add(folder, stamp, lines, part=0):
    with gzip.open(folder / f"{stamp}-{part}.json.gz" if part else folder / f"{stamp}.json.gz", "wt") as f:
        f.write("\n".join(lines))


def test_archive_stream(spark, tmp_path):
    src = tmp_path / "archive"
    src.mkdir()
    out, checkpoint = str(tmp_path / "counts"), str(tmp_path / "state")
    touched = []

    def on_batch(hours, number):
        touched.append(sorted(r[0].hour for r in hours.select(F.col("hour").cast("timestamp_ntz")).collect()))

    def run():
        hourly.stream_hourly(
            hourly.stream_archive(spark, str(src)), out, checkpoint, on_batch=on_batch, archive_input=True
        ).awaitTermination()

    add(src, "2024-01-01-0", [event(1), event(2), event(3, 2, "WatchEvent"), event(4, 2, "ForkEvent")])
    add(src, "2024-01-01-1", [event(5), "{broken"])
    run()
    found = hourly.read_streamed(spark, out)
    assert rows(found.select("repo_id", F.hour("event_hour"), "pushes", "stars", "n_events")) == [(1, 0, 2, 0, 2), (2, 0, 0, 1, 1)]
    # A late file for hour 0 and a new hour: only the new files are read, and counts add up.
    add(src, "2024-01-01-0", [event(6)], part="late")
    add(src, "2024-01-01-2", [event(7, 2)])
    run()
    found = hourly.read_streamed(spark, out)
    assert rows(found.select("repo_id", F.hour("event_hour"), "pushes", "n_events")) == [(1, 0, 3, 3), (2, 0, 0, 1), (2, 2, 1, 1)]
    assert touched[0] == [0] and sorted(sum(touched[1:], [])) == [0, 2]


def test_entity_filter_and_windows(spark, tmp_path):
    data = [(1, "PushEvent", None, utc("2024-01-01T00:10:00")), (1, "PushEvent", None, utc("2024-01-01T00:50:00")),
            (2, "WatchEvent", None, utc("2024-01-01T01:10:00")), (3, "ForkEvent", None, utc("2024-01-01T01:10:00"))]
    df = spark.createDataFrame(data, "repo_id BIGINT, event_type STRING, action STRING, ts TIMESTAMP")
    df.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    query = (
        hourly.windowed_counts(stream).writeStream.outputMode("update").format("memory").queryName("live")
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    live = spark.table("live").select("repo_id", F.hour("event_hour"), "pushes", "stars")
    assert rows(live) == [(1, 0, 2, 0), (2, 1, 0, 1)]

    events = stream.withColumn("event_hour", F.date_trunc("hour", "ts"))
    only = spark.createDataFrame([(1,)], "repo_id BIGINT")
    hourly.stream_hourly(events, str(tmp_path / "out"), str(tmp_path / "c2"), only).awaitTermination()
    found = hourly.read_streamed(spark, str(tmp_path / "out"))
    batch = series.hourly_activity(df.withColumn("event_hour", F.date_trunc("hour", "ts")), only)
    assert rows(found) == rows(batch) != []


def test_events_sent_again_count_once(spark, tmp_path):
    schema = "event_id STRING, repo_id BIGINT, event_type STRING, action STRING, ts TIMESTAMP"
    src, out, state = (str(tmp_path / name) for name in ("live-src", "live-out", "live-state"))

    def send(*events):
        data = [(i, 1, "PushEvent", None, utc(f"2024-01-0{d}T{h:02d}:{m:02d}:00")) for i, d, h, m in events]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        hourly.stream_live(stream, out, state).awaitTermination()
        return rows(spark.read.parquet(out).select(F.hour("event_hour"), "pushes", "n_events"))

    assert send(("a", 1, 0, 5), ("a", 1, 0, 5), ("b", 1, 0, 50), ("c", 1, 4, 0)) == [(0, 2, 2)]
    # Sent again within the watermark, and too late to count.
    assert send(("c", 1, 4, 0), ("d", 1, 4, 10), ("late", 1, 0, 1), ("e", 1, 9, 0)) == [(0, 2, 2), (4, 2, 2)]


def test_periods_are_gated_by_their_hours(spark, tmp_path):
    src = str(tmp_path / "hours")

    def send(*hours):
        data = [(utc(f"2024-01-{d:02d}T{h:02d}:00:00"),) for d, h in hours]
        spark.createDataFrame(data, "hour TIMESTAMP").coalesce(1).write.mode("append").parquet(src)
        found = []

        def keep(batch, number):
            found.extend((r.day, r.found_hours, r.status) for r in batch.select(F.dayofmonth(F.date_from_unix_date(F.col("idx").cast("int"))).alias("day"), "found_hours", "status").collect())

        (
            completeness.gate_periods(spark.readStream.schema("hour TIMESTAMP").parquet(src), "daily", grace="1 day").writeStream
            .foreachBatch(keep).option("checkpointLocation", str(tmp_path / "gate")).trigger(availableNow=True).start().awaitTermination()
        )
        return sorted(found)

    day = lambda d, n: [(d, h) for h in range(n)]
    assert send(*day(1, 21), *day(2, 22)) == [(2, 22, "complete")]  # 90 % of 24 hours are 22
    assert send((1, 22), (1, 22), *day(3, 20)) == [(1, 22, "complete")]
    assert send((3, 20), *day(5, 3)) == [(3, 21, "refused")]  # the watermark passes the end of the third day
    assert send((4, 5), *day(6, 24)) == [(4, 1, "refused"), (6, 24, "complete")]
