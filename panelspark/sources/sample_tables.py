"""Sample tables mapped onto the benchmark's data model.

The ``events`` table stands in for the event archive: a user is an entity and
each event type is one kind of archive event. ``orders`` gives a long monthly
panel. The mapping is plain projection, so it can be written as SQL as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type of a sample event; others keep their own name.
EVENT_TYPES = {
    "view": "WatchEvent",
    "click": "PushEvent",
    "purchase": "PullRequestEvent",
    "signup": "IssuesEvent",
    "error": "ErrorEvent",
}
CLOSED_BELOW = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One sample table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample events as raw archive events, all types, with hour parts."""
    return map_events(table(spark, sf_dir, "events"))


def map_events(ev: DataFrame) -> DataFrame:
    """Map rows of the ``events`` table to raw archive events."""
    ts = F.col("ts").cast("timestamp")
    size = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    event_type = kind[F.col("event_type")]
    has_action = event_type.isin("PullRequestEvent", "IssuesEvent")
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        event_type.alias("event_type"),
        F.col("user_id").alias("repo_id"),
        F.concat(F.lit("user/"), F.col("user_id")).alias("repo_name"),
        size.cast("long").alias("actor_id"),
        F.concat(F.lit("actor"), size).alias("actor_login"),
        F.when(has_action & (size < CLOSED_BELOW), "closed").when(has_action, "opened").alias("action"),
        F.when(event_type == "PushEvent", size).alias("push_distinct_size"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"),
    )


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts per status and priority, as a dense monthly panel.

    The last month of the table is open and left out.
    """
    orders = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    counts = orders.groupBy(
        F.concat("o_orderstatus", F.lit("-"), "o_orderpriority", F.lit(":orders")).alias("unique_id"),
        month.alias("ds"),
    ).agg(F.count("*").alias("y"))
    span = orders.agg(
        F.date_trunc("month", F.max(F.col("o_orderdate").cast("timestamp"))).alias("open_month")
    )
    last = F.add_months(span.select("open_month").scalar(), -1).cast("timestamp")
    spine = counts.groupBy("unique_id").agg(F.min("ds").alias("first"))
    spine = spine.where(F.col("first") <= last).select(
        "unique_id", F.explode(F.sequence("first", last, F.expr("INTERVAL 1 MONTH"))).alias("ds")
    )
    return spine.join(counts, ["unique_id", "ds"], "left").select(
        "unique_id", "ds", F.coalesce("y", F.lit(0).cast("long")).alias("y")
    )
