"""Session settings and stage tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# All timestamps are UTC. AQE splits skewed joins and merges small partitions. Keyed state of streams is kept in RocksDB,
# outside the heap; timers need it as well.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the package relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, name: str = "panelspark", **conf: str) -> SparkSession:
    """Create or get a session with the package settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession) -> str:
    """Shared folder for stage tables: the one named in ``spark.checkpoint.dir``.

    A local session without it uses a folder below its warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/panelspark-stages"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a stage table and return a scan of it.

    Later steps then read the stage instead of recomputing it, lost executors
    cost nothing, and Catalyst knows the real size, so it broadcasts the stage
    only if it is below ``autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
