"""Quality ledger: status of every expected key, known issues, incremental refresh.

A ledger row is ``key, path, status, num_rows, error, checked_at``; the status is
``ok``, ``missing``, ``empty``, ``unreadable`` or ``known_issue``. The stored ledger
is append-only and the latest row of a key counts, so a refresh never rewrites a
table it is reading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.session import settle
from panelspark.sources.tables import read_table

LEDGER_SCHEMA = (
    "key STRING, path STRING, status STRING, num_rows BIGINT, error STRING, checked_at TIMESTAMP"
)
# Status names and their report labels.
STATUS_LABELS = {
    "ok": "OK (non-empty)",
    "missing": "Missing",
    "empty": "Empty (0 rows)",
    "unreadable": "Unreadable/corrupt",
    "known_issue": "Known issues",
}
ACCEPTABLE = ("ok", "known_issue")
KNOWN_REASON = "known upstream issue"


def acceptable(status: str = "status") -> Column:
    """True for ``ok`` and ``known_issue``."""
    return F.col(status).isin(*ACCEPTABLE)


# --- validation ------------------------------------------------------------------


def validate_keys(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Ledger of expected keys against ``key, num_rows`` of those present."""
    counts = present.groupBy("key").agg(F.sum("num_rows").alias("num_rows"))
    status = (
        F.when(F.col("num_rows").isNull(), "missing")
        .when(F.col("num_rows") == 0, "empty")
        .otherwise("ok")
    )
    error = F.when(F.col("num_rows").isNull(), "not found").when(
        F.col("num_rows") == 0, "0 rows"
    )
    path = F.col("path") if "path" in expected.columns else F.lit(None).cast("string")
    return expected.join(counts, "key", "left").select(
        "key",
        path.alias("path"),
        status.alias("status"),
        F.coalesce("num_rows", F.lit(0).cast("long")).alias("num_rows"),
        error.alias("error"),
        F.current_timestamp().alias("checked_at"),
    )


def _footer_reader() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Footer check of Parquet files as a local function, so tasks need not import this package."""

    def check(path: str) -> tuple[str, int, str | None]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        try:
            scheme, _, rest = path.partition(":")
            if scheme in ("s3a", "s3n"):
                path = "s3:" + rest
            if scheme == "file":  # file:/x as well as file:///x
                fs, inner = pafs.LocalFileSystem(), "/" + rest.lstrip("/")
            elif rest.startswith("//"):
                fs, inner = pafs.FileSystem.from_uri(path)
            else:
                fs, inner = pafs.LocalFileSystem(), path
            if fs.get_file_info(inner).type == pafs.FileType.NotFound:
                return "missing", 0, "file not found"
            with fs.open_input_file(inner) as source:
                n = pq.ParquetFile(source).metadata.num_rows
        except Exception as problem:  # a store or file that cannot be read is reported, and the job goes on
            return "unreadable", 0, str(problem)
        return ("ok", n, None) if n else ("empty", 0, "0 rows")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [check(path) for path in batch["path"]]
            status, rows, errors = zip(*found) if found else ((), (), ())
            yield batch.assign(status=list(status), num_rows=list(rows), error=list(errors))

    return read


def validate_files(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ledger of expected Parquet files given as ``key, path``.

    Spark either fails on a corrupt file or, told to ignore it, returns no rows,
    which looks like an empty file. The footers are therefore opened in tasks.
    """
    spread = files.select("key", "path").repartition(tasks or files.sparkSession.sparkContext.defaultParallelism)
    schema = "key STRING, path STRING, status STRING, num_rows BIGINT, error STRING"
    checked = spread.mapInPandas(_footer_reader(), schema)
    return checked.withColumn("checked_at", F.current_timestamp())


def validate_period_files(
    spark: SparkSession, root: str, freq: str, start: str, end: str, file: str = "series.parquet"
) -> DataFrame:
    """Ledger of the one-file-per-period layout ``<root>/<date parts>/<file>`` over a range."""
    grid = cal.label_grid(spark, freq, start, end)
    folder = cal.partition_path(F.col("ds"), freq)
    path = F.concat_ws("/", F.lit(root.rstrip("/")), folder, F.lit(file))
    return validate_files(grid.select(cal.hour_key(F.col("ds")).alias("key"), path.alias("path")))


def validate_periods(series: DataFrame, freq: str, start: str, end: str) -> DataFrame:
    """Ledger of the periods of a range against the rows of a series table."""
    grid = cal.label_grid(series.sparkSession, freq, start, end)
    counts = series.groupBy(cal.hour_key(F.col("ds")).alias("key")).agg(F.count("*").alias("num_rows"))
    return validate_keys(grid.select(cal.hour_key(F.col("ds")).alias("key")), counts)


def mark_known_issues(ledger: DataFrame, known: Iterable[str], reason: str = KNOWN_REASON) -> DataFrame:
    """Turn problem rows of known keys into ``known_issue``; good rows stay as they are."""
    hit = F.col("key").isin(*known) & ~acceptable()
    return ledger.withColumns(
        {
            "status": F.when(hit, "known_issue").otherwise(F.col("status")),
            "error": F.when(hit, reason).otherwise(F.col("error")),
        }
    )


# --- incremental keys ------------------------------------------------------------


def pending(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """Expected keys without an acceptable ledger row."""
    return expected.join(ledger.where(acceptable()).select("key"), "key", "left_anti")


def pending_keys(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that have no output yet."""
    return expected.join(existing.select(*keys), keys, "left_anti")


def merge_ledgers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in ``new``."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def latest(ledger: DataFrame) -> DataFrame:
    """Latest row per key."""
    names = [c for c in ledger.columns if c != "key"]
    newest = ledger.groupBy("key").agg(F.max_by(F.struct(*names), "checked_at").alias("r"))
    return newest.select("key", "r.*")


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Stored ledger, latest row per key; empty if there is none yet."""
    return latest(read_table(spark, path, LEDGER_SCHEMA))


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Add checked rows to the stored ledger."""
    columns = [part.split()[0] for part in LEDGER_SCHEMA.split(", ")]
    ledger.select(*columns).write.mode("append").option("compression", "zstd").parquet(path)


def refresh(
    spark: SparkSession,
    ledger_path: str,
    expected: DataFrame,
    validate: Callable[[DataFrame], DataFrame],
    build: Callable[[DataFrame], None] | None = None,
    known: Iterable[str] = (),
    force_full: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Check all keys not yet known to be good, rebuild missing or empty ones, check again.

    ``validate`` maps a ``key`` frame to a ledger and ``build`` makes all given
    keys in one job. Unreadable outputs and known issues are not rebuilt. Returns
    the merged ledger; raises on remaining problems unless ``strict`` is off.
    """
    known = list(known)
    cached = load_ledger(spark, ledger_path)
    if force_full:
        cached = cached.limit(0)
    todo = settle(pending(expected, cached), "pending")
    if todo.isEmpty():
        return cached
    checked = settle(validate(todo), "checked")
    fixable = checked.where(F.col("status").isin("missing", "empty"))
    if known:
        fixable = fixable.where(~F.col("key").isin(*known))
    if build is not None and not fixable.isEmpty():
        keys = todo.join(fixable.select("key"), "key", "left_semi")
        build(keys)
        checked = settle(merge_ledgers(checked, validate(keys)), "rechecked")
    if known:
        checked = mark_known_issues(checked, known)
    append_ledger(checked, ledger_path)
    merged = load_ledger(spark, ledger_path)
    if strict:
        problems = merged.join(todo.select("key"), "key", "left_semi").where(~acceptable())
        counts = {r.status: r["count"] for r in problems.groupBy("status").count().collect()}
        if counts:
            raise RuntimeError(f"Validation errors after rebuild: {counts}")
    return merged


# --- reports -----------------------------------------------------------------------


def status_counts(ledger: DataFrame) -> DataFrame:
    """Rows per status and in total, and whether all are acceptable; one row."""
    return ledger.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUS_LABELS],
        (F.count_if(~acceptable()) == 0).alias("all_ok"),
    )


def with_status(ledger: DataFrame, *status: str) -> DataFrame:
    """Rows of the given statuses."""
    return ledger.where(F.col("status").isin(*status))


def problems(ledger: DataFrame) -> DataFrame:
    """Rows that are neither ok nor known issues."""
    return ledger.where(~acceptable())


def ok_paths(ledger: DataFrame) -> DataFrame:
    """Distinct paths of ok rows."""
    return ledger.where("status = 'ok'").select("path").distinct()


def report(ledger: DataFrame) -> DataFrame:
    """Report rows ``section, name, detail``: a count per status, all problems and all known issues."""
    total = F.count("*").alias("total")
    counts = ledger.agg(total, *[F.count_if(F.col("status") == s).alias(s) for s in STATUS_LABELS])
    pairs = F.map_from_arrays(F.array(*map(F.lit, ("total", *STATUS_LABELS))), F.array("total", *STATUS_LABELS))
    head = counts.select(F.lit("counts").alias("section"), F.explode(pairs).alias("name", "n"))
    head = head.select("section", "name", F.col("n").cast("string").alias("detail"))
    bad = ledger.where(F.col("status") != "ok").select(
        F.when(F.col("status") == "known_issue", "known").otherwise("problems").alias("section"),
        F.coalesce("path", "key").alias("name"),
        F.coalesce("error", "status").alias("detail"),
    )
    return head.unionAll(bad)
