"""Helpers to run numpy code in Spark tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Bytes of text that numpy code works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18
_BATCH_BYTES = 2 << 20
# Rows of a slice, so that a row's number in it has 16 bits.
_SLICE_ROWS = 1 << 16


def ship_functions(spark: SparkSession) -> None:
    """Send this package's task functions with the job, so executors need no copy of it.

    Also bounds Arrow batches by bytes, as a batch of long texts may be large.
    """
    for name, module in list(sys.modules.items()):
        if name.startswith("panelspark.llm."):
            cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``SLICE_BYTES`` of text in ``column``, ``_SLICE_ROWS`` at most."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary())
        begin, total = 0, 0
        ends = _ends(sizes)
        for row in range(batch.num_rows):
            total = ends[row + 1] - ends[begin]
            if total >= SLICE_BYTES or row + 1 - begin == _SLICE_ROWS:
                yield batch.slice(begin, row + 1 - begin)
                begin = row + 1
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _ends(array: pa.LargeBinaryArray) -> list[int]:
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1].tolist()


def column(df: DataFrame, name: str):
    """A column by its exact name, whatever characters it holds."""
    return df["`" + name.replace("`", "``") + "`"]
