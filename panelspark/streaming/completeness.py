"""Completeness of periods as keyed state of a stream of hours.

The state of a period is the set of its hours seen so far. A period is emitted as soon as enough of its hours are there, and
again with each later hour. A timer per period bounds the wait: when the watermark passes the period's end and the
hours are too few, it is emitted as refused; late hours may still complete it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators.series import COMPLETENESS, DEFAULT_COMPLETENESS

GATE_SCHEMA = "idx BIGINT, found_hours BIGINT, expected_hours BIGINT, status STRING"


def _processor():
    """The processor as a local class, so that it is sent with the job."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Gate(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.hours = handle.getMapState("hours", "hour BIGINT", "seen BOOLEAN")
            self.period = handle.getValueState("period", "needed BIGINT, expected BIGINT, is_complete BOOLEAN")

        def _row(self, key, found, expected, status):
            return pd.DataFrame({"idx": [key[0]], "found_hours": [found], "expected_hours": [expected], "status": [status]})

        def handleInputRows(self, key, rows, timerValues):
            known = self.period.get() if self.period.exists() else None
            needed, expected = (known[0], known[1]) if known else (None, None)
            deadline, before = None, len(list(self.hours.keys())) if self.hours.exists() else 0
            for part in rows:
                for hour in part["hour_no"]:
                    self.hours.updateValue((int(hour),), (True,))
                if len(part):
                    needed, expected, deadline = (int(part[c].iloc[0]) for c in ("needed", "expected_hours", "deadline"))
            found = len(list(self.hours.keys()))
            complete = found >= needed
            if known is None and not complete:
                self.handle.registerTimer(deadline)
            elif complete and known is not None and not known[2]:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            self.period.update((needed, expected, complete))
            if complete and found > before:
                yield self._row(key, found, expected, "complete")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            _, expected, complete = self.period.get()
            if not complete:
                yield self._row(key, len(list(self.hours.keys())), expected, "refused")

        def close(self):
            pass

    return Gate()


def gate_periods(
    hours: DataFrame, freq: str | cal.Frequency, grace: str = "3 days", thresholds: dict[str, float] | None = None
) -> DataFrame:
    """Status of periods (``idx, found_hours, expected_hours, status``) from a stream with a column ``hour``.

    ``status`` is ``complete`` or ``refused``. Hours older than the latest one by more than ``grace`` are dropped.
    """
    f = cal.frequency(freq)
    threshold = (COMPLETENESS if thresholds is None else thresholds).get(f.name, DEFAULT_COMPLETENESS)
    idx = cal.period_index(F.col("hour"), f)
    expected = cal.expected_hours(F.col("idx"), f)
    rows = hours.withWatermark("hour", grace).select("hour", idx.alias("idx")).select(
        "idx",
        "hour",
        cal.period_index(F.col("hour"), "hourly").alias("hour_no"),
        expected.cast("long").alias("expected_hours"),
        F.ceil(expected * F.lit(threshold) - 1e-9).cast("long").alias("needed"),
        (F.unix_millis(cal.period_last_hour(F.col("idx"), f)) + 3_600_000).alias("deadline"),
    )
    return rows.groupBy("idx").transformWithStateInPandas(
        statefulProcessor=_processor(), outputStructType=GATE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
