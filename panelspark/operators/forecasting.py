"""Forecasts of registered models for many cutoffs at once.

A forecast row is ``model, model_alias, frequency, cutoff, unique_id, ds, yhat``
plus one ``q_<level>`` column per quantile level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import LEVELS, z_score
from panelspark.functions import calendar as cal
from panelspark.functions import scoring
from panelspark.operators import windows
from panelspark.operators.windows import Cutoffs
from panelspark.session import settle

KEYS = ("model", "model_alias", "frequency", "cutoff", "unique_id", "ds")

PandasModel = Callable[..., pd.DataFrame | dict[str, np.ndarray]]


@dataclass(frozen=True)
class Model:
    """A native model gives point and spread columns; a pandas model a function.

    ``native(freq)`` returns ``(yhat, sigma)`` over the columns of
    :func:`windows.rolling_stats` and the step ``k`` (1 for the first period).
    ``fn(history, h, freq, quantiles)`` gets one series' history ``ds, y`` and
    returns ``ds, yhat`` and ``q_<level>`` columns as a frame, or as a dict of arrays,
    which is built much faster; a function that cannot give
    quantiles raises ``ValueError`` or ``TypeError`` and is called without them.
    """

    name: str
    alias: str
    native: Callable[[cal.Frequency], tuple[Column, Column]] | None = None
    fn: PandasModel | None = None


def _zero(freq: cal.Frequency) -> tuple[Column, Column]:
    return F.lit(0.0), F.lit(0.0)


def _historic_average(freq: cal.Frequency) -> tuple[Column, Column]:
    return F.col("mean_y"), F.col("sd_y") * F.sqrt(1 + 1 / F.col("n_obs"))


def _seasonal_naive(freq: cal.Frequency) -> tuple[Column, Column]:
    step = F.col("k") - 1
    last_season = F.get("tail", F.pmod(step, F.lit(freq.season)).cast("int")).cast("double")
    return last_season, F.col("sd_season") * F.sqrt(F.floor(step / freq.season) + 1)


_MODELS: dict[str, Model] = {}


def register_model(
    name: str,
    alias: str | None = None,
    native: Callable[[cal.Frequency], tuple[Column, Column]] | None = None,
    fn: PandasModel | None = None,
) -> Model:
    """Add a model to the registry under a unique name."""
    if (native is None) == (fn is None):
        raise ValueError("give either native or fn")
    if name in _MODELS:
        raise ValueError(f"Model {name} is already registered")
    _MODELS[name] = Model(name, alias or name, native, fn)
    return _MODELS[name]


def unregister_model(name: str) -> None:
    """Remove a model from the registry."""
    _MODELS.pop(name, None)


def get_model(name: str) -> Model:
    """Look up a model by name."""
    if name not in _MODELS:
        raise ValueError(f"Unknown model: {name}. Available: {list(_MODELS)}")
    return _MODELS[name]


def model_names() -> list[str]:
    """Names of all registered models."""
    return list(_MODELS)


register_model("zero_model", "ZeroModel", native=_zero)
register_model("historic_average", "HistoricAverage", native=_historic_average)
register_model("seasonal_naive", "SeasonalNaive", native=_seasonal_naive)

BASELINES = ("zero_model", "historic_average", "seasonal_naive")


def forecast_schema(levels: Sequence[int] = LEVELS) -> str:
    """DDL of a forecast frame."""
    quantiles = ", ".join(f"{scoring.quantile_column(q)} DOUBLE" for q in levels)
    return (
        "model STRING, model_alias STRING, frequency STRING, cutoff TIMESTAMP, "
        f"unique_id STRING, ds TIMESTAMP, yhat DOUBLE, {quantiles}"
    )


def forecast_native(
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    models: Iterable[str] = BASELINES,
    h: int | None = None,
    window: int | None = None,
    levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """Forecasts of native models: one pass of window statistics, no further shuffle.

    Quantiles are normal: ``yhat + z·sigma``.
    """
    f = cal.frequency(freq)
    stats = windows.rolling_stats(panel, cutoffs, f, window)
    steps = stats.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h or f.h))))
    entries = []
    for name in models:
        model = get_model(name)
        if model.native is None:
            raise ValueError(f"{name} is not a native model")
        yhat, sigma = model.native(f)
        entries.append(
            F.struct(
                F.lit(model.name).alias("model"),
                F.lit(model.alias).alias("model_alias"),
                yhat.cast("double").alias("yhat"),
                sigma.cast("double").alias("sigma"),
            )
        )
    rows = steps.select("cutoff", "unique_id", "k", F.inline(F.array(*entries)))
    yhat, sigma = F.col("yhat"), F.col("sigma")
    return rows.select(
        "model",
        "model_alias",
        F.lit(f.name).alias("frequency"),
        "cutoff",
        "unique_id",
        cal.period_label(cal.period_index(F.col("cutoff"), f) + F.col("k"), f).alias("ds"),
        "yhat",
        *[(yhat + sigma * z_score(q)).alias(scoring.quantile_column(q)) for q in levels],
    )


def _run_series(
    model: Model, freq: cal.Frequency, h: int, levels: Sequence[int], window: int, shared: list[tuple[int, int]]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Function that runs a pandas model on sorted series: keeps one series and cuts the windows of all its cutoffs.

    ``shared`` has the cutoffs of all series as ``(micros, idx)``; rows with ``is_cutoff`` are cutoffs of their own series.
    """
    fn, freq_name = model.fn, freq.name
    head = {"model": model.name, "model_alias": model.alias, "frequency": freq_name}
    quantiles = [q / 100 for q in levels]
    columns = ["ds", "yhat", *(scoring.quantile_column(q) for q in levels)]

    def one(micros: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], int, str | None]:
        past = pd.DataFrame({"ds": micros.view("datetime64[us]").astype("datetime64[ns]"), "y": y})
        try:
            try:
                out = fn(past, h, freq_name, quantiles)
            except (ValueError, TypeError):
                out = fn(past, h, freq_name)
            n = len(out["ds"])
            missing = np.full(n, np.nan)
            found = {c: np.asarray(out[c]) if c in out else missing for c in columns}
            if any(len(values) != n for values in found.values()):
                raise ValueError("columns of different lengths")
            return found, n, None
        except Exception as problem:  # the failure is reported as a row
            found = {c: np.array([np.nan]) for c in columns[1:]}
            found["ds"] = np.array(["NaT"], dtype="datetime64[ns]")
            return found, 1, f"{type(problem).__name__}: {problem}"

    def windows_of(uid: str, parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        micros, idx, y, own = (np.concatenate(p) for p in zip(*parts)) if len(parts) > 1 else parts[0]
        cuts = shared
        if own.any():
            cuts = sorted({*shared, *zip(micros[own].tolist(), idx[own].tolist())})
            micros, idx, y = micros[~own], idx[~own], y[~own]
        lasts = np.array([last for _, last in cuts])
        begins, ends = np.searchsorted(idx, lasts - (window - 1)), np.searchsorted(idx, lasts + 1)
        for (cutoff, _), begin, end in zip(cuts, begins.tolist(), ends.tolist()):
            if end > begin:
                yield cutoff, uid, *one(micros[begin:end], y[begin:end])

    def frame(results: list[tuple]) -> pd.DataFrame:
        sizes = [n for *_, n, _ in results]
        data = {c: np.concatenate([found[c] for _, _, found, _, _ in results]) for c in columns}
        cutoff = np.array([r[0] for r in results]).astype("datetime64[us]").astype("datetime64[ns]")
        data |= {"cutoff": np.repeat(cutoff, sizes), "unique_id": np.repeat(np.array([r[1] for r in results], dtype=object), sizes)}
        errors = np.repeat(np.array([r[4] for r in results], dtype=object), sizes)
        out = pd.DataFrame(data).assign(**head, error=errors)
        return out[["model", "model_alias", "frequency", "cutoff", "unique_id", *columns, "error"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []  # the series whose end was not seen yet
        uid = None
        for batch in batches:
            if batch.empty:
                continue
            ids, *values = (batch[c].to_numpy() for c in ("unique_id", "micros", "idx", "y", "is_cutoff"))
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(batch)]
            results: list[tuple] = []
            for begin, end in zip(edges, edges[1:]):
                if held and uid != ids[begin]:
                    results += windows_of(uid, held)
                    held = []
                uid = ids[begin]
                held.append(tuple(v[begin:end] for v in values))
            if results:
                yield frame(results)
        if held and (results := list(windows_of(uid, held))):
            yield frame(results)

    return run


def forecast_pandas(
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    model: str,
    h: int | None = None,
    window: int | None = None,
    levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """Forecasts of one pandas model with an ``error`` column.

    The panel is shuffled and sorted once by series; a task keeps one series and cuts the windows of all its
    cutoffs from it, so no row is copied per cutoff. Fitting costs time and not bytes, so the number of tasks is set here
    and not merged by size.
    """
    f = cal.frequency(freq)
    w = window or f.window
    spark = panel.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared: list[tuple[int, int]] = []
    rows = windows.reachable(panel, cutoffs, f, w).select(
        "unique_id", cal.period_index(F.col("ds"), f).alias("idx"), F.unix_micros("ds").alias("micros"), "y",
        F.lit(False).alias("is_cutoff"),
    )
    if windows.own_cutoffs(cutoffs):
        own = windows.checked_own(cutoffs, f)
        rows = rows.unionByName(own.select(
            "unique_id", "idx", F.unix_micros("cutoff").alias("micros"), F.lit(0).alias("y"), F.lit(True).alias("is_cutoff"),
        ))
    else:
        frame = windows.cutoff_frame(spark, cutoffs, f).select(F.unix_micros("cutoff").alias("micros"), "cutoff_idx")
        shared = sorted((r.micros, r.cutoff_idx) for r in frame.toLocalIterator())
    ordered = rows.repartition(tasks, "unique_id").sortWithinPartitions("unique_id", "idx")
    run = _run_series(get_model(model), f, h or f.h, levels, w, shared)
    return ordered.mapInPandas(run, forecast_schema(levels) + ", error STRING")


def forecast(
    panel: DataFrame,
    cutoffs: Cutoffs,
    freq: str | cal.Frequency,
    models: Iterable[str] = BASELINES,
    h: int | None = None,
    window: int | None = None,
    levels: Sequence[int] = LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all models and cutoffs, and the keys whose model failed.

    A pandas model that fails on any series loses that cutoff as a whole; its
    output is staged so the model runs once.
    """
    found = [get_model(name) for name in models]
    native = [m.name for m in found if m.native is not None]
    parts, failures = [], []
    if native:
        parts.append(forecast_native(panel, cutoffs, freq, native, h, window, levels))
    for model in found:
        if model.fn is None:
            continue
        out = settle(
            forecast_pandas(panel, cutoffs, freq, model.name, h, window, levels), "forecast"
        )
        failed = settle(
            out.where("error IS NOT NULL")
            .groupBy("model", "cutoff")
            .agg(F.count("*").alias("n_failed"), F.min("error").alias("error")),
            "failed-keys",
        )
        kept = out.join(failed, ["model", "cutoff"], "left_anti")
        parts.append(kept.drop("error"))
        failures.append(failed)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    if not failures:
        none = "model STRING, cutoff TIMESTAMP, n_failed BIGINT, error STRING"
        return result, panel.sparkSession.createDataFrame([], none)
    failed = failures[0]
    for part in failures[1:]:
        failed = failed.unionByName(part)
    return result, failed


def refused_cutoffs(panel: DataFrame, cutoffs: Cutoffs, freq: str, window: int | None = None) -> DataFrame:
    """Cutoffs that cannot be forecast: ``key, n, error``.

    ``missing_history`` if a period of the window is absent (``n`` periods), ``misaligned`` if a series of the window
    does not end at the cutoff (``n`` series).
    """
    presence = windows.window_presence(panel, cutoffs, freq, window)
    checked = windows.alignment(panel, cutoffs, freq, window)
    rows = presence.join(checked, "cutoff", "left")
    gaps = F.col("expected_periods") - F.col("found_periods")
    error = F.when(~F.col("window_ok"), "missing_history").when(~F.coalesce("aligned", F.lit(False)), "misaligned")
    n = F.when(~F.col("window_ok"), gaps).otherwise(F.coalesce("n_misaligned", F.lit(0).cast("long")))
    found = rows.select(cal.hour_key(F.col("cutoff")).alias("key"), n.cast("long").alias("n"), error.alias("error"))
    return found.where("error IS NOT NULL")


def check_alignment(panel: DataFrame, cutoffs: Cutoffs, freq: str, window: int | None = None) -> None:
    """Raise unless every cutoff is the last period of all series in its window."""
    checked = windows.alignment(panel, cutoffs, freq, window)
    frame = windows.cutoff_frame(panel.sparkSession, cutoffs, freq)
    bad = frame.join(checked, "cutoff", "left").where(~F.coalesce("aligned", F.lit(False)))
    row = bad.agg(F.count("*").alias("n"), F.min("cutoff").alias("first")).first()
    if row.n:
        raise ValueError(f"Series do not end at {row.n} cutoffs, the first of them {row.first}")


def to_model_file(forecasts: DataFrame, model: str) -> DataFrame:
    """Per-model layout: ``unique_id, ds, <alias>, <alias>-q-<level>…, cutoff``."""
    alias = get_model(model).alias
    levels = scoring.quantile_levels(forecasts.columns)
    return forecasts.where(F.col("model") == model).select(
        "unique_id",
        "ds",
        F.col("yhat").alias(alias),
        *[F.col(scoring.quantile_column(q)).alias(f"{alias}-q-{q}") for q in levels],
        cal.hour_key(F.col("cutoff")).alias("cutoff"),
    )


def from_model_file(df: DataFrame, model: str, freq: str | cal.Frequency) -> DataFrame:
    """Read the per-model layout back; the alias comes from the quantile columns."""
    alias = scoring.detect_alias(df.columns)
    if alias is None:
        raise ValueError(f"Could not detect model alias from columns {df.columns}")

    def column(name: str) -> Column:
        return F.col(f"`{name}`")

    return df.select(
        F.lit(model).alias("model"),
        F.lit(alias).alias("model_alias"),
        F.lit(cal.frequency(freq).name).alias("frequency"),
        cal.parse_cutoff(F.col("cutoff")).alias("cutoff"),
        "unique_id",
        "ds",
        column(alias).alias("yhat"),
        *[
            column(f"{alias}-q-{q}").alias(scoring.quantile_column(q))
            for q in scoring.aliased_levels(df.columns, alias)
        ],
    )
