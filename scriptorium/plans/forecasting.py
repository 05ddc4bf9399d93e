"""Forecast pipeline: series to validated, window-aggregated predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import learn, series, windows
from scriptorium.session import materialize


@dataclass(frozen=True)
class Forecast:
    """Window totals, the metrics behind the gate, and the served mode."""

    windows: DataFrame
    metrics: DataFrame
    mode: str


def _prepared(df, key, time, value, unit, spec, min_history):
    dense = series.densify(df, key, time, value, unit)
    return dense, windows.rolling_features(dense, key, time, value, unit, spec, min_history)


def training_rows(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    unit: str,
    horizons: Sequence[int],
    spec: dict | None = None,
    min_history: int | None = None,
) -> DataFrame:
    """Supervised rows with the key's code, ready for a model."""
    _, features = _prepared(df, key, time, value, unit, spec, min_history)
    rows = series.supervised(features, key, time, value, horizons, unit, min_history)
    return rows.join(series.encode_keys(df, key), key)


def forecast(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    unit: str = "day",
    folds: int = 4,
    iterations: int = learn.MAX_ITERATIONS,
    spec: dict | None = None,
    min_history: int | None = None,
) -> Forecast:
    """Validate, gate, then predict with the model or fall back to the seasonal forecast.

    Only the averaged metrics reach the driver.  Keys without enough history get no model
    prediction.
    """
    spans = series.HORIZON_WINDOWS[unit]
    horizons = range(1, max(spans.values()) + 1)
    dense, features = _prepared(df, key, time, value, unit, spec, min_history)
    codes = materialize(series.encode_keys(df, key), "codes")
    columns = series.model_columns(unit, spec)
    rows = materialize(
        series.supervised(features, key, time, value, horizons, unit, min_history).join(codes, key),
        "supervised",
    )
    metrics = materialize(learn.backtest(rows, columns, time, folds, iterations), "metrics")
    mode = learn.serve_mode(metrics)
    last = series.last_origin(dense, key, time)
    if mode == series.PREDICTIVE:
        model = learn.fit_final(learn.assemble(rows, columns), iterations)
        ready = features.join(last.withColumnRenamed("last_date", time), [key, time], "left_semi").where(
            F.col(windows.feature_names(unit, spec)[0]).isNotNull()
        )
        asked = series.with_calendar(
            ready.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))), time, unit
        ).join(codes, key)
        predictions = model.transform(learn.assemble(asked, columns)).select(
            key, "horizon", F.greatest("prediction", F.lit(0.0)).alias("prediction")
        )
    else:
        predictions = series.seasonal_naive(dense, key, time, value, horizons, unit)
    return Forecast(
        series.aggregate_horizons(predictions, last, key, unit, spans, mode), metrics, mode
    )
