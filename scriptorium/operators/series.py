"""Calendar series: densify, supervise, seasonal forecast, horizon totals.

A series has one row per key and calendar date, so per-key windows are bounded by the
length of the calendar whatever the number of source rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scriptorium.functions import calendar
from scriptorium.operators import windows
from scriptorium.session import materialize

# ---- fixed values --------------------------------------------------------------------
SEASON = {"day": 7, "month": 12}
HORIZON_WINDOWS = {
    "day": {"week": 7, "month": 30, "quarter": 92},
    "month": {"month_1": 1, "month_3": 3, "year_1": 12},
}
PREDICTIVE, DESCRIPTIVE = "predictive", "descriptive"
# -------------------------------------------------------------------------------------


def shift(day: Column, steps: Column | int, unit: str) -> Column:
    """A date moved by days or months."""
    return F.date_add(day, steps) if unit == "day" else F.add_months(day, steps)


def densify(df: DataFrame, key: str, time: str, value: str, unit: str = "day") -> DataFrame:
    """Every date from a key's first to last, missing ones with 0.

    Each row spans the gap to its successor and is exploded over it: one window, no
    calendar join.
    """
    points = df.groupBy(key, time).agg(F.sum(value).alias(value))
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time))
    end = F.coalesce(shift(following, -1, unit), F.col(time))
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    spread = points.withColumn("_end", end).select(
        key, value, F.posexplode(F.sequence(F.col(time), F.col("_end"), step)).alias("_i", time)
    )
    return spread.select(
        key, time, F.when(F.col("_i") == 0, F.col(value)).otherwise(F.lit(0)).alias(value)
    )


def supervised(
    features: DataFrame,
    key: str,
    time: str,
    value: str,
    horizons: Sequence[int],
    unit: str = "day",
    min_history: int | None = None,
) -> DataFrame:
    """One row per origin with enough history, horizon and observed target.

    ``features`` as ``windows.rolling_features`` returns them.  Targets come from a frame
    of following rows in the same sort as the features, not from a self-join.
    """
    spec = windows.FEATURE_WINDOWS[unit]
    needed = max(*spec["lags"], *spec["means"]) if min_history is None else min_history
    order = Window.partitionBy(key).orderBy(time)
    ahead = F.collect_list(F.col(value).cast("double")).over(order.rowsBetween(1, max(horizons)))
    rows = (
        features.withColumn("_ahead", ahead)
        .where(F.col("t") >= needed)
        .select(
            *[c for c in features.columns if c != value],
            F.posexplode("_ahead").alias("_h", "y"),
        )
        .withColumn("horizon", F.col("_h") + 1)
        .drop("_h")
    )
    if list(horizons) != list(range(1, max(horizons) + 1)):
        rows = rows.where(F.col("horizon").isin(*horizons))
    return with_calendar(rows, time, unit)


def with_calendar(rows: DataFrame, time: str, unit: str) -> DataFrame:
    """Adds the target date and its cyclic features."""
    dated = rows.withColumn("target_date", shift(F.col(time), F.col("horizon"), unit))
    for name, column in calendar.cyclic_features(F.col("target_date"), unit).items():
        dated = dated.withColumn(name, column)
    return dated


def model_columns(unit: str = "day", spec: dict | None = None) -> list[str]:
    """Feature order of the forecasting model."""
    cyclic = list(calendar.cyclic_features(F.lit(None).cast("date"), unit))
    return ["horizon", *cyclic, *windows.feature_names(unit, spec), "key_code"]


def encode_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, key_code): lexical rank from 0 of each distinct key.

    Keys are range partitioned and ranked inside their partition; only the partition
    sizes are cumulated together.  The partitioned keys are written first, so a lost
    executor cannot change the ranges in between.
    """
    ranged = materialize(
        df.select(key)
        .distinct()
        .repartitionByRange(key)
        .withColumn("_part", F.spark_partition_id()),
        "keys",
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.join(offsets, "_part").select(
        key, (inside + F.col("_offset")).cast("int").alias("key_code")
    )


def last_origin(series: DataFrame, key: str, time: str) -> DataFrame:
    """(key, last date)."""
    return series.groupBy(key).agg(F.max(time).alias("last_date"))


def seasonal_naive(
    dense: DataFrame, key: str, time: str, value: str, horizons: Sequence[int], unit: str = "day",
    season: int | None = None,
) -> DataFrame:
    """(key, horizon, prediction): most recent known value of the same season.

    For horizon h the source lies ``season * ceil(h / season) - h`` dates before the last;
    a series too short for that repeats its last value.  Never negative.
    """
    period = season or SEASON[unit]
    per_key = Window.partitionBy(key)
    recent = (
        dense.withColumn("_t", F.row_number().over(per_key.orderBy(time)) - 1)
        .withColumn("_last", F.max("_t").over(per_key))
        .where(F.col("_last") - F.col("_t") < period)
        .select(key, (F.col("_last") - F.col("_t")).alias("_back"), "_last", value)
    )
    asked = (
        recent.where(F.col("_back") == 0)
        .select(key, "_last", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
        .withColumn("_want", F.ceil(F.col("horizon") / period) * period - F.col("horizon"))
        .withColumn(
            "_back", F.when(F.col("_want") > F.col("_last"), 0).otherwise(F.col("_want")).cast("int")
        )
    )
    return asked.join(recent.select(key, "_back", value), [key, "_back"]).select(
        key, "horizon", F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("prediction")
    )


def aggregate_horizons(
    predictions: DataFrame,
    last: DataFrame,
    key: str,
    unit: str = "day",
    spans: Mapping[str, int] | None = None,
    mode: str = DESCRIPTIVE,
) -> DataFrame:
    """Sum of the predictions of each business window, which starts after the last date."""
    spans = spans or HORIZON_WINDOWS[unit]
    choices = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(span).alias("span"))
            for label, span in spans.items()
        ]
    )
    totals = (
        predictions.withColumn("w", F.explode(choices))
        .where(F.col("horizon") <= F.col("w.span"))
        .groupBy(key, F.col("w.label").alias("horizon_label"), F.col("w.span").alias("span"))
        .agg(F.greatest(F.sum("prediction"), F.lit(0.0)).alias("prediction"))
    )
    end = shift(F.col("last_date"), F.col("span"), unit)
    return totals.join(last, key).select(
        key,
        "horizon_label",
        shift(F.col("last_date"), 1, unit).alias("window_start"),
        end.alias("window_end"),
        "prediction",
        F.lit(mode).alias("served_mode"),
    )
