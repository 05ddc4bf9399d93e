"""Queries over calendar series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.base import query, steady
from scriptorium.functions import calendar
from scriptorium.operators import learn, series, windows
from scriptorium.plans import adapters, forecasting

#: Days ahead that the daily model is trained for.
DAYS_AHEAD = range(1, 93)


def _daily(spark, sf):
    return series.densify(adapters.daily_series(spark, sf), "key", "day", "n", "day")


def _monthly(spark, sf):
    return series.densify(adapters.monthly_series(spark, sf), "key", "month", "n", "month")


def _features(spark, sf):
    return windows.rolling_features(_daily(spark, sf), "key", "day", "n", "day")


@query("t1_densify_daily", f"WITH {sql.DAILY} SELECT key, CAST(d AS VARCHAR) AS day, n FROM dense")
def t1_daily(spark, sf):
    return _daily(spark, sf).withColumn("day", F.col("day").cast("string"))


@query(
    "t1_densify_monthly",
    f"WITH {sql.MONTHLY} SELECT CAST(key AS BIGINT) AS key, CAST(d AS VARCHAR) AS month, n FROM dense",
)
def t1_monthly(spark, sf):
    return _monthly(spark, sf).select(
        F.col("key").cast("bigint").alias("key"), F.col("month").cast("string").alias("month"), "n"
    )


_W = "OVER (PARTITION BY key ORDER BY d"
_FEATURES_SQL = f"""features AS (
  SELECT key, d, t, n,
    CASE WHEN t >= 28 THEN lag(n, 0) {_W}) END AS lag_1, CASE WHEN t >= 28 THEN lag(n, 6) {_W}) END AS lag_7,
    CASE WHEN t >= 28 THEN lag(n, 13) {_W}) END AS lag_14, CASE WHEN t >= 28 THEN lag(n, 27) {_W}) END AS lag_28,
    CASE WHEN t >= 28 THEN avg(n) {_W} ROWS 6 PRECEDING) END AS roll_mean_7,
    CASE WHEN t >= 28 THEN avg(n) {_W} ROWS 27 PRECEDING) END AS roll_mean_28,
    CASE WHEN t >= 28 THEN stddev_pop(n) {_W} ROWS 6 PRECEDING) END AS roll_std_7,
    CASE WHEN t >= 28 THEN n - lag(n, 6) {_W}) END AS trend_7
  FROM dense)"""


@query(
    "w4_lag_features",
    f"""WITH {sql.DAILY}, {_FEATURES_SQL} SELECT key, CAST(d AS VARCHAR) AS day, CAST(lag_1 AS DOUBLE) AS lag_1,
    CAST(lag_7 AS DOUBLE) AS lag_7, CAST(lag_14 AS DOUBLE) AS lag_14, CAST(lag_28 AS DOUBLE) AS lag_28 FROM features""",
)
def w4(spark, sf):
    return _features(spark, sf).select(
        "key", F.col("day").cast("string").alias("day"), "lag_1", "lag_7", "lag_14", "lag_28"
    )


@query(
    "w5_rolling_features",
    f"""WITH {sql.DAILY}, {_FEATURES_SQL} SELECT key, CAST(d AS VARCHAR) AS day, round(roll_mean_7 + 1e-9, 5) AS roll_mean_7,
    round(roll_mean_28 + 1e-9, 5) AS roll_mean_28, round(roll_std_7 + 1e-9, 5) AS roll_std_7, CAST(trend_7 AS DOUBLE) AS trend_7 FROM features""",
)
def w5(spark, sf):
    return _features(spark, sf).select(
        "key",
        F.col("day").cast("string").alias("day"),
        steady("roll_mean_7", 5).alias("roll_mean_7"),
        steady("roll_mean_28", 5).alias("roll_mean_28"),
        steady("roll_std_7", 5).alias("roll_std_7"),
        "trend_7",
    )


@query(
    "w5_rolling_features_monthly",
    f"""WITH {sql.MONTHLY} SELECT CAST(key AS BIGINT) AS key, CAST(d AS VARCHAR) AS month,
    CASE WHEN t >= 12 THEN CAST(lag(n, 11) {_W}) AS DOUBLE) END AS lag_12,
    CASE WHEN t >= 12 THEN round(avg(n) {_W} ROWS 11 PRECEDING) + 1e-9, 5) END AS roll_mean_12,
    CASE WHEN t >= 12 THEN round(stddev_pop(n) {_W} ROWS 2 PRECEDING) + 1e-9, 5) END AS roll_std_3,
    CASE WHEN t >= 12 THEN CAST(n - lag(n, 2) {_W}) AS DOUBLE) END AS trend_3 FROM dense""",
)
def w5_monthly(spark, sf):
    features = windows.rolling_features(_monthly(spark, sf), "key", "month", "n", "month")
    return features.select(
        F.col("key").cast("bigint").alias("key"),
        F.col("month").cast("string").alias("month"),
        "lag_12",
        steady("roll_mean_12", 5).alias("roll_mean_12"),
        steady("roll_std_3", 5).alias("roll_std_3"),
        "trend_3",
    )


def _supervised(spark, sf):
    return series.supervised(_features(spark, sf), "key", "day", "n", DAYS_AHEAD, "day")


_SUPERVISED_SQL = f"""{sql.DAILY}, {_FEATURES_SQL}, horizons AS (SELECT unnest(generate_series(1, 92)) AS horizon),
supervised AS (SELECT f.key, f.d, h.horizon, f.lag_1, f.roll_mean_28, g.n AS y, g.d AS target
  FROM features f CROSS JOIN horizons h JOIN dense g ON g.key = f.key AND g.t = f.t + h.horizon WHERE f.t >= 28)"""


@query(
    "t2_supervised",
    f"""WITH {_SUPERVISED_SQL} SELECT key, CAST(d AS VARCHAR) AS day, CAST(horizon AS INT) AS horizon, CAST(y AS DOUBLE) AS y,
    CAST(lag_1 AS DOUBLE) AS lag_1, round(roll_mean_28 + 1e-9, 5) AS roll_mean_28, CAST(target AS VARCHAR) AS target_date,
    round(sin(2 * pi() * (isodow(target) - 1) / 7), 6) + 0.0 AS dow_sin, isodow(target) >= 6 AS weekend FROM supervised""",
)
def t2(spark, sf):
    return _supervised(spark, sf).select(
        "key",
        F.col("day").cast("string").alias("day"),
        "horizon",
        "y",
        "lag_1",
        steady("roll_mean_28", 5).alias("roll_mean_28"),
        F.col("target_date").cast("string").alias("target_date"),
        (F.round("dow_sin", 6) + 0.0).alias("dow_sin"),
        (F.col("is_weekend") == 1).alias("weekend"),
    )


@query(
    "t3_encode_keys",
    """SELECT event_type AS key, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS key_code
       FROM (SELECT DISTINCT concat(event_type, user_id) AS event_type FROM events)""",
)
def t3(spark, sf):
    keys = adapters.table(spark, sf, "events").select(
        F.concat("event_type", F.col("user_id").cast("string")).alias("key")
    )
    return series.encode_keys(keys, "key")


@query(
    "w8_temporal_folds",
    f"""WITH {_SUPERVISED_SQL}, o AS (SELECT DISTINCT d FROM supervised),
    r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS total FROM o),
    f AS (SELECT r.*, fold, total - (total // 5) * (4 - fold) AS start FROM r CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS fold))
    SELECT fold, CAST(d AS VARCHAR) AS day, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role
    FROM f WHERE pos < start + total // 5""",
)
def w8(spark, sf):
    folds = windows.temporal_folds(_supervised(spark, sf), "day", 4)
    return folds.withColumn("day", F.col("day").cast("string"))


@query(
    "t4_embargo",
    f"""WITH {_SUPERVISED_SQL}, o AS (SELECT DISTINCT d FROM supervised),
    r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS total FROM o),
    f AS (SELECT r.*, fold, total - (total // 5) * (4 - fold) AS start FROM r CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS fold)),
    p AS (SELECT s.*, fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role FROM supervised s JOIN f ON f.d = s.d
          WHERE pos < start + total // 5),
    m AS (SELECT fold, min(target) AS first_test FROM p WHERE role = 'test' GROUP BY 1)
    SELECT p.fold, role, count(*) AS n, CAST(sum(y) AS DOUBLE) AS total FROM p JOIN m ON m.fold = p.fold
    WHERE role = 'test' OR target < first_test GROUP BY 1, 2""",
)
def t4_embargo(spark, sf):
    rows = _supervised(spark, sf)
    placed = learn.embargoed(rows, windows.temporal_folds(rows, "day", 4), "day")
    return placed.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")
    )


@query("t4_backtest")
def t4(spark, sf):
    """Metrics per fold; boosted trees have no SQL."""
    rows = forecasting.training_rows(
        adapters.daily_series(spark, sf), "key", "day", "n", "day", DAYS_AHEAD
    )
    return learn.backtest(rows, series.model_columns("day"), "day", iterations=10)


_LAST = "last AS (SELECT key, max(d) AS last_date, max(t) AS last_t FROM dense GROUP BY key)"


@query(
    "t6_seasonal_naive",
    f"""WITH {sql.DAILY}, {_LAST}, h AS (SELECT unnest(generate_series(1, 92)) AS horizon),
    w AS (SELECT key, last_t, horizon, last_t + horizon - 7 * CAST(ceil(horizon / 7.0) AS BIGINT) AS src FROM last CROSS JOIN h)
    SELECT w.key, CAST(horizon AS INT) AS horizon, CAST(n AS DOUBLE) AS prediction FROM w JOIN dense x
    ON x.key = w.key AND x.t = CASE WHEN src < 0 THEN last_t ELSE src END""",
)
def t6(spark, sf):
    return series.seasonal_naive(_daily(spark, sf), "key", "day", "n", DAYS_AHEAD, "day")


@query(
    "t6_seasonal_naive_monthly",
    f"""WITH {sql.MONTHLY}, {_LAST}, h AS (SELECT unnest(generate_series(1, 12)) AS horizon),
    w AS (SELECT key, last_t, horizon, last_t + horizon - 12 * CAST(ceil(horizon / 12.0) AS BIGINT) AS src FROM last CROSS JOIN h)
    SELECT CAST(w.key AS BIGINT) AS key, CAST(horizon AS INT) AS horizon, CAST(n AS DOUBLE) AS prediction FROM w JOIN dense x
    ON x.key = w.key AND x.t = CASE WHEN src < 0 THEN last_t ELSE src END""",
)
def t6_monthly(spark, sf):
    naive = series.seasonal_naive(_monthly(spark, sf), "key", "month", "n", range(1, 13), "month")
    return naive.withColumn("key", F.col("key").cast("bigint"))


@query(
    "t8_aggregate_horizons",
    f"""WITH {sql.MONTHLY}, {_LAST}, h AS (SELECT unnest(generate_series(1, 12)) AS horizon),
    w AS (SELECT key, last_date, last_t, horizon, last_t + horizon - 12 * CAST(ceil(horizon / 12.0) AS BIGINT) AS src FROM last CROSS JOIN h),
    p AS (SELECT w.key, last_date, horizon, n FROM w JOIN dense x ON x.key = w.key AND x.t = CASE WHEN src < 0 THEN last_t ELSE src END),
    s AS (SELECT unnest(['month_1', 'month_3', 'year_1']) AS horizon_label, unnest([1, 3, 12]) AS span)
    SELECT CAST(key AS BIGINT) AS key, horizon_label, CAST(CAST(last_date + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS window_start,
      CAST(CAST(last_date + to_months(CAST(span AS INT)) AS DATE) AS VARCHAR) AS window_end, CAST(sum(n) AS DOUBLE) AS prediction, 'descriptive' AS served_mode
    FROM p JOIN s ON horizon <= span GROUP BY 1, 2, 3, 4""",
)
def t8(spark, sf):
    dense = _monthly(spark, sf)
    totals = series.aggregate_horizons(
        series.seasonal_naive(dense, "key", "month", "n", range(1, 13), "month"),
        series.last_origin(dense, "key", "month"),
        "key",
        "month",
    )
    return totals.select(
        F.col("key").cast("bigint").alias("key"),
        "horizon_label",
        F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"),
        "prediction",
        "served_mode",
    )


@query("t7_forecast")
def t7(spark, sf):
    """Gate, then model or seasonal forecast, then window totals."""
    result = forecasting.forecast(
        adapters.monthly_series(spark, sf),
        "key",
        "month",
        "n",
        "month",
        iterations=3,
    )
    return result.windows.select(
        "key",
        "horizon_label",
        F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"),
        F.round("prediction", 3).alias("prediction"),
        "served_mode",
    )


# ---- calendar functions ------------------------------------------------------------------
@query(
    "x9_month_arithmetic",
    """SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS month_index,
       strftime(o_orderdate - INTERVAL 1 MONTH, '%Y%m') AS last_complete FROM orders""",
)
def x9(spark, sf):
    day = F.to_date("o_orderdate")
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey",
        calendar.month_index(day).alias("month_index"),
        calendar.last_complete_month(day).alias("last_complete"),
    )


@query(
    "x10_calendar_buckets",
    """SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week,
       CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter FROM orders""",
)
def x10(spark, sf):
    ts = F.col("o_orderdate").cast("timestamp")
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey",
        calendar.bucket_date(ts, "week").cast("string").alias("week"),
        calendar.bucket_date(ts, "quarter").cast("string").alias("quarter"),
    )


@query(
    "x11_cyclic_features",
    """SELECT o_orderkey, round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS dow_sin,
       round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos,
       round(sin(2 * pi() * week(o_orderdate) / 53), 6) + 0.0 AS isoweek_sin,
       CASE WHEN isodow(o_orderdate) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend FROM orders""",
)
def x11(spark, sf):
    features = calendar.cyclic_features(F.to_date("o_orderdate"))
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey",
        *[(F.round(features[n], 6) + 0.0).alias(n) for n in ("dow_sin", "month_cos", "isoweek_sin")],
        features["is_weekend"].alias("is_weekend"),
    )


@query(
    "x12_stamps",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS instant
       FROM events""",
)
def x12(spark, sf):
    events = adapters.table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789+02:00")).alias("iso"),
    )
    return events.select(
        "event_id",
        calendar.stamp_to_date(F.col("stamp")).cast("string").alias("day"),
        F.date_format(calendar.parse_instant(F.col("iso")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("instant"),
    )
