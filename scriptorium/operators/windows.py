"""Window operators whose partitions are bounded: a calendar, a top-k, a grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scriptorium.operators import aggregates

# ---- fixed values --------------------------------------------------------------------
ROLLING_DAYS = 30
TOP_LABELS = 5
#: Lags, rolling means, deviation and trend windows, by calendar unit.
FEATURE_WINDOWS = {
    "day": {"lags": (1, 7, 14, 28), "means": (7, 28), "deviation": 7, "trend": 7},
    "month": {"lags": (1, 2, 3, 12), "means": (3, 12), "deviation": 3, "trend": 3},
}
SEED = 42
# -------------------------------------------------------------------------------------


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key with their ``rank``.

    Spark turns ``row_number() <= n`` into a group limit that also runs before the
    shuffle, so a hot key sends at most n rows per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def top_partners(predictions: DataFrame, n: int) -> DataFrame:
    """Best partners of every author: both directions, uplift desc, partner asc."""
    forward = predictions.select(
        F.col("author_a").alias("author_id"), F.col("author_b").alias("partner_id"), "uplift"
    )
    backward = predictions.select(
        F.col("author_b").alias("author_id"), F.col("author_a").alias("partner_id"), "uplift"
    )
    return top_per_group(
        forward.unionAll(backward), ["author_id"], [F.desc("uplift"), F.asc("partner_id")], n
    )


def unique_grain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``unique_grain``: does this row's key occur once.

    Keys are counted with partial aggregates and joined back, so a key repeated without
    bound does not gather in one window partition.
    """
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) == 1).alias("unique_grain"))
    return df.join(counts, list(keys))


def top_labels(profiles: DataFrame, prefix: str, n: int = TOP_LABELS, key: str = "researcher_id") -> DataFrame:
    """Heaviest labels of a profile within one level."""
    level = profiles.where(F.col("dim").startswith(f"{prefix}::"))
    return top_per_group(level, [key], [F.desc("weight"), F.asc("dim")], n)


def rolling_features(
    series: DataFrame,
    key: str,
    time: str,
    value: str,
    unit: str = "day",
    windows: dict | None = None,
    min_history: int | None = None,
) -> DataFrame:
    """Past-only features of a dense series at each of its dates.

    ``lag_k`` is the value at t - (k - 1), so ``lag_1`` is t itself; means and population
    deviation end at t; the trend compares t with the start of its window.  All are null
    until ``min_history`` earlier dates exist.  One sort per key serves every feature; a
    key has one row per calendar date.
    """
    spec = windows or FEATURE_WINDOWS[unit]
    needed = max(*spec["lags"], *spec["means"]) if min_history is None else min_history
    order = Window.partitionBy(key).orderBy(time)

    def trailing(width: int) -> Window:
        return order.rowsBetween(1 - width, 0)

    v = F.col(value).cast("double")
    features = {
        **{f"lag_{k}": F.lag(v, k - 1).over(order) for k in spec["lags"]},
        **{f"roll_mean_{w}": F.avg(v).over(trailing(w)) for w in spec["means"]},
        f"roll_std_{spec['deviation']}": F.stddev_pop(v).over(trailing(spec["deviation"])),
        f"trend_{spec['trend']}": v - F.lag(v, spec["trend"] - 1).over(order),
    }
    indexed = series.withColumn("t", F.row_number().over(order) - 1)
    for name, column in features.items():
        indexed = indexed.withColumn(name, column)
    ready = F.col("t") >= needed
    return indexed.select(
        key, time, value, "t", *[F.when(ready, F.col(name)).alias(name) for name in features]
    )


def feature_names(unit: str = "day", windows: dict | None = None) -> list[str]:
    spec = windows or FEATURE_WINDOWS[unit]
    return [
        *[f"lag_{k}" for k in spec["lags"]],
        *[f"roll_mean_{w}" for w in spec["means"]],
        f"roll_std_{spec['deviation']}",
        f"trend_{spec['trend']}",
    ]


def rolling_kpis(logs: DataFrame, days: int = ROLLING_DAYS) -> DataFrame:
    """Activity over ``(t - days, t]`` at every midnight t from first day + days on.

    The last point is the midnight of the last entry's day.  Exact distinct counts
    without a range join: an entry is visible at ``days`` consecutive midnights from the
    first one not before it.  Per identity, consecutive visibility intervals are merged
    end to end, so each contributes +1 where it starts and -1 where it ends, and a
    running sum over the calendar counts the identities present.  Rows shrink to one per
    identity and day before the first shuffle ends.
    """
    first_visible = F.to_date(
        F.date_trunc("day", F.col("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
        + F.expr("INTERVAL 1 DAY")
    )
    visible = logs.withColumn("day", first_visible)
    daily = visible.groupBy("day").agg(*aggregates.activity_counters())
    counters = [c for c in daily.columns if c != "day"]
    count_steps = daily.select("day", *counters).unionByName(
        daily.select(
            F.date_add("day", days).alias("day"), *[(-F.col(c)).alias(c) for c in counters]
        )
    )

    identities = aggregates.activity_identities()
    seen = (
        visible.select(
            "day",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("what"), value.alias("who"))
                        for name, value in identities.items()
                    ]
                )
            ).alias("i"),
        )
        .select("day", "i.what", "i.who")
        .where(F.col("who").isNotNull())
        .distinct()
    )
    following = F.lead("day").over(Window.partitionBy("what", "who").orderBy("day"))
    end = F.least(F.date_add("day", days), F.coalesce(following, F.date_add("day", days)))
    steps = seen.select("what", F.col("day").alias("start"), end.alias("end")).select(
        "what",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("day"), F.lit(1).alias("step")),
                F.struct(F.col("end").alias("day"), F.lit(-1).alias("step")),
            )
        ).alias("s"),
    )
    identity_steps = steps.groupBy(F.col("s.day").alias("day")).agg(
        *[
            F.sum(F.when(F.col("what") == name, F.col("s.step")).otherwise(0)).alias(name)
            for name in identities
        ]
    )

    span = logs.agg(
        F.to_date(F.min("timestamp")).alias("first"), F.to_date(F.max("timestamp")).alias("last")
    )
    spine = span.where(F.date_add("first", days) <= F.col("last")).select(
        F.explode(F.sequence("first", "last")).alias("day"),
        F.date_add("first", days).alias("from_day"),
    )
    everything = [*counters, *identities]
    changes = (
        count_steps.groupBy("day")
        .agg(*[F.sum(c).alias(c) for c in counters])
        .join(identity_steps, "day", "full")
    )
    # The calendar has one row per day, so this running sum is small however many entries.
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    points = (
        spine.join(changes, "day", "left")
        .select(
            F.col("day").alias("date"),
            "from_day",
            *[
                F.sum(F.coalesce(F.col(c), F.lit(0))).over(running).cast("bigint").alias(c)
                for c in everything
            ],
        )
        .where(F.col("date") >= F.col("from_day"))
    )
    return points.withColumn(
        "users_total", F.col("users_logged") + F.col("users_surveyed")
    ).select(*aggregates.POINT_COLUMNS)


def temporal_folds(df: DataFrame, origin: str, n: int = 4) -> DataFrame:
    """Expanding-window folds over distinct origins: (fold, origin, role).

    The last ``n`` blocks of ``D // (n + 1)`` origins are test blocks; each trains on all
    earlier origins.  With too few origins there are no folds.  Origins are calendar
    dates, so the ranked table is small whatever the data.
    """
    origins = df.select(origin).distinct()
    ranked = origins.select(
        origin,
        (F.row_number().over(Window.orderBy(origin)) - 1).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("total"),
    )
    size = F.floor(F.col("total") / (n + 1))
    folded = (
        ranked.where(F.col("total") >= n + 1)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("start", F.col("total") - size * (n - F.col("fold")))
    )
    return folded.where(F.col("pos") < F.col("start") + size).select(
        "fold",
        origin,
        F.when(F.col("pos") < F.col("start"), "train").otherwise("test").alias("role"),
    )


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Adds ``fold``: all rows of a group share one, spread evenly by a seeded hash."""
    return df.withColumn("fold", (_seeded([group], SEED) % k).cast("int"))


def _seeded(keys: Sequence[str], seed: int) -> Column:
    """A number from the keys and the seed that any engine with MD5 can repeat: its first 60 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def stable_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order by grain key; only for a sink or a report."""
    return df.orderBy(*keys)


def top_matches(df: DataFrame, field: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The n best rows overall; each task keeps n, the driver never sees more."""
    return df.orderBy(F.desc(field), *ties).limit(n)


def capped(df: DataFrame, order: Sequence[Column | str], cap: int) -> DataFrame:
    """First ``cap`` rows in order; 0 keeps all."""
    ordered = df.orderBy(*order)
    return ordered.limit(cap) if cap > 0 else ordered


def sample_labels(df: DataFrame, keys: Sequence[str], cap: int, seed: int = SEED) -> DataFrame:
    """Reproducible sample without replacement: the ``cap`` smallest key hashes.

    0 keeps everything.  The choice depends on keys and seed only, not on partitioning.
    """
    if cap <= 0:
        return df
    shuffled = df.withColumn("_h", _seeded(keys, seed))
    return shuffled.orderBy("_h", *keys).limit(cap).drop("_h")
