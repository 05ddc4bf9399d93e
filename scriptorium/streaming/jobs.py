"""Streaming sources, windows, duplicate removal, late data and stateful operators.

Every job keeps its progress in a checkpoint folder, so a lost executor or driver resumes
where it stopped.  State is bounded by a watermark or by an explicit time to live.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.functions import text
from scriptorium.operators import aggregates, joins, reshape, windows
from scriptorium.sources import scans, selection

# ---- fixed values --------------------------------------------------------------------
FILES_PER_TRIGGER = 96
COOLDOWN_SECONDS = 6 * 3600
VERDICT_SCHEMA_VERSION = 1
RUN_KEY_PREFIX = "drift-retrain:"
NEVER = "never"
DECIDED = ("accepted", "rejected")
#: What a row of the rolling counters holds besides identities.
ACTIONS = "actions"
# -------------------------------------------------------------------------------------


def _timeout(ttl_ms: int | None) -> str:
    """Processing-time expiry when a time to live is given.

    A job that expires by processing time never runs dry, so give one only to streams
    with a continuous trigger; a drain (``availableNow``) keeps one small row per key.
    """
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _keep(state: GroupState, value: tuple, ttl_ms: int | None) -> None:
    state.update(value)
    if ttl_ms is not None:
        state.setTimeoutDuration(ttl_ms)


# ---- sources and sinks ---------------------------------------------------------------
def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    max_files: int = FILES_PER_TRIGGER,
    **options: str,
) -> DataFrame:
    """New files of a folder, at most ``max_files`` per trigger; progress is the checkpoint."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .options(maxFilesPerTrigger=str(max_files), **options)
        .load(path)
    )


def news_stream(spark: SparkSession, path: str, max_files: int = FILES_PER_TRIGGER) -> DataFrame:
    """Native news rows from arriving text files."""
    lines = file_stream(
        spark, path, T.StructType([T.StructField("value", T.StringType())]), "text", max_files
    )
    return scans.parse_native_news(lines)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, partition: Sequence[str] = ()) -> None:
    """Process everything available, appending exactly once to Parquet, then stop."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    (writer.partitionBy(*partition) if partition else writer).start().awaitTermination()


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process everything available, handing each micro-batch to ``handle``."""
    (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


# ---- windows ---------------------------------------------------------------------------
def tumbling_counts(
    stream: DataFrame, time: str, width: str, delay: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per event-time window and key, emitted once the watermark passes the window."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *keys,
            "n",
        )
    )


def rolling_counters(
    logs: DataFrame, delay: str, path: str, checkpoint: str, days: int = windows.ROLLING_DAYS
) -> None:
    """Keep below ``path`` what :func:`rolling_points` reads: the points of ``windows.rolling_kpis`` at
    every midnight t, over ``(t - days, t]``, once the watermark passes it.

    Exact, without a copy of an identity for every window: the stream closes days, each with its
    counters and its distinct users, respondents and projects.  Of an identity's day only the
    midnights count that its day before does not reach, so a closed day is looked up among the
    ``days`` before it and leaves a histogram of spans (``spans``), as small as the calendar.
    Days close in order, and replaying a batch rewrites its own folders only.  Event time moves
    back by the smallest unit, because Spark windows are closed on the left.
    """
    spark = logs.sparkSession
    identities = aggregates.activity_identities()
    seen = [F.struct(F.lit(name).alias("what"), who.alias("who")) for name, who in identities.items()]
    entries = (
        logs.withColumn("event_time", F.col("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
        .withWatermark("event_time", delay)
        .withColumn("i", F.explode(F.array(F.struct(F.lit(ACTIONS).alias("what"), F.lit("").alias("who")), *seen)))
        .where(F.col("i.who").isNotNull())
    )
    daily = entries.groupBy(F.window("event_time", "1 day").alias("span"), "i.what", "i.who").agg(
        *aggregates.activity_counters()
    )
    closed = daily.withColumn("day", F.to_date("span.start")).select("what", "who", "day", *_counters())

    def handle(batch: DataFrame, number: int) -> None:
        label = f"{number:012d}"
        _overwrite(batch.withColumn("batch", F.lit(label)), f"{path}/days", ["batch"])
        kept = _rolling_days(batch.sparkSession, path).where(F.col("what") != ACTIONS)
        now = kept.where(F.col("batch") == label).select("what", "who", "day", F.lit(True).alias("new"))
        horizon = now.agg(F.date_sub(F.min("day"), days).alias("horizon")).scalar()
        before = kept.where((F.col("batch") < label) & (F.col("day") > horizon))
        before = before.groupBy("what", "who").agg(F.max("day").alias("day"), F.lit(False).alias("new"))
        last = F.lag("day").over(Window.partitionBy("what", "who").orderBy("day"))
        spans = (
            now.union(before)
            .withColumn("since", F.date_add(F.greatest("day", F.date_add(last, days)), 1))
            .where("new")
            .groupBy("what", "since", F.date_add("day", days).alias("until"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        _overwrite(spans.withColumn("batch", F.lit(label)), f"{path}/spans", ["batch"])

    query = (
        closed.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    passed = spark.range(1).select(F.lit(max(marks, default=None)).cast("timestamp").alias("watermark"))
    passed.write.mode("append").parquet(f"{path}/passed")


def _counters() -> list[str]:
    return [c for c in aggregates.POINT_COLUMNS if c not in ("date", "users_total", *aggregates.activity_identities())]


def _rolling_days(spark: SparkSession, path: str) -> DataFrame:
    counters = ", ".join(f"{c} long" for c in _counters())
    return spark.read.schema(f"what string, who string, day date, {counters}, batch string").parquet(f"{path}/days")


def rolling_points(spark: SparkSession, path: str, days: int = windows.ROLLING_DAYS) -> DataFrame:
    """The points that :func:`rolling_counters` kept below ``path``; also the first ones, whose days are
    not all covered."""
    closed, counters = _rolling_days(spark, path).where(F.col("what") == ACTIONS), _counters()
    reached = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days))).alias("date")
    sums = closed.select(reached, *counters).groupBy("date").agg(*[F.sum(c).alias(c) for c in counters])
    spans = spark.read.schema("what string, since date, until date, n long, batch string").parquet(f"{path}/spans")
    names = list(aggregates.activity_identities())
    people = (
        spans.select("what", "n", F.explode(F.sequence("since", "until")).alias("date"))
        .groupBy("date")
        .agg(*[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in names])
    )
    passed = spark.read.parquet(f"{path}/passed").agg(F.to_date(F.max("watermark")).alias("passed")).scalar()
    points = sums.join(people, "date", "left").where(F.col("date") <= passed).fillna(0, names)
    return points.withColumn("users_total", F.col("users_logged") + F.col("users_surveyed")).select(
        *aggregates.POINT_COLUMNS
    )


def deduplicate(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First arrival per key; keys are forgotten once the watermark passes them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def enrich_mentions(native: DataFrame, referential: DataFrame) -> DataFrame:
    """Arriving news rows matched to the static referential."""
    return joins.university_mentions(
        reshape.stage_mentions(reshape.mentions(native)), referential
    )


# ---- late data ---------------------------------------------------------------------------
def rematerialise_days(
    stream: DataFrame, raw: str, mart: str, day: str, build: Callable[[DataFrame], DataFrame], checkpoint: str
) -> None:
    """Late rows rebuild their whole day as a new run; older runs stay untouched.

    Each micro-batch is kept under ``raw/dt=…/batch=…`` and every day it touches is built
    again from all its batches under ``mart/dt=…/run=…``.  Replaying a batch rewrites its
    own folders only.  Read with ``selection.read_latest``.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        label = f"{number:012d}"
        dated = batch.withColumn("dt", F.date_format(day, "yyyy-MM-dd")).withColumn(
            "batch", F.lit(label)
        )
        _overwrite(dated, raw, ["dt", "batch"])
        schema = T.StructType(
            [*batch.schema.fields, T.StructField("dt", T.StringType()), T.StructField("batch", T.StringType())]
        )
        kept = spark.read.schema(schema).parquet(raw)
        touched = kept.where(F.col("batch") == label).select("dt").distinct()
        rows = kept.where(F.col("batch") <= label).join(touched, "dt", "left_semi")
        _overwrite(build(rows).withColumn("run", F.lit(label)), mart, ["dt", "run"])

    run_batches(stream, handle, checkpoint)


def _overwrite(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition
    ).parquet(path)


def latest_days(spark: SparkSession, mart: str) -> DataFrame:
    """Current rows of every day of a re-materialised mart."""
    return selection.read_latest(spark, mart)


# ---- stateful review events ------------------------------------------------------------------
_EVENT_KEY = ["id", "entity", "field", "value"]


def carry_forward_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Arriving review events inherit the decision and extension stamp remembered per key.

    Events of one micro-batch see what earlier batches decided, not each other; the
    earliest decided and extended events of the batch (by ``position``) then enter the
    state.  A key's rows stream through in chunks; its state is four values.
    """
    out = T.StructType(
        [T.StructField(c, T.StringType()) for c in _EVENT_KEY]
        + [
            T.StructField("position", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("hasBeenExtendedAt", T.StringType()),
        ]
    )
    decided, never, keep = DECIDED, NEVER, _keep

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, extended = state.get if state.exists else (None, None)
        first_status = first_extended = None
        for chunk in chunks:
            ruled = chunk[chunk["status"].isin(decided)]
            if status is None and len(ruled):
                row = ruled.loc[ruled["position"].idxmin()]
                found = (int(row["position"]), row["status"])
                first_status = min(first_status or found, found)
            moved = chunk[chunk["hasBeenExtendedAt"] != never]
            if extended is None and len(moved):
                row = moved.loc[moved["position"].idxmin()]
                found = (int(row["position"]), row["hasBeenExtendedAt"])
                first_extended = min(first_extended or found, found)
            result = chunk[[*_EVENT_KEY, "position", "status", "hasBeenExtendedAt"]].copy()
            if status is not None:
                result["status"] = status
            if extended is not None:
                result["hasBeenExtendedAt"] = extended
            yield result
        memory = (
            status if status is not None else (first_status[1] if first_status else None),
            extended if extended is not None else (first_extended[1] if first_extended else None),
        )
        keep(state, memory, ttl_ms)

    return (
        events.select(*_EVENT_KEY, "position", "status", "hasBeenExtendedAt")
        .groupBy(*_EVENT_KEY)
        .applyInPandasWithState(
            update,
            out,
            "status string, extended string",
            "append",
            _timeout(ttl_ms),
        )
    )


# ---- triggers ----------------------------------------------------------------------------------
def retrainings(verdicts: pd.DataFrame, memory: tuple, cooldown: int = COOLDOWN_SECONDS) -> tuple[list[str], tuple]:
    """(run ids that start a retraining, what to remember) of one pipeline's new verdicts.

    ``memory``: the newest run id, and the watermark and time of the newest retraining.
    Verdicts are taken by time, then run id.  One qualifies by itself if it has a run id that
    differs from the one before, the known schema, and drift.  Of these, the next
    retraining is the first whose data moved since the newest retraining and whose time is
    at least ``cooldown`` later, so the search goes from retraining to retraining.
    """
    run, mark, since = memory
    rows = verdicts.sort_values(["produced_at", "run_id"], na_position="first").reset_index(drop=True)
    named = rows[rows["run_id"].fillna("") != ""]
    fresh = named["run_id"] != named["run_id"].shift(fill_value=run or "")
    able = fresh & (named["schema_version"] == VERDICT_SCHEMA_VERSION) & named["drift_detected"].fillna(False).astype(bool)
    waiting, started = named[able], []
    while len(waiting):
        moved = waiting["watermark"].isna() if mark is not None else waiting["watermark"].notna()
        if mark is not None:
            moved |= waiting["watermark"] != mark
        rested = True if since is None else waiting["produced_at"] >= since + cooldown
        ready = waiting[moved & rested]
        if ready.empty:
            break
        first = ready.iloc[0]
        mark = None if pd.isna(first["watermark"]) else first["watermark"]
        since = int(first["produced_at"])
        started.append(first["run_id"])
        waiting = waiting.loc[first.name + 1 :]
    return started, (named["run_id"].iloc[-1] if len(named) else run, mark, since)


def retrain_triggers(verdicts: DataFrame, cooldown: int = COOLDOWN_SECONDS, ttl_ms: int | None = None) -> DataFrame:
    """(pipeline, run_key, run_id): one row per retraining that a verdict stream starts.

    ``verdicts``: pipeline, run_id, schema_version, drift_detected, watermark (canonical
    JSON text), produced_at (seconds).  Only verdicts that could matter reach the state: the
    columns of one pipeline's batch, which is as long as its new verdicts.
    """
    search, keep, prefix = retrainings, _keep, RUN_KEY_PREFIX

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = tuple(state.get) if state.exists else (None, None, None)
        started, memory = search(pd.concat(list(chunks)), memory, cooldown)
        keep(state, memory, ttl_ms)
        yield pd.DataFrame(
            {"pipeline": [key[0]] * len(started), "run_key": [prefix + r for r in started], "run_id": started}
        )

    return verdicts.groupBy("pipeline").applyInPandasWithState(
        update,
        "pipeline string, run_key string, run_id string",
        "last_run string, last_watermark string, last_time bigint",
        "append",
        _timeout(ttl_ms),
    )


def watermark_changes(documents: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(pipeline, run_key, at): fires when the watermark document changed and is not empty.

    ``documents``: pipeline, at (seconds), doc (JSON text).  The key of a firing is the
    canonical document, so the same state never fires twice in a row.
    """

    keep = _keep

    def canonical(doc: str | None) -> str:
        return json.dumps(json.loads(doc or "{}"), sort_keys=True)

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        fired = []
        for row in pd.concat(list(chunks)).sort_values("at").to_dict("records"):
            now = canonical(row["doc"])
            if now != "{}" and now != last:
                fired.append((key[0], now, int(row["at"])))
            last = now
        keep(state, (last,), ttl_ms)
        yield pd.DataFrame(fired, columns=["pipeline", "run_key", "at"])

    return documents.groupBy("pipeline").applyInPandasWithState(
        update,
        "pipeline string, run_key string, at bigint",
        "last string",
        "append",
        _timeout(ttl_ms),
    )
