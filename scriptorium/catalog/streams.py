"""Queries that run as streams over files written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.activity import rolling_sql
from scriptorium.catalog.base import query
from scriptorium.operators import reshape, windows
from scriptorium.plans import adapters
from scriptorium.session import scratch_path
from scriptorium.streaming import jobs


def _events(spark, sf):
    events = adapters.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events")
    events.repartitionByRange(4, "ts").write.parquet(path)
    return jobs.file_stream(spark, path, events.schema, max_files=4)


def _drain(spark, stream, partition=()):
    """Run a stream over what is there and read its output."""
    path = scratch_path(spark, "stream-out")
    jobs.run_to_files(stream, path, scratch_path(spark, "progress"), partition)
    return spark.read.schema(stream.schema).parquet(path)


@query("r1_file_source", "SELECT event_id, user_id, event_type FROM events")
def r1(spark, sf):
    events = adapters.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    path = scratch_path(spark, "arrivals")
    events.repartition(6, "event_id").write.parquet(path)
    return _drain(spark, jobs.file_stream(spark, path, events.schema, max_files=2))


@query(
    "r2_tumbling_windows",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
       WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""",
)
def r2(spark, sf):
    counts = jobs.tumbling_counts(_events(spark, sf), "ts", "1 hour", "10 minutes", ["event_type"])
    return _drain(spark, counts).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n"
    )


@query("r3_rolling_windows", rolling_sql("max(ts) - INTERVAL 1 HOUR"))
def r3(spark, sf):
    logs = adapters.order_logs(spark, sf)
    path = scratch_path(spark, "logs")
    logs.repartitionByRange(4, "timestamp").write.parquet(path)
    stream = reshape.clean_logs(jobs.file_stream(spark, path, logs.schema))
    kept = scratch_path(spark, "rolling")
    jobs.rolling_counters(stream, "1 hour", kept, scratch_path(spark, "progress"))
    points = jobs.rolling_points(spark, kept)
    first = spark.read.parquet(path).agg(F.to_date(F.min("timestamp")).alias("first")).scalar()
    whole = points.where(F.col("date") >= F.date_add(first, windows.ROLLING_DAYS))
    return whole.withColumn("date", F.col("date").cast("string"))


@query(
    "r4_stream_duplicates",
    """SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct, CAST(sum(user_id) AS BIGINT) AS total FROM events""",
)
def r4(spark, sf):
    events = adapters.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "twice")
    events.unionAll(events.where("event_id % 2 = 0")).repartition(4, "user_id").write.parquet(path)
    stream = jobs.file_stream(spark, path, events.schema, max_files=4)
    unique = _drain(spark, jobs.deduplicate(stream, ["event_id"], "ts", "60 days"))
    return unique.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("event_id").alias("n_distinct"),
        F.sum("user_id").alias("total"),
    )


@query(
    "r5_late_days",
    """SELECT strftime(ts, '%Y-%m-%d') AS dt, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def r5(spark, sf):
    events = adapters.table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path, raw, mart, progress = (scratch_path(spark, n) for n in ("late", "raw", "days", "progress"))

    def build(rows):
        return rows.groupBy("dt", "event_type").agg(F.countDistinct("event_id").alias("n"))

    # Most rows arrive first; the late third touches the same days again.
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        events.where(part).coalesce(2).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, events.schema)
        jobs.rematerialise_days(stream, raw, mart, "ts", build, progress)
    return jobs.latest_days(spark, mart).select(
        F.col("dt").cast("string").alias("dt"), "event_type", "n"
    )


@query(
    "r6_review_store",
    f"""WITH {sql.REVIEW}, memory AS (SELECT id, entity, field, value,
        min_by(status, position) FILTER (status IN ('accepted', 'rejected')) AS st,
        min_by(extended, position) FILTER (extended <> 'never') AS ext FROM review WHERE position % 3 = 0 GROUP BY 1, 2, 3, 4)
    SELECT r.position, r.id, r.entity, r.field, r.value, coalesce(CASE WHEN position % 3 <> 0 THEN m.st END, r.status) AS status,
      coalesce(CASE WHEN position % 3 <> 0 THEN m.ext END, r.extended) AS "hasBeenExtendedAt"
    FROM review r LEFT JOIN memory m ON m.id = r.id AND m.entity = r.entity AND m.field = r.field AND m.value = r.value""",
)
def r6(spark, sf):
    events = adapters.review_events(spark, sf).select(
        "id", "entity", "field", "value", "position", "status", "hasBeenExtendedAt"
    )
    path, out, progress = (scratch_path(spark, n) for n in ("review", "store", "progress"))
    for part in ("position % 3 = 0", "position % 3 <> 0"):
        events.where(part).write.mode("append").parquet(path)
        stream = jobs.carry_forward_stream(jobs.file_stream(spark, path, events.schema))
        jobs.run_to_files(stream, out, progress)
    return spark.read.schema(stream.schema).parquet(out)


_GO = "v.drift AND v.mark IS DISTINCT FROM s.mark AND (s.since IS NULL OR v.t - s.since >= 21600)"


@query(
    "r7_retrain_triggers",
    f"""WITH RECURSIVE v AS (SELECT concat('p', o_custkey % 50) AS pipeline, CAST(o_orderkey AS VARCHAR) AS run_id, o_totalprice > 200000 AS drift,
        strftime(o_orderdate, '%Y-%m') AS mark, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS t,
        row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS rn FROM orders),
    s AS (SELECT pipeline, rn, run_id, drift AS go, CASE WHEN drift THEN mark END AS mark, CASE WHEN drift THEN t END AS since FROM v WHERE rn = 1
      UNION ALL SELECT v.pipeline, v.rn, v.run_id, {_GO}, CASE WHEN {_GO} THEN v.mark ELSE s.mark END, CASE WHEN {_GO} THEN v.t ELSE s.since END
      FROM s JOIN v ON v.pipeline = s.pipeline AND v.rn = s.rn + 1)
    SELECT pipeline, concat('drift-retrain:', run_id) AS run_key, run_id FROM s WHERE go""",
)
def r7(spark, sf):
    verdicts = adapters.table(spark, sf, "orders").select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("pipeline"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.lit(1).alias("schema_version"),
        (F.col("o_totalprice") > 200_000).alias("drift_detected"),
        F.date_format("o_orderdate", "yyyy-MM").alias("watermark"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("produced_at"),
    )
    path = scratch_path(spark, "verdicts")
    verdicts.write.parquet(path)
    return _drain(spark, jobs.retrain_triggers(jobs.file_stream(spark, path, verdicts.schema)))


@query(
    "r8_watermark_changes",
    """WITH d AS (SELECT concat('p', o_custkey % 50) AS pipeline, o_orderkey AS "at", CASE WHEN o_orderstatus = 'P' THEN '{}' ELSE concat('{"works": "', year(o_orderdate), '"}') END AS doc FROM orders),
    l AS (SELECT *, lag(doc) OVER (PARTITION BY pipeline ORDER BY "at") AS prev FROM d)
    SELECT pipeline, doc AS run_key, "at" FROM l WHERE doc <> '{}' AND (prev IS NULL OR prev <> doc)""",
)
def r8(spark, sf):
    documents = adapters.table(spark, sf, "orders").select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("pipeline"),
        F.col("o_orderkey").alias("at"),
        F.when(F.col("o_orderstatus") != "P", F.to_json(F.struct(F.year("o_orderdate").cast("string").alias("works"))))
        .otherwise("{}")
        .alias("doc"),
    )
    path = scratch_path(spark, "documents")
    documents.write.parquet(path)
    return _drain(spark, jobs.watermark_changes(jobs.file_stream(spark, path, documents.schema)))


@query(
    "r9_stream_enrichment",
    f"""WITH {sql.MENTIONS}, {sql.REFERENTIAL} SELECT record_id, university_id, country, translated FROM mentions m
    JOIN referential r ON r.org_key = m.org_key""",
)
def r9(spark, sf):
    native = adapters.native_news(spark, sf)
    path = scratch_path(spark, "feed")
    native.select(F.concat_ws("\t", *native.columns)).repartition(3).write.text(path)
    stream = jobs.enrich_mentions(jobs.news_stream(spark, path), adapters.referential(spark, sf))
    return _drain(spark, stream).select("record_id", "university_id", "country", "translated")
