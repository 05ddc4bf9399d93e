"""Rolling stream counters over several drains against the batch operator."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import windows
from scriptorium.session import scratch_path
from scriptorium.streaming import jobs

SCHEMA = "timestamp timestamp, user_type string, username string, action string, project_id int, action_category string"


def logs(days):
    """Entries of the days, some at midnight, of a few identities that come again after 1 to 60 days."""
    draw = random.Random(5)
    rows = []
    for day in days:
        for _ in range(draw.randrange(1, 4)):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=draw.choice([0, 5, 23]))
            who = draw.choice([text.LOGGED, text.RESPONDENT])
            rows.append((at, who, f"u{draw.randrange(4)}", f"Réponse créée R-{draw.randrange(3)}", draw.choice([None, 1, 2]), None))
    return rows


def test_rolling_counters_over_drains(spark):
    days = [0, 0, 1, 5, 29, 30, 31, 60, 61, 100, 101, 130, 131, 150, 151, 200]
    rows = logs(days)
    path, kept, progress = (scratch_path(spark, n) for n in ("logs", "rolling", "progress"))
    for some in (rows[:3], rows[3:14], rows[14:-4], rows[-4:]):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, spark.createDataFrame(some, SCHEMA).schema)
        jobs.rolling_counters(stream, "1 hour", kept, progress)
    until = max(r[0] for r in rows) - dt.timedelta(hours=1)
    whole = windows.rolling_kpis(spark.createDataFrame(rows, SCHEMA))
    want = {r.date: r for r in whole.where(F.col("date") <= F.lit(until.date())).collect() if r.actions_total}
    found = {r.date: r for r in jobs.rolling_points(spark, kept).collect() if r.date >= min(want)}
    assert found == want and len(want) > 100
    # An identity's day is one row, whatever the windows that it is in.
    spans = spark.read.parquet(f"{kept}/spans")
    people = spark.read.parquet(f"{kept}/days").where(F.col("what") != jobs.ACTIONS)
    assert people.count() == people.select("what", "who", "day").distinct().count() == spans.agg(F.sum("n")).first()[0]


def test_rolling_points_of_nothing(spark):
    path, kept, progress = (scratch_path(spark, n) for n in ("logs", "rolling", "progress"))
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    jobs.rolling_counters(jobs.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema), "1 hour", kept, progress)
    assert jobs.rolling_points(spark, kept).count() == 0
