"""Activity pipeline: raw log entries to calendar and rolling indicators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import aggregates, dedup, reshape, windows
from scriptorium.session import materialize


@dataclass(frozen=True)
class Indicators:
    """Calendar points per grain and the rolling series."""

    calendar: dict[str, DataFrame]
    rolling: DataFrame


def enrich(raw: DataFrame, position: str = "position") -> DataFrame:
    """Clean, classified entries without duplicates."""
    return dedup.dedupe_logs(reshape.clean_logs(raw), position)


def indicators(raw: DataFrame, days: int = windows.ROLLING_DAYS) -> Indicators:
    """All indicators from one enriched table, which is written once."""
    entries = materialize(enrich(raw), "logs")
    grains = ("day", "week", "month", "quarter")
    return Indicators(
        {grain: aggregates.calendar_kpis(entries, grain) for grain in grains},
        windows.rolling_kpis(entries, days),
    )


def respondents_per_project(entries: DataFrame) -> DataFrame:
    """Distinct respondents of each project."""
    return (
        entries.where(F.col("user_type") == text.RESPONDENT)
        .groupBy("project_id")
        .agg(
            F.countDistinct(text.respondent_id(F.col("action"), F.col("username"))).alias("respondents")
        )
    )
