"""Page-view pipeline: referential, titles and monthly views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import aggregates, dedup, joins
from scriptorium.session import materialize

KEYS = ("university_id", "view_date", "page_title")


def stage(raw: DataFrame) -> DataFrame:
    """Daily views: null counts 0, negative and keyless rows dropped, last file wins."""
    usable = raw.where(
        text.blank_to_null(F.col("university_id")).isNotNull()
        & F.col("view_date").isNotNull()
        & (F.coalesce("views", F.lit(0)) >= 0)
    )
    latest = dedup.last_file_wins(usable, KEYS)
    return latest.select(
        F.trim("university_id").alias("university_id"),
        "view_date",
        F.to_date(F.date_trunc("month", "view_date")).alias("view_month"),
        F.coalesce("views", F.lit(0)).cast("bigint").alias("views"),
        *[text.blank_to_null(F.col(c)).alias(c) for c in ("page_title", "wiki", "source_dump")],
    )


def timeline(raw: DataFrame) -> DataFrame:
    """Served monthly views."""
    return aggregates.views_timeline(aggregates.monthly_views(stage(raw)))


def build_referential(
    institutions: DataFrame,
    bindings: DataFrame,
    normalized: DataFrame,
    redirects: DataFrame,
    langs: Sequence[str],
) -> DataFrame:
    """Institutions x languages with their resolved article titles.

    The merged titles are used twice, so they are written once.
    """
    knowledge = materialize(joins.merge_titles(bindings, langs), "titles")
    resolved = joins.resolve_titles(
        knowledge.select("qid", "title").distinct(), normalized, redirects
    )
    return joins.university_titles(institutions, knowledge, langs, resolved)
