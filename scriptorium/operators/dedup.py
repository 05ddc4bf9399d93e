"""Duplicate removal.

"Latest per key" is an aggregation (``max_by``), not a window: partial aggregates run
before the shuffle, so a key that holds a third of the rows still arrives as one row
per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text


def _pick(df: DataFrame, keys: Sequence[str], choose) -> DataFrame:
    keys = list(keys)
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(choose(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row"))
    return picked.select(*keys, "_row.*").select(*[F.col(f"`{c}`") for c in df.columns])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest on the ``order`` columns, nulls last.

    The choice is global over the whole input.  End ``order`` with a unique column to
    make ties deterministic.
    """
    rank = F.struct(*[F.col(c) for c in order])
    return _pick(df, keys, lambda row: F.max_by(row, rank))


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest on the ``order`` columns, nulls last."""
    rank = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    return _pick(df, keys, lambda row: F.min_by(row, rank))


def last_file_wins(df: DataFrame, keys: Sequence[str], file: str = "filename") -> DataFrame:
    """One row per key, from the file that sorts last."""
    return latest_by(df, keys, [file])


def distinct_links(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct at link grain."""
    return (df.select(*columns) if columns else df).distinct()


def unique_works(works: DataFrame, key: str = "work_id") -> DataFrame:
    """One row per work under a total order of its columns, whatever the input order."""
    return latest_by(works, [key], [c for c in works.columns if c != key])


def dedupe_logs(logs: DataFrame, position: str = "position") -> DataFrame:
    """Last entry per (project, millisecond, user, action)."""
    keyed = logs.withColumn("_ms", F.unix_millis("timestamp"))
    return latest_by(keyed, ["project_id", "_ms", "username", "action"], [position]).drop("_ms")


def event_id(namespace: str, columns: Sequence[str] = ("entity", "field", "from", "id", "value")) -> Column:
    """Name-based (version 5) UUID of the canonical JSON of the columns.

    ``namespace`` is a UUID.  Canonical JSON has sorted keys, no spaces, and ``null`` for
    missing values.
    """
    fields = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(columns)])
    payload = F.to_json(fields, {"ignoreNullFields": "false"})
    prefix = bytes.fromhex(namespace.replace("-", ""))
    digest = F.sha1(F.concat(F.lit(prefix), F.encode(payload, "UTF-8")))
    variant = F.translate(digest.substr(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        digest.substr(1, 8),
        digest.substr(9, 4),
        F.concat(F.lit("5"), digest.substr(14, 3)),
        F.concat(variant, digest.substr(18, 3)),
        digest.substr(21, 12),
    )


def unique_events(events: DataFrame, identity: str = "dataIntegrity", position: str = "position") -> DataFrame:
    """First event per identity."""
    return earliest_by(events, [identity], [position])


def merge_events(existing: DataFrame, updated: DataFrame, identity: str = "dataIntegrity") -> DataFrame:
    """Existing events whose identity was not updated, then the updated ones."""
    kept = existing.join(updated.select(identity).distinct(), identity, "left_anti")
    return kept.select(*existing.columns).unionByName(updated)


def unique_ci(df: DataFrame, column: str = "value", position: str = "position") -> DataFrame:
    """First-seen spelling of each string, compared without case."""
    keyed = df.withColumn("_low", F.lower(column))
    return earliest_by(keyed, ["_low"], [position]).drop("_low")


def union_matches(by_doi: DataFrame, by_title: DataFrame, order: Sequence[str] = ("work_id",)) -> DataFrame:
    """Works matched by DOI or by title, one per normalised DOI, DOI matches first."""
    both = by_doi.withColumn("source", F.lit("doi")).unionByName(
        by_title.where(text.blank_to_null(F.col("doi")).isNotNull()).withColumn(
            "source", F.lit("fuzzy")
        )
    )
    keyed = both.withColumn("_doi", text.normalize_doi(F.col("doi")))
    return earliest_by(keyed, ["_doi"], ["source", *order]).drop("_doi")


def institutions_of(works: DataFrame, authors: DataFrame) -> DataFrame:
    """Distinct institutions of the chosen authors over all works, sorted by name.

    The first spelling in work order is kept.
    """
    links = works.select("work_id", F.explode("authorships").alias("a")).select(
        "work_id", F.col("a.author.id").alias("author_id"), F.col("a.institutions").alias("i")
    )
    kept = links.join(authors.select("author_id").distinct(), "author_id", "left_semi")
    places = kept.select("work_id", F.explode("i").alias("i")).select(
        "work_id", "i.id", "i.display_name", "i.country_code"
    )
    return (
        earliest_by(places, ["id"], ["work_id", "display_name"])
        .drop("work_id")
        .orderBy(F.coalesce("display_name", F.lit("")), "id")
    )
