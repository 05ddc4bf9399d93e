"""Set algebra of catalogue ids over review events.

Each answer is one aggregation per (researcher, id) with conditional flags instead of
chained intersect / union / subtract shuffles.  Called without a researcher they answer
for all researchers at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.reshape import ACCEPTED, PENDING, filter_by

AFFILIATION = ("author", "affiliation")
ALIAS = ("author", "display_name_alternatives")
WORK = ("work", "id")
#: What an accepted value of an entity and field is called.
ACCESSORS = {
    "aliases": ALIAS,
    "affiliations": AFFILIATION,
    "institutions": ("institution", "id"),
    "institution_aliases": ("institution", "display_name_alternatives"),
    "works": WORK,
}


def _is(what: tuple[str, str], *statuses: str) -> Column:
    test = (F.col("entity") == what[0]) & (F.col("field") == what[1])
    return test & F.col("status").isin(*statuses) if statuses else test


def _flags(events: DataFrame, researcher: str | None) -> DataFrame:
    mine = events if researcher is None else events.where(F.col("id") == researcher)
    alive = (ACCEPTED, PENDING)
    known = F.bool_or(_is(AFFILIATION) | _is(ALIAS))
    accepted = (
        F.bool_or(_is(AFFILIATION, ACCEPTED)) & F.bool_or(_is(ALIAS, ACCEPTED))
    ) | F.bool_or(_is(WORK, ACCEPTED))
    pending = F.bool_or(_is(AFFILIATION, *alive) | _is(ALIAS, *alive))
    return mine.groupBy("id", "from").agg(
        known.alias("known"), accepted.alias("accepted"), pending.alias("pending")
    )


def accepted_ids(events: DataFrame, researcher: str | None = None) -> DataFrame:
    """(accepted affiliations ∩ accepted names) ∪ accepted works."""
    return _flags(events, researcher).where("accepted").select("id", "from")


def pending_ids(events: DataFrame, researcher: str | None = None) -> DataFrame:
    """Ids with an accepted or pending affiliation or name, minus the accepted ids."""
    return _flags(events, researcher).where("pending AND NOT accepted").select("id", "from")


def rejected_ids(events: DataFrame, researcher: str | None = None) -> DataFrame:
    """Ids with any affiliation or name, minus accepted and pending ids."""
    return (
        _flags(events, researcher)
        .where("known AND NOT accepted AND NOT pending")
        .select("id", "from")
    )


def ids_from_works(events: DataFrame, researcher: str | None = None) -> DataFrame:
    """Ids backed by an accepted work."""
    mine = events if researcher is None else events.where(F.col("id") == researcher)
    return mine.where(_is(WORK, ACCEPTED)).select("id", "from").distinct()


def accepted(events: DataFrame, accessor: str, researcher: str | None = None) -> DataFrame:
    """Distinct accepted values: aliases, affiliations, institutions, institution aliases, works."""
    mine = events if researcher is None else events.where(F.col("id") == researcher)
    return mine.where(_is(ACCESSORS[accessor], ACCEPTED)).select("id", "value", "label").distinct()


def status_of(events: DataFrame, accessor: str, position: str = "position") -> DataFrame:
    """First recorded status of each value."""
    return (
        events.where(_is(ACCESSORS[accessor]))
        .groupBy("id", "value")
        .agg(F.min_by("status", position).alias("status"))
    )


def has_events(events: DataFrame, **attributes) -> DataFrame:
    """One row, one boolean: is there any event with these attributes."""
    return filter_by(events, attributes).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def to_extend(events: DataFrame) -> DataFrame:
    """Accepted names whose catalogue search has never been extended."""
    return filter_by(
        events,
        {
            "hasBeenExtendedAt": "never",
            "entity": ALIAS[0],
            "field": ALIAS[1],
            "status": ACCEPTED,
        },
    )
