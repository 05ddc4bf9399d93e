"""Identity review: new catalogue records against the event store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import dedup, joins, sets
from scriptorium.operators.joins import NEVER


def stamp(events: DataFrame, namespace: str, now: str) -> DataFrame:
    """Identity and times of freshly built events."""
    return (
        events.withColumn("dataIntegrity", dedup.event_id(namespace))
        .withColumn("createdAt", F.lit(now))
        .withColumn("updatedAt", F.lit(now))
        .withColumn("hasBeenExtendedAt", F.lit(NEVER))
    )


def update_store(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Event store after new events: unique, carrying decisions forward, replacing equals."""
    unique = dedup.unique_events(fresh)
    return dedup.merge_events(store, joins.carry_forward(store, unique))


def resolve(events: DataFrame) -> DataFrame:
    """(id, from, resolution) of every catalogue id that has one, in one pass."""
    parts = {
        "accepted": sets.accepted_ids(events),
        "pending": sets.pending_ids(events),
        "rejected": sets.rejected_ids(events),
    }
    out = None
    for name, ids in parts.items():
        part = ids.withColumn("resolution", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
