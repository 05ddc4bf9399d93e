"""News pipeline: native feed to university timeline and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scriptorium.operators import aggregates, dedup, joins, reshape


def stage(raw: DataFrame) -> DataFrame:
    """Typed mentions, one per record and organisation, from the last file that has it."""
    return reshape.stage_mentions(dedup.last_file_wins(raw, ["record_id", "organization"]))


def timeline(native: DataFrame, referential: DataFrame) -> DataFrame:
    """Articles and mentions per university and day from one pass over the native layer.

    A document already lists each organisation once, so nothing is deduplicated here;
    ``stage`` does that when several files overlap.
    """
    mentions = reshape.stage_mentions(reshape.mentions(native))
    return aggregates.university_timeline(joins.university_mentions(mentions, referential))


def candidates(mentions: DataFrame, referential: DataFrame) -> DataFrame:
    """University-like names missing from the referential, most mentioned first."""
    return aggregates.candidate_counts(joins.university_candidates(mentions, referential))
