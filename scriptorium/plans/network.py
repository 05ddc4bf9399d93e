"""Two-pass network extraction: affiliated authors first, then all their works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from scriptorium.operators import dedup, joins, matching, reshape
from scriptorium.session import materialize


def extract(
    lake: DataFrame, ids: Sequence[str], min_year: int = 2016, kind: str = "article"
) -> tuple[DataFrame, DataFrame]:
    """(authors, works): authors with an affiliation in scope, and every work of theirs."""
    works = reshape.prefilter(lake, min_year, kind)
    authors = reshape.affiliated_authors(works, ids)
    latest = dedup.latest_by(
        joins.works_of(works, authors), ["work_id"], ["updated_date", "fwci", "cited_by_count"]
    )
    return authors, latest


def vectors(works: DataFrame, authors: DataFrame, embed=matching.hashing_embed) -> DataFrame:
    """Researcher vectors of the chosen authors over the extracted works."""
    links = dedup.distinct_links(reshape.explode_authorships(works), ["work_id", "author_id"]).join(
        authors, "author_id", "left_semi"
    )
    texts = reshape.work_text(reshape.explode_topics(works), reshape.explode_keywords(works))
    return matching.researcher_vectors(texts, materialize(links, "links"), embed)
