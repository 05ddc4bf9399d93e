"""Landed JSON payloads to rows.  Schemas are given; malformed payloads yield no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.functions import text
from scriptorium.operators import reshape
from scriptorium.operators.dedup import latest_by


def flatten_registry(raw: DataFrame, column: str = "json") -> DataFrame:
    """Registry records, one JSON object per row, to universities."""
    parsed = raw.select(F.from_json(column, schemas.REGISTRY).alias("r")).select("r.*")
    return reshape.project_universities(parsed)


def flatten_catalogue(raw: DataFrame, column: str = "json") -> DataFrame:
    """Catalogue pages to (ror, university_id, country_code, works_band).

    Entries without a registry id or an id drop out.
    """
    item = raw.select(F.from_json(column, schemas.CATALOGUE_PAGE).alias("p")).select(
        F.explode("p.results").alias("i")
    )
    return item.select(
        text.bare_id(F.coalesce(text.blank_to_null(F.col("i.ror")), F.col("i.ids.ror"))).alias("ror"),
        F.trim("i.id").alias("university_id"),
        F.upper(
            F.trim(
                F.coalesce(
                    text.blank_to_null(F.col("i.geo.country_code")), F.col("i.country_code"), F.lit("")
                )
            )
        ).alias("country_code"),
        reshape.works_band(F.coalesce("i.works_count", F.lit(0))).alias("works_band"),
    ).where((F.col("ror") != "") & (F.col("university_id") != ""))


def flatten_monthly_views(
    raw: DataFrame, months: Sequence[str] | None = None, column: str = "json", keep: Sequence[str] = ()
) -> DataFrame:
    """Monthly view payloads to (keep…, month, views); items without a number drop out."""
    item = raw.select(*keep, F.from_json(column, schemas.MONTHLY_VIEWS_PAGE).alias("p")).select(
        *keep, F.explode("p.items").alias("i")
    )
    rows = item.where(
        (F.length("i.timestamp") >= 6) & F.col("i.views").isNotNull()
    ).select(
        *keep,
        F.substring("i.timestamp", 1, 6).alias("month"),
        F.col("i.views").cast("bigint").alias("views"),
    )
    return rows if months is None else rows.where(F.col("month").isin(*months))


def flatten_redirects(raw: DataFrame, column: str = "json", keep: Sequence[str] = ()) -> DataFrame:
    """Redirect payloads to the distinct redirected titles."""
    pages = raw.select(*keep, F.from_json(column, schemas.REDIRECTS_PAGE).alias("p")).select(
        *keep, F.explode(F.map_values("p.query.pages")).alias("g")
    )
    return (
        pages.select(*keep, F.explode("g.redirects").alias("r"))
        .select(*keep, F.col("r.title").alias("title"))
        .where(F.col("title") != "")
        .distinct()
    )


def flatten_bindings(
    raw: DataFrame, langs: Sequence[str] | None = None, column: str = "json", batch: str = "batch"
) -> DataFrame:
    """Knowledge-base bindings to (batch, position, ror, qid, lang, title) rows."""
    item = raw.select(
        batch, F.from_json(column, schemas.BINDINGS_PAGE).alias("p")
    ).select(batch, F.posexplode("p.results.bindings").alias("position", "b"))

    def value(name: str):
        return F.coalesce(F.trim(F.col(f"b.{name}.value")), F.lit(""))

    rows = item.select(
        F.col(batch).alias("batch"),
        "position",
        text.bare_id(value("ror")).alias("ror"),
        text.bare_id(value("item")).alias("qid"),
        value("lang").alias("lang"),
        value("title").alias("title"),
    ).where(F.col("ror") != "")
    return rows if langs is None else rows.where(F.col("lang").isin(*langs))


def institutions(catalogue: DataFrame, countries: Sequence[str] = (), max_n: int = 0) -> DataFrame:
    """Latest version of each education institution with a registry id, in id order.

    ``catalogue``: id, ror, type, country_code, works_count, updated_date.
    """
    kept = catalogue.where(
        (F.col("type") == reshape.EDUCATION) & text.blank_to_null(F.col("ror")).isNotNull()
    )
    if countries:
        kept = kept.where(F.upper("country_code").isin(*[c.strip().upper() for c in countries]))
    latest = latest_by(kept, ["id"], ["updated_date", "works_count"]).select(
        "id", "ror", "country_code", "works_count"
    )
    ordered = latest.orderBy("id")
    return ordered.limit(max_n) if max_n > 0 else ordered
