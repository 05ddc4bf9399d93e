"""Seeded synthetic records from a data dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------------------
WORDS = ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel")
SPARSE_SHARE = 0.3
# -------------------------------------------------------------------------------------


def generate_records(
    dictionary: DataFrame, ids: DataFrame, seed: int = 1, sparse: bool = False, record_field: str | None = None
) -> DataFrame:
    """(record, field, value): one row per record and data column, by field kind.

    ``ids`` holds the ``record`` numbers.  Every value depends on seed, record and field
    alone, so any task can make any cell and a replay makes the same ones.  The
    dictionary is exploded against the records by a replicated join: it has one row per
    form field.  ``descriptive`` fields hold no data; a checkbox yields one
    ``field___code`` column per choice; ``calc``, ``file`` and ``sql`` stay blank.
    """
    fields = dictionary.where(F.col("field_type") != "descriptive").select(
        "field_name",
        "field_type",
        F.coalesce("text_validation_type_or_show_slider_number", F.lit("")).alias("validation"),
        "choices",
    )
    columns = fields.withColumn(
        "code",
        F.explode_outer(
            F.when(
                F.col("field_type") == "checkbox", F.transform("choices", lambda c: c["code"])
            ).otherwise(F.array(F.lit("")))
        ),
    ).where(F.col("code").isNotNull())
    packed = columns.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.when(
                        F.col("field_type") == "checkbox",
                        F.concat("field_name", F.lit("___"), "code"),
                    )
                    .otherwise(F.col("field_name"))
                    .alias("name"),
                    "field_type",
                    "validation",
                    "choices",
                )
            )
        )
    ).scalar()
    cells = ids.select("record", F.explode(packed).alias("f")).select("record", "f.*")
    value = F.when(
        F.col("name") == record_field if record_field else F.lit(False),
        F.col("record").cast("string"),
    ).otherwise(_value(seed, sparse))
    return cells.select("record", F.col("name").alias("field"), value.alias("value"))


def _value(seed: int, sparse: bool) -> Column:
    kind, validation = F.col("field_type"), F.col("validation")

    def draw(salt: str, low: int, high: Column | int) -> Column:
        """Uniform integer in [low, high] of this cell."""
        width = F.lit(high).cast("bigint") - low + 1
        hashed = F.xxhash64(F.lit(seed), F.col("record"), F.col("name"), F.lit(salt))
        return F.pmod(hashed, width) + low

    def word(salt: str) -> Column:
        pool = F.array(*[F.lit(w) for w in WORDS])
        return F.concat(
            F.element_at(pool, (draw(f"{salt}w", 1, len(WORDS))).cast("int")),
            F.lit("-"),
            draw(f"{salt}n", 100, 999).cast("string"),
        )

    date = F.concat_ws(
        "-",
        draw("y", 2020, 2025).cast("string"),
        F.lpad(draw("m", 1, 12).cast("string"), 2, "0"),
        F.lpad(draw("d", 1, 28).cast("string"), 2, "0"),
    )
    choice = F.when(F.size("choices") > 0, F.element_at(
        F.transform("choices", lambda c: c["code"]),
        draw("c", 1, F.greatest(F.size("choices"), F.lit(1))).cast("int"),
    )).otherwise("")
    free = (
        F.when(validation.startswith("date"), date)
        .when(validation.isin("integer", "number"), draw("i", 1, 100).cast("string"))
        .otherwise(word("t"))
    )
    made = (
        F.when(kind.isin("dropdown", "radio"), choice)
        .when(kind.isin("yesno", "truefalse", "checkbox"), draw("b", 0, 1).cast("string"))
        .when(kind == "slider", draw("s", 0, 100).cast("string"))
        .when(kind == "notes", F.concat(word("a"), F.lit(" "), word("b")))
        .when(kind == "text", free)
        .otherwise("")
    )
    if not sparse:
        return made
    skipped = draw("k", 0, 999_999) < int(SPARSE_SHARE * 1_000_000)
    return F.when(skipped, F.when(kind == "checkbox", "0").otherwise("")).otherwise(made)
