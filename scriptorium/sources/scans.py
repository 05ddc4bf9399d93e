"""Reading: explicit schemas, strict projections, tolerant text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium import schemas

# ---- fixed values --------------------------------------------------------------------
DICTIONARY_TYPES = (
    "text",
    "notes",
    "calc",
    "dropdown",
    "radio",
    "checkbox",
    "yesno",
    "truefalse",
    "file",
    "slider",
    "descriptive",
    "sql",
)
DICTIONARY_REQUIRED = ("field_name", "form_name", "field_type", "field_label")
DICTIONARY_OPTIONAL = (
    "section_header",
    "select_choices_or_calculations",
    "field_note",
    "text_validation_type_or_show_slider_number",
    "text_validation_min",
    "text_validation_max",
    "identifier",
    "branching_logic",
    "required_field",
    "custom_alignment",
    "question_number",
    "matrix_group_name",
    "matrix_ranking",
    "field_annotation",
)
#: Export headings, in normal form, that differ from the column name.
DICTIONARY_HEADINGS = {
    "variable field name": "field_name",
    "choices calculations or slider labels": "select_choices_or_calculations",
    "text validation type or show slider number": "text_validation_type_or_show_slider_number",
    "branching logic show field only if": "branching_logic",
    "question number surveys only": "question_number",
}
# -------------------------------------------------------------------------------------


def scan_works(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType = schemas.WORKS,
) -> DataFrame:
    """Works with only the asked columns; the scan decodes no other (nested) column."""
    paths = [path] if isinstance(path, str) else list(path)
    works = spark.read.schema(schema).parquet(*paths)
    return works.select(*columns) if columns else works


def scan_runs(
    spark: SparkSession,
    root: str,
    dt: str | None = None,
    filename: str | None = "filename",
    schema: T.StructType | None = None,
) -> DataFrame:
    """All runs below ``root/dt=…/run=…``, united by column name, with their file.

    ``dt`` prunes partitions.  With a schema, files are not opened to find one.
    """
    reader = spark.read.option("recursiveFileLookup", "false")
    reader = reader.schema(schema) if schema else reader.option("mergeSchema", "true")
    runs = reader.parquet(root)
    if dt is not None:
        runs = runs.where(F.col("dt") == dt)
    return runs.withColumn(filename, F.col("_metadata.file_path")) if filename else runs


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, plain or gzipped, with a given schema; unreadable lines become nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_native_news(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """27-field tab-separated news files without header."""
    return parse_native_news(spark.read.text(path))


def parse_native_news(lines: DataFrame) -> DataFrame:
    """Lines to the native layer: short lines dropped, extra fields ignored, all trimmed.

    Quotes are text here, which is why this is not a CSV scan.
    """
    width = len(schemas.NEWS_COLUMNS)
    fields = lines.where(F.trim("value") != "").select(F.split("value", "\t", -1).alias("f"))
    return fields.where(F.size("f") >= width).select(
        *[F.trim(F.col("f")[i]).alias(name) for i, name in enumerate(schemas.NEWS_COLUMNS)]
    )


def scan_researchers(spark: SparkSession, path: str) -> DataFrame:
    """Researcher CSV: required columns checked, cells trimmed, absent cells blank."""
    raw = (
        spark.read.option("header", "true")
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .csv(path)
    )
    present = {name.strip(): name for name in raw.columns}
    missing = [name for name in schemas.RESEARCHERS_REQUIRED if name not in present]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")

    def cell(name: str) -> Column:
        value = F.col(f"`{present[name]}`") if name in present else F.lit(None).cast("string")
        return F.coalesce(F.trim(value), F.lit("")).alias(name)

    return raw.select(
        *[cell(n) for n in (*schemas.RESEARCHERS_REQUIRED, *schemas.RESEARCHERS_OPTIONAL)]
    )


def choices(cell: Column) -> Column:
    """``"1, A | 2, B"`` to an array of (code, label); no comma means code = label."""
    parts = F.filter(
        F.transform(F.split(cell, r"\|"), lambda p: F.trim(p)), lambda p: p != ""
    )
    coded = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, "^([^,]*)", 1)).alias("code"),
            F.when(F.locate(",", p) > 0, F.trim(F.regexp_extract(p, "^[^,]*,(.*)$", 1)))
            .otherwise(p)
            .alias("label"),
        ),
    )
    return F.coalesce(coded, F.array().cast("array<struct<code:string,label:string>>"))


def heading(name: str) -> str | None:
    """Column a dictionary heading stands for, or None."""
    low = name.lower().replace("?", "")
    for mark in "/(),.":
        low = low.replace(mark, " ")
    low = " ".join(low.split())
    plain = low.replace(" ", "_")
    if plain in (*DICTIONARY_REQUIRED, *DICTIONARY_OPTIONAL):
        return plain
    return DICTIONARY_HEADINGS.get(low)


def scan_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Data dictionary CSV under export or snake-case headings, with parsed choices.

    Unknown columns are ignored, absent optional ones are null.  A row without a
    required cell or with an unknown field type fails the scan.
    """
    raw = (
        spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    )
    names: dict[str, str] = {}
    for column in raw.columns:
        canonical = heading(column.lstrip("﻿"))
        if canonical:
            names.setdefault(canonical, column)

    def cell(name: str) -> Column:
        if name not in names:
            return F.lit(None).cast("string").alias(name)
        return F.nullif(F.trim(F.col(f"`{names[name]}`")), F.lit("")).alias(name)

    table = raw.select(*[cell(n) for n in (*DICTIONARY_REQUIRED, *DICTIONARY_OPTIONAL)])
    complete = F.lit(True)
    for name in DICTIONARY_REQUIRED:
        complete = complete & F.col(name).isNotNull()
    known = F.col("field_type").isin(*DICTIONARY_TYPES)
    checked = (
        F.when(
            ~complete,
            F.raise_error(F.concat(F.lit("missing required cell near "), F.coalesce("field_name", F.lit("?")))),
        )
        .when(~known, F.raise_error(F.concat(F.lit("unknown field type "), F.col("field_type"))))
        .otherwise(F.col("field_type"))
    )
    return table.withColumn("field_type", checked).withColumn(
        "choices", choices(F.col("select_choices_or_calculations"))
    )


def scan_seed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A reference list from CSV.  Joins decide from its size whether to broadcast it."""
    return spark.read.schema(schema).option("header", "true").csv(path)
