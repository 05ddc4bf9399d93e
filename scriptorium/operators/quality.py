"""Data-quality operators: violations as rows, or one row per expectation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import vectors

# ---- fixed values --------------------------------------------------------------------
NORM_TOLERANCE = 1e-4
STRICT_NORM_TOLERANCE = 1e-6
# -------------------------------------------------------------------------------------


# ---- rows that break a rule ----------------------------------------------------------
def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in any of the columns."""
    broken = F.lit(False)
    for column in columns:
        broken = broken | F.col(column).isNull()
    return df.where(broken)


def grain_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def domain_violations(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Values outside the accepted set, with their count."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def foreign_key_violations(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return df.where(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti"
    )


def pair_violations(pairs: DataFrame) -> DataFrame:
    """Pairs out of canonical order or without a shared work."""
    return pairs.where(~(F.col("author_a") < F.col("author_b")) | (F.col("co_publications") < 1))


def known_candidates(candidates: DataFrame, referential: DataFrame) -> DataFrame:
    """Candidate names that are in the referential after all."""
    return candidates.join(referential.select("org_key"), "org_key", "left_semi")


def negative_views(views: DataFrame) -> DataFrame:
    return views.where(F.col("views") < 0)


# ---- expectation suites --------------------------------------------------------------
@dataclass(frozen=True)
class Expectation:
    """A rule every row must meet; null counts as a failure unless ``nullable``."""

    name: str
    rule: Column
    nullable: bool = False


def not_null(column: str) -> Expectation:
    return Expectation(f"{column}.not_null", F.col(column).isNotNull())


def matches(column: str, pattern: str) -> Expectation:
    return Expectation(f"{column}.matches", F.col(column).rlike(pattern), nullable=True)


def between(column: str, low=None, high=None, strict: bool = False) -> Expectation:
    value = F.col(column)
    rule = F.lit(True)
    if low is not None:
        rule = rule & ((value > low) if strict else (value >= low))
    if high is not None:
        rule = rule & (value <= high)
    return Expectation(f"{column}.between", F.when(value.isNotNull(), rule), nullable=True)


def in_set(column: str, allowed: Sequence) -> Expectation:
    return Expectation(f"{column}.in_set", F.col(column).isin(*allowed), nullable=True)


def length_between(column: str, low: int, high: int) -> Expectation:
    return Expectation(f"{column}.length", F.length(column).between(low, high), nullable=True)


def row_rule(name: str, rule: Column) -> Expectation:
    return Expectation(name, rule)


def suite(
    df: DataFrame,
    expectations: Sequence[Expectation],
    min_rows: int = 0,
    columns: Sequence[str] = (),
) -> DataFrame:
    """(expectation, checked, failed, passed) for all rules in a single scan.

    Missing ``columns`` fail by schema alone.
    """
    checks = [
        F.count_if(~F.coalesce(e.rule, F.lit(e.nullable))).alias(f"_f{i}")
        for i, e in enumerate(expectations)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *checks)

    def row(name: str, failed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("expectation"),
            F.col("_n").alias("checked"),
            failed.cast("bigint").alias("failed"),
        )

    rows = [row(e.name, F.col(f"_f{i}")) for i, e in enumerate(expectations)]
    rows += [
        row(f"{c}.exists", F.lit(0 if c in df.columns else 1)) for c in columns
    ]
    if min_rows:
        rows.append(row("row_count", (F.col("_n") < min_rows).cast("int")))
    return (
        counted.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .withColumn("passed", F.col("failed") == 0)
    )


def collab_suite(pairs: DataFrame, maximum: int | None = None) -> DataFrame:
    """Contract of the co-authorship mart."""
    keys = ("author_a", "author_b", "co_publications")
    return suite(
        pairs, [*[not_null(k) for k in keys], between("co_publications", 1, maximum)]
    )


def labels_suite(labels: DataFrame, maximum: float | None = None) -> DataFrame:
    """Contract of the label mart."""
    keys = ("author_id", "kind", "label_id", "weight", "freq")
    return suite(
        labels,
        [
            *[not_null(k) for k in keys],
            in_set("kind", ("topic", "keyword")),
            between("weight", 0, maximum, strict=True),
            between("freq", 1),
        ],
    )


def predictions_suite(predictions: DataFrame) -> DataFrame:
    """Contract of the served pair predictions."""
    return suite(
        predictions,
        [
            *[not_null(k) for k in ("author_a", "author_b", "uplift")],
            row_rule("canonical", F.col("author_a") < F.col("author_b")),
            in_set("served_mode", ("predictive", "descriptive")),
        ],
    )


def recommendations_suite(recommendations: DataFrame) -> DataFrame:
    """Contract of the recommendations: known ids, nobody recommends themselves, rank >= 1."""
    return suite(
        recommendations,
        [
            not_null("author_id"),
            not_null("partner_id"),
            row_rule("not_self", F.col("author_id") != F.col("partner_id")),
            between("rank", 1),
        ],
    )


def vector_suite(
    df: DataFrame,
    key: str,
    vector: str,
    dim: int,
    strict: bool = False,
    tolerance: float = NORM_TOLERANCE,
) -> DataFrame:
    """Contract of served vectors: dimension, finite, unit norm, unique key.

    Unless ``strict`` a zero vector is legitimate (an author without text).
    """
    size = vectors.norm(F.col(vector))
    unit = F.abs(size - 1) <= tolerance
    known_dim = F.size(vector) == dim
    checks = suite(
        df,
        [
            not_null(key),
            not_null(vector),
            Expectation("dimension", known_dim),
            Expectation("finite", vectors.is_finite(F.col(vector))),
            Expectation("norm", F.when(known_dim, unit if strict else unit | (size == 0)), True),
        ],
    )
    repeated = grain_violations(df.select(key), [key]).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("failed")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return checks.unionByName(
        repeated.select(
            F.lit("unique").alias("expectation"),
            total.alias("checked"),
            "failed",
            (F.col("failed") == 0).alias("passed"),
        )
    )


def count_matches(df: DataFrame, declared: int | Column) -> DataFrame:
    """Loaded rows against the declared number, one row."""
    expected = declared if isinstance(declared, Column) else F.lit(declared)
    return df.agg(F.count(F.lit(1)).alias("loaded")).select(
        "loaded",
        expected.cast("bigint").alias("declared"),
        (F.col("loaded") == expected).alias("passed"),
    )


def schema_check(
    spark: SparkSession, paths: Sequence[str], required: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """Required columns (and types) of a sample of Parquet files, from their footers alone."""
    found = dict(spark.read.parquet(*paths).dtypes)
    wanted = dict.fromkeys(required) if not isinstance(required, Mapping) else dict(required)
    rows = [
        (name, name in found, kind is None or found.get(name) == kind)
        for name, kind in wanted.items()
    ]
    return spark.createDataFrame(rows, "name string, present boolean, typed boolean")
