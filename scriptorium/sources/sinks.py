"""Writing: immutable runs, partitioned tables, idempotent loads, manifests, caches."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.session import materialize, scratch_path

# ---- fixed values --------------------------------------------------------------------
MANIFEST_SCHEMA_VERSION = 1
MANIFEST_NAME = "manifest.json"
CACHE_FULL, CACHE_BOUNDED, CACHE_EPHEMERAL = "full", "bounded", "ephemeral"
# -------------------------------------------------------------------------------------


def run_path(root: str, dt: str, run: str) -> str:
    return f"{root.rstrip('/')}/dt={dt}/run={run}"


def write_run(df: DataFrame, root: str, dt: str, run: str, order: Sequence[str] = ()) -> str:
    """Write a new immutable run; an existing one is an error, never overwritten.

    Rows are sorted inside each file, which keeps row-group statistics tight without a
    global shuffle.
    """
    path = run_path(root, dt, run)
    (df.sortWithinPartitions(*order) if order else df).write.mode("errorifexists").parquet(path)
    return path


def write_by_month(df: DataFrame, root: str, month: str = "month", order: Sequence[str] = ()) -> None:
    """One folder per month (``dt=yyyyMM``); only the months present are replaced.

    Rows of one month spread over several tasks by the ``order`` columns, so a large
    month is not written by one.
    """
    placed = df.withColumn("dt", F.col(month))
    if order:
        placed = placed.repartition("dt", *order).sortWithinPartitions("dt", *order)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "dt"
    ).parquet(root)


def write_native(df: DataFrame, path: str) -> None:
    """Native news layer: stable 27 columns even when empty, sorted by id, zstd."""
    df.select(*schemas.NEWS_COLUMNS).sortWithinPartitions("gkg_record_id").write.mode(
        "errorifexists"
    ).option("compression", "zstd").parquet(path)


# ---- manifests -----------------------------------------------------------------------
def manifest_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(key, sha256, bytes) of the Parquet files of a run, hashed where they are read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("key"),
            F.sha2("content", 256).alias("sha256"),
            F.col("length").alias("bytes"),
        )
    )


def build_manifest(spark: SparkSession, root: str, dt: str, run: str, produced_at: str) -> DataFrame:
    """One row describing a run: row count and its parts in key order.

    Fails when the files read by rows and by bytes are not the same set.
    """
    folder = run_path(root, dt, run)
    parts = manifest_parts(spark, folder)
    read = spark.read.parquet(folder).groupBy(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("key")
    ).agg(F.count(F.lit(1)).alias("rows"))
    joined = parts.join(read, "key", "full")
    checked = joined.withColumn(
        "key",
        F.when(
            F.col("sha256").isNull(),
            F.raise_error(F.concat(F.lit("no bytes for "), F.col("key"))).cast("string"),
        ).otherwise(F.col("key")),
    )
    prefix = f"dt={dt}/run={run}/"
    return checked.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("row_count"),
        F.sort_array(
            F.collect_list(
                F.struct(F.concat(F.lit(prefix), F.col("key")).alias("key"), "sha256", "bytes")
            )
        ).alias("parts"),
    ).select(
        F.lit(prefix.rstrip("/")).alias("partition"),
        F.lit(MANIFEST_SCHEMA_VERSION).alias("schema_version"),
        "row_count",
        "parts",
        F.lit(produced_at).alias("produced_at"),
    )


def write_manifest(manifest: DataFrame, root: str, dt: str, run: str) -> str:
    """Write the manifest last, beside the data; its presence marks the run complete."""
    path = f"{run_path(root, dt, run)}/_{MANIFEST_NAME}"
    manifest.coalesce(1).write.mode("errorifexists").json(path)
    return path


_MANIFEST = (
    "partition string, schema_version int, row_count bigint, "
    "parts array<struct<key:string,sha256:string,bytes:bigint>>, produced_at string"
)


def read_manifest(spark: SparkSession, root: str, dt: str, run: str) -> DataFrame:
    # Names that start with an underscore are hidden from globs, not from direct reads.
    return spark.read.schema(_MANIFEST).json(f"{run_path(root, dt, run)}/_{MANIFEST_NAME}")


def verify_manifest(spark: SparkSession, root: str, dt: str, run: str) -> DataFrame:
    """Violations (kind, detail) of a run against its manifest; none means it is whole."""
    manifest = read_manifest(spark, root, dt, run)
    folder = run_path(root, dt, run)
    rows = spark.read.parquet(folder).agg(F.count(F.lit(1))).scalar()
    head = manifest.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        ~F.col("schema_version").eqNullSafe(MANIFEST_SCHEMA_VERSION),
                        F.struct(
                            F.lit("unknown_version").alias("kind"),
                            F.col("schema_version").cast("string").alias("detail"),
                        ),
                    ),
                    F.when(
                        ~F.col("row_count").eqNullSafe(rows),
                        F.struct(
                            F.lit("row_count").alias("kind"),
                            F.col("row_count").cast("string").alias("detail"),
                        ),
                    ),
                    F.when(
                        F.size("parts") == 0,
                        F.struct(F.lit("no_parts").alias("kind"), F.lit("").alias("detail")),
                    ),
                )
            )
        ).alias("v")
    ).select("v.*")
    declared = manifest.select(F.explode("parts").alias("p")).select(
        F.element_at(F.split("p.key", "/"), -1).alias("key"), F.col("p.sha256").alias("declared")
    )
    actual = manifest_parts(spark, folder).select("key", F.col("sha256").alias("actual"))
    compared = declared.join(actual, "key", "left")
    body = compared.where(~F.col("declared").eqNullSafe(F.col("actual"))).select(
        F.when(F.col("actual").isNull(), "missing_part").otherwise("hash_mismatch").alias("kind"),
        F.col("key").alias("detail"),
    )
    return head.unionByName(body)


# ---- serving tables --------------------------------------------------------------------
def load_partition(df: DataFrame, target: str, dt: str, run: str, rename: dict[str, str] | None = None) -> None:
    """Replace exactly the (dt, run) partition of a serving table; a replay changes nothing."""
    rows = df.withColumnsRenamed(rename or {"author_id": "researcher_id"})
    rows.withColumn("dt", F.lit(dt)).withColumn("run", F.lit(run)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("dt", "run").parquet(target)


def upsert(
    df: DataFrame, target: str, keys: Sequence[str], columns: Sequence[str], partition: Sequence[str] = ("dt", "run")
) -> None:
    """Insert rows, or update the given columns of rows with an equal key.

    Only the partitions the new rows touch are read and rewritten; columns not updated
    keep their stored value.  The merged rows are written aside first because a partition
    cannot be overwritten while it is read.
    """
    spark = df.sparkSession
    stored = spark.read.parquet(target)
    touched = df.select(*partition).distinct()
    current = stored.join(touched, list(partition), "left_semi")
    incoming = df.select(*keys, *columns)
    kept = [c for c in stored.columns if c not in keys and c not in columns]
    merged = current.select(*keys, *kept, *[F.col(c).alias(f"_old_{c}") for c in columns]).join(
        incoming.withColumn("_new", F.lit(True)), list(keys), "full"
    )
    result = merged.select(
        *keys,
        *kept,
        *[F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in columns],
    ).select(*stored.columns)
    materialize(result, "upsert").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partition).parquet(target)


def append_jdbc(df: DataFrame, url: str, table: str, dt: str, run: str, properties: dict[str, str]) -> None:
    """Append one (dt, run) to a database table; the caller deletes that pair before."""
    df.withColumn("dt", F.lit(dt)).withColumn("run", F.lit(run)).write.jdbc(
        url, table, mode="append", properties=properties
    )


# ---- cache policy ----------------------------------------------------------------------
@contextmanager
def with_cache(df: DataFrame, mode: str, root: str | None = None, run: str = "run") -> Iterator[DataFrame]:
    """The same rows under one of three cache policies.

    ``full`` writes the table and keeps it (and reuses it when the run exists already);
    ``bounded`` keeps it in executor memory and disk for the block; ``ephemeral``
    recomputes.  An unknown mode means full.
    """
    if mode == CACHE_EPHEMERAL:
        yield df
    elif mode == CACHE_BOUNDED:
        held = df.persist()
        try:
            yield held
        finally:
            held.unpersist()
    else:
        path = f"{root.rstrip('/')}/cache/run={run}" if root else scratch_path(df.sparkSession, "cache")
        df.write.mode("ignore").parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)


def manifest_json(manifest: DataFrame) -> dict:
    """The one-row manifest as a dictionary."""
    return json.loads(manifest.select(F.to_json(F.struct("*"))).first()[0])
