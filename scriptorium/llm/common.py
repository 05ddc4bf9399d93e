"""Helpers that several operators share: Arrow batches, word caches, scratch tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.session import scratch_path

#: Words that one generation of a cache holds; a cache holds two generations.
CACHE_WORDS = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def over_batches(
    df: DataFrame, begin: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], schema: str
) -> DataFrame:
    """``df`` through Arrow batches: ``begin()`` runs once a task and returns the function
    that turns a batch into dicts of columns."""
    fields = T._parse_datatype_string(schema)
    shape = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begin()
        for batch in batches:
            for columns in each(batch):
                arrays = [
                    c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False)
                    for c, f in ((columns[f.name], f) for f in shape)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return df.mapInArrow(run, fields)


def over_streams(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str
) -> DataFrame:
    """``df`` through ``run``, which reads all batches of a task and yields dicts of columns."""
    fields = T._parse_datatype_string(schema)
    shape = to_arrow_schema(fields)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in shape], schema=shape
            )

    return df.mapInArrow(arrow, fields)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back.

    Cuts lineage so that a lost executor costs one read of a shared file, and keeps
    a costly Python stage from running once for every reader of its rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    # Spark drops the shuffle files of a finished plan when the driver's collector finds the plan
    # gone, which a driver with little garbage may never do; at scale they fill the disks.
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_stored(df: DataFrame | None) -> None:
    """Delete a table of :func:`stored` that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def worker_cache(name: str) -> dict:
    """A dict that lives until the Python worker serves another operator, so that the next task of
    the same one finds it filled."""
    return _caches().setdefault(name, {})


def _caches() -> dict:
    return sys.__dict__.setdefault("_scriptorium_caches", {})


def end_caches(but: str | None = None) -> None:
    """Drop what other operators left in this worker; a task calls it as it begins."""
    caches = _caches()
    for name in [n for n in caches if n != but]:
        del caches[name]


class WordCache:
    """Values of words, computed in batches by ``compute`` and kept for two generations.

    Memory is bounded by twice ``limit`` words; a dropped word is computed again.
    """

    def __init__(self, name: str, compute: Callable[[list[str]], list], limit: int = CACHE_WORDS):
        end_caches(but=name)
        self.state = worker_cache(name)
        self.state.setdefault("new", {})
        self.state.setdefault("old", {})
        self.compute, self.limit = compute, limit

    def fill(self, lists: Iterable[list[str]]) -> dict:
        """A dict that has every word of ``lists``."""
        new, old = self.state["new"], self.state["old"]
        if len(new) > self.limit:
            self.state["old"] = old = new
            self.state["new"] = new = {}
        missing = set()
        for words in lists:
            missing.update(words)
        missing.difference_update(new)
        if missing:
            missing = list(missing)
            for word in missing:
                if word in old:
                    new[word] = old[word]
            missing = [w for w in missing if w not in new]
            if missing:
                new.update(zip(missing, self.compute(missing), strict=True))
        return new


def blocks(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with at most ``limit`` bytes of text each (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` values of an integer column that start ranges of about equal size.

    The first is the smallest value.  Only the column is read; what reaches the driver
    are ``parts`` numbers.  Empty when the column has no value.
    """
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(
        F.min(key).alias("least"),
        F.percentile_approx(key, shares or [0.5], 10 * max(parts, 100)).alias("cuts"),
    ).first()
    if found is None or found["least"] is None:
        return []
    return sorted({found["least"], *(found["cuts"] if shares else [])})


def bucket_of(key, bounds: list[int]):
    """Index of the last bound that is <= ``key`` (0 for null, or with no bound), by a binary
    search written as nested conditions."""

    def between(low: int, high: int):
        if high - low <= 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], between(low, middle)).otherwise(between(middle, high))

    return F.when(key.isNull(), F.lit(0)).otherwise(between(0, len(bounds))).cast("int")
