"""Token ids in files of bit-plane shuffled, compressed chunks.

A chunk holds up to ``chunk_ids`` ids of neighbouring documents.  Its ids are transposed
into planes (the lowest bytes, or bits, of all ids, then the next ones), because ids of one
vocabulary share their high planes; each plane is compressed with zstandard on its own and
planes of zeros are left out.  A file row is one chunk with its place in the chunk index:
shard, chunk number, first id within the shard, number of ids, and which documents' ids it
holds.  Parquet is the container, so Spark's committer makes the files of a lost task
vanish and any store that Spark reads will do.

Writing deals the documents out by ranges of their id and sorts within; the offset of a
shard is the sum of the shards before it.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import (
    blocks,
    bucket_of,
    over_batches,
    over_streams,
    range_bounds,
    shuffle_partitions,
)
from scriptorium.llm.tokens import token_arrays

CHUNK_IDS = 1 << 16
LEVEL = 1

CHUNK_SCHEMA = (
    "shard int, chunk long, first long, n_ids long, width int, kind string, "
    "planes array<binary>, docs array<long>, doc_starts array<long>, doc_pieces array<long>"
)


def shuffle_planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> list[bytes]:
    """The compressed planes of a block of uint32 ids, lowest first; an all-zero plane is empty."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = cells.T
    elif kind == "bit":
        bits = np.unpackbits(cells, axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1)
    else:
        raise ValueError(f"planes are of kind byte or bit, not {kind}")
    return [pack(np.ascontiguousarray(p)) if p.any() else b"" for p in planes]


def restore_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    """The ids of :func:`shuffle_planes`."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    width = n_ids if kind == "byte" else (n_ids + 7) // 8
    rows = np.zeros((len(planes), width), np.uint8)
    for i, p in enumerate(planes):
        if p:
            rows[i] = np.frombuffer(unpack(p), np.uint8)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, count=n_ids)
        cells = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        cells = np.ascontiguousarray(rows.T)
    return cells.reshape(-1).view("<u4")


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_ids: int = CHUNK_IDS,
    kind: str = "byte",
) -> None:
    """Encode every whole text, append ``end_id``, and write the chunks in ascending id order.

    A null text counts as empty (the end id alone).  Rows with a null id come first in shard
    0; rows with equal ids follow each other in any order.  An empty table writes no chunk.
    A document may span chunks; no task holds more than one chunk and one Arrow batch.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    parts = shuffle_partitions(spark)
    bounds = range_bounds(rows, "doc_id", parts)
    dealt = (
        rows.withColumn("shard", bucket_of(F.col("doc_id"), bounds))
        .repartitionById(max(1, len(bounds)), F.col("shard"))
        .sortWithinPartitions("shard", "doc_id")
    )

    def run(batches):
        encode = token_arrays(tokenizer_path, drops_space=False)
        end = np.array([end_id], "<u4")
        held: list[np.ndarray] = []
        docs: list[tuple] = []
        state = {"shard": None, "chunk": 0, "first": 0, "held": 0}

        def chunk(size: int):
            nonlocal held, docs
            ids = np.concatenate(held) if held else np.zeros(0, "<u4")
            out, rest = ids[:size], ids[size:]
            taken, left, room = [], [], size
            for doc, start, piece in docs:
                now = min(piece, room)
                if now:
                    taken.append((doc, start, now))
                    room -= now
                if piece > now:
                    left.append((doc, start + now, piece - now))
            row = {
                "shard": [state["shard"]],
                "chunk": [state["chunk"]],
                "first": [state["first"]],
                "n_ids": [len(out)],
                "width": [chunk_ids],
                "kind": [kind],
                "planes": [shuffle_planes(out, kind)],
                "docs": [[d for d, _, _ in taken]],
                "doc_starts": [[s for _, s, _ in taken]],
                "doc_pieces": [[p for _, _, p in taken]],
            }
            held, docs = ([rest] if len(rest) else []), left
            state["chunk"] += 1
            state["first"] += len(out)
            state["held"] = len(rest)
            return row

        for batch in batches:
            for block in blocks(batch, "text"):
                arrays = encode([t or "" for t in block.column("text").to_pylist()])
                ids = block.column("doc_id").to_pylist()
                for shard, doc, found in zip(block.column("shard").to_pylist(), ids, arrays, strict=True):
                    if shard != state["shard"]:
                        while state["held"]:
                            yield chunk(chunk_ids)
                        state.update(shard=shard, chunk=0, first=0)
                    held += [found, end]
                    docs.append((doc, 0, len(found) + 1))
                    state["held"] += len(found) + 1
                    while state["held"] >= chunk_ids:
                        yield chunk(chunk_ids)
        while state["held"]:
            yield chunk(chunk_ids)

    found = over_streams(dealt, run, CHUNK_SCHEMA)
    found.write.option("compression", "none").parquet(path)


def shard_offsets(chunks: DataFrame) -> DataFrame:
    """``shard`` and ``before``: the ids of all shards before it.  One row a shard."""
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of documents in the files: ``doc_id``, ``start`` (the ids of all documents
    before it, in file order), ``at`` (the document's ids before the piece) and ``ids``."""
    return _pieces(spark, path, False)


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Pieces of one document in several chunks meet by its start; their checksums are combined
    without their ids.
    """
    pieces = _pieces(spark, path, True)
    whole = pieces.groupBy("doc_id", "start").agg(
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"),
    )
    one = whole.where(F.size("parts") == 1).select(
        "doc_id", "start", "n_tokens", F.col("parts")[0]["crc"].alias("ids_crc32")
    )

    def begin():
        def each(batch):
            rows = batch.to_pylist()
            yield {
                "doc_id": [r["doc_id"] for r in rows],
                "start": [r["start"] for r in rows],
                "n_tokens": [r["n_tokens"] for r in rows],
                "ids_crc32": [_combined(r["parts"]) for r in rows],
            }

        return each

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return one.unionByName(over_batches(whole.where(F.size("parts") > 1), begin, schema))


def _pieces(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)

    def begin():
        def each(batch):
            for row in batch.to_pylist():
                ids = restore_planes(row["planes"], row["n_ids"], row["kind"])
                cut = np.cumsum([0, *row["doc_pieces"]])
                parts = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                found = {
                    "shard": [row["shard"]] * len(parts),
                    "doc_id": row["docs"],
                    "local": [row["first"] + int(a) - s for a, s in zip(cut[:-1], row["doc_starts"], strict=True)],
                    "at": row["doc_starts"],
                }
                if digest:
                    yield found | {"n": row["doc_pieces"], "crc": [zlib.crc32(p) for p in parts]}
                else:
                    yield found | {"ids": [p.astype(np.int64) for p in parts]}

        return each

    tail = "n long, crc long" if digest else "ids array<long>"
    found = over_batches(chunks, begin, f"shard int, doc_id long, local long, at long, {tail}")
    offsets = shard_offsets(chunks.select("shard", "n_ids"))
    return (
        found.join(F.broadcast(offsets), "shard")  # one row a shard, as many as shuffle partitions
        .withColumn("start", F.col("before") + F.col("local"))
        .drop("shard", "before", "local")
    )


def _combined(parts: list[dict]) -> int:
    """crc32 of joined pieces from theirs: the checksum is linear, so a piece is moved by
    running zero bytes through it, by squares of the one-bit shift."""
    total = 0
    for p in parts:
        total = _shifted(total, 4 * p["n"]) ^ p["crc"]
    return total


def _shifted(crc: int, zeros: int) -> int:
    """``crc`` of a text as if ``zeros`` zero bytes followed, without initial and final flips."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit: bit i goes to bit i - 1
    times = 8 * zeros
    while times:
        if times & 1:
            crc = _times(step, crc)
        step = [_times(step, row) for row in step]
        times >>= 1
    return crc


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out
