"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor when the least of its inner s-mers (by hash) lies at one
of its two ends.  Whether it is one depends on its own characters only, so an edit moves no
anchor elsewhere in the text.  A fingerprint keeps the anchors of least hash, each with its
first place; two fingerprints are compared by the anchors they share whose displacement
agrees with the usual one, as a share of the least anchors of both.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import blocks, bucket_of, over_streams, range_bounds, shuffle_partitions

K, S = 20, 8
#: Anchors that a fingerprint keeps.
ANCHORS = 64
#: Characters looked at at once; longer texts go block by block.
BLOCK = 1 << 20

_FIRST = -(1 << 63)
_ONE = np.dtype([("hash", "<u4"), ("at", "<u4")])


def code_points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and places of the closed syncmers; of a text without one, the text itself."""
    n, width = len(points), k - s + 1
    hashes, places = [], []
    for begin in range(0, n - k + 1, BLOCK):
        part = points[begin : begin + BLOCK + k - 1].astype(np.uint64)
        inner = part[: len(part) - s + 1].copy()
        for j in range(1, s):
            inner *= np.uint64(0x100000001B3)
            inner += part[j : len(part) - s + 1 + j]
        inner = _mix(inner)
        least, span = inner, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        tail = inner[width - 1 :]
        at = np.flatnonzero((least == inner[: len(least)]) | (least == tail))
        whole = inner[at] * np.uint64(3) + inner[at + (width - 1) // 2] * np.uint64(5) + tail[at]
        for j in range(s, k - s, s):  # every character of the k-mer counts
            whole = whole * np.uint64(7) + inner[at + j]
        hashes.append(_mix(whole) >> np.uint64(32))
        places.append(at + begin)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if len(found):
        return found.astype("<u4"), np.concatenate(places).astype("<u4")
    if not n:
        return np.zeros(0, "<u4"), np.zeros(0, "<u4")
    digest = hashlib.blake2b(points.tobytes(), digest_size=4).digest()
    return np.frombuffer(digest, "<u4"), np.zeros(1, "<u4")


def fingerprint(points: np.ndarray, keep: int = ANCHORS) -> np.ndarray:
    """The ``keep`` least anchors, by hash, each with its first place."""
    hashes, places = anchors(points)
    if len(hashes) > 4 * keep:  # the least ones with all their repeats
        limit = np.partition(hashes, 4 * keep)[4 * keep]
        few = hashes <= limit
        if len(np.unique(hashes[few])) >= keep:
            hashes, places = hashes[few], places[few]
    values, first = np.unique(hashes, return_index=True)
    out = np.empty(min(keep, len(values)), _ONE)
    out["hash"], out["at"] = values[:keep], places[first[:keep]]
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int = ANCHORS) -> float:
    """Share of the least anchors of both that both have at agreeing places (0 to 1)."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a["hash"], b["hash"])[:keep]
    both, i, j = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    there = both <= union[-1]
    if not there.any():
        return 0.0
    moved = b["at"][j[there]].astype(np.int64) - a["at"][i[there]]
    reach = 20 + 0.05 * max(int(a["at"].max()), int(b["at"].max()))
    agree = np.abs(moved - np.median(moved)) <= reach
    return float(agree.sum()) / len(union)


def text_of(found: np.ndarray) -> str:
    """A fingerprint as a string (base 64 of hash and place, 8 bytes an anchor)."""
    return base64.b64encode(found.tobytes()).decode()


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every whole text, where it is read.

    Null and empty texts have an empty fingerprint; equal texts have equal ones.
    """
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for block in blocks(batch, "text"):
                points = [code_points(t or "") for t in block.column("text").to_pylist()]
                yield {
                    "doc_id": block.column("doc_id").to_pylist(),
                    "n_chars": [len(p) for p in points],
                    "fingerprint": [text_of(fingerprint(p)) for p in points],
                }

    return over_streams(rows, run, "doc_id long, n_chars long, fingerprint string")


def edited_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text beside its edited text, whose last floor(n/2) code points are the first
    ones of the next document by id (all of it, if shorter; the first document follows the last).

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.  Null texts count as empty; rows with a null id come
    first; rows with equal ids follow each other by text.  Documents are dealt out by ranges of
    the id, and the first document of a range also goes to the range before, so that one
    shuffle brings every document to its next.
    """
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    ).withColumn("place", F.coalesce("doc_id", F.lit(_FIRST)))
    bounds = range_bounds(rows, "place", shuffle_partitions(df.sparkSession))
    parts = max(1, len(bounds))
    own = bucket_of(F.col("place"), bounds)
    heads = F.array(*[F.lit(b) for b in bounds or [_FIRST]])
    ahead = F.struct(F.pmod(F.col("own") - 1, F.lit(parts)).alias("part"), F.lit(1).alias("ahead"))
    mine = F.struct(F.col("own").alias("part"), F.lit(0).alias("ahead"))
    dealt = (
        rows.withColumn("own", own)
        .withColumn(
            "to",
            F.explode(
                F.when(F.col("place") == heads[F.col("own")], F.array(mine, ahead)).otherwise(F.array(mine))
            ),
        )
        .select("doc_id", "text", "place", "to.part", "to.ahead")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "ahead", "place", "text")
    )

    def run(batches):
        before, over = None, None
        for batch in batches:
            for block in blocks(batch, "text"):
                out = []
                for doc, text, part, ahead in zip(
                    block.column("doc_id").to_pylist(),
                    block.column("text").to_pylist(),
                    block.column("part").to_pylist(),
                    block.column("ahead").to_pylist(),
                    strict=True,
                ):
                    if part == over:  # a further row with the id of the head
                        continue
                    now = (doc, text, points := code_points(text), fingerprint(points))
                    if before is not None:
                        out.append(_compared(before, now))
                    before, over = (None, part) if ahead else (now, over)
                if out:
                    yield {name: [r[i] for r in out] for i, name in enumerate(_EDITED)}

    return over_streams(dealt.select("doc_id", "text", "part", "ahead"), run, _EDITED_SCHEMA)


_EDITED_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_EDITED = [f.split()[0] for f in _EDITED_SCHEMA.split(", ")]


def _compared(one: tuple, following: tuple) -> tuple:
    doc, text, points, found = one
    half = len(points) // 2
    edited = text[: len(points) - half] + following[1][:half]
    other = fingerprint(np.concatenate([points[: len(points) - half], following[2][:half]]))
    return (
        doc,
        len(points),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        text_of(found),
        text_of(other),
        likeness(found, other),
        likeness(found, following[3]),
    )
