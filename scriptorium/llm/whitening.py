"""Embedding whitening: principal components of scaled integer vectors, from the exact scatter.

Every entry c becomes x = floor(64 c) + 1000000.  One pass sums each dimension; the next, with
every value less its rounded mean, sums the products as integers, so that the covariance is exact
before it becomes floating point, however far the data lie from zero.  Tasks add up their own rows
and send one small table each, which Spark sums by position; the driver sees d * d numbers.

A Cholesky factor of the covariance with diagonal pivoting, which also shows the rank, is rotated
by one-sided Jacobi: planes of its columns are turned until all columns are at right angles.  Then
their squared norms are the eigenvalues and the normalized columns the components.  Two more passes
measure the whitened covariance and return the rows.

Dropped are rows whose vector is null or empty, holds an entry that is null, not finite or of
2**62 / 64 and more (its x would be no long), or is not as long as most vectors (of two equally
frequent lengths the longer counts).  A null id is kept, and rows with equal ids are rows of
their own.  Directions without variance have no component, so equal vectors or a single one give
no rows, like an empty table.  ``deviation`` is null where it is no long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import over_batches, over_streams

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries are below this in size.
LARGEST = 2.0**62

#: Bits of a digit of an integer, and rows whose products of two digits a double sums exactly.
DIGIT, EXACT_ROWS = 22, 1 << 11

ROWS = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def vectors_of(batch: pa.RecordBatch, size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors (rows of a matrix) of the usable vectors, one matrix per length."""
    lengths = pc.fill_null(pc.list_value_length(batch.column("v")), 0)
    for d in [size] if size else sorted(x for x in pc.unique(lengths).to_pylist() if x):
        rows = batch.filter(pc.equal(lengths, d))
        scaled = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * float(SCALE)
        usable = (np.abs(scaled) < LARGEST).all(axis=1)  # false for what is null or not finite
        x = np.floor(scaled[usable]).astype(np.int64) + SHIFT
        yield rows.column("vec_id").filter(pa.array(usable)), x


def _numbers(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows and sums of each dimension, per length of vectors."""
    for _, x in vectors_of(batch):
        n, d = x.shape
        high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)  # either sum fits
        total = [(int(a) << 31) + int(b) for a, b in zip(high, low, strict=True)]
        yield {"d": [d] * d, "pos": list(range(d)), "n": [n] * d, "total": _numbers(total)}


def _digits(z: np.ndarray) -> list[np.ndarray]:
    """Integers as digits of ``DIGIT`` bits around zero, lowest first, each as doubles."""
    out = []
    half = 1 << (DIGIT - 1)
    while not out or z.any():
        low = ((z + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> DIGIT
    return out


def _products(z: np.ndarray) -> dict[int, np.ndarray]:
    """Sums of products of every two columns, as integers by power of two."""
    out: dict[int, np.ndarray] = {}
    for at in range(0, len(z), EXACT_ROWS):
        digits = _digits(z[at : at + EXACT_ROWS])
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                found = (a.T @ b).astype(np.int64)
                power = DIGIT * (i + j)
                out[power] = out[power] + found if power in out else found
    return out


def cholesky(c: np.ndarray) -> np.ndarray:
    """L with c = L L^T, by columns of falling pivots; rows keep the order of ``c``.

    A variable is left out as dependent once rounding is all that remains of its own variance.
    """
    rest, left = np.array(c, dtype=np.longdouble), np.diag(c).astype(np.longdouble)
    noise = 8 * len(c) * np.finfo(np.float64).eps * left
    columns = []
    while True:
        left = np.where(left > noise, left, 0)
        p = int(left.argmax())
        if left[p] <= 0:
            return np.array(columns, dtype=np.float64).reshape(-1, len(c)).T
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        columns.append(column)
        left = np.minimum(np.diag(rest), left)
        left[p] = 0


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns turned in planes until all are at right angles, the longest
    first.  A round turns disjoint pairs at once; the rounds of a sweep meet every pair."""
    a = factor.copy()
    d, r = a.shape
    limit = 4 * np.finfo(np.float64).eps * np.sqrt(d)
    order = list(range(r + r % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(order) - 1):
            pairs = [(p, q) for p, q in zip(order[: len(order) // 2], reversed(order), strict=False) if max(p, q) < r]
            order.insert(1, order.pop())
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > limit * np.sqrt(xx) * np.sqrt(yy)
            if not turn.any():
                continue
            turned = True
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1)
            tangent = np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)) * turn
            cosine = 1 / np.hypot(1, tangent)
            a[:, p], a[:, q] = cosine * (x - tangent * y), cosine * (tangent * x + y)
        if not turned:
            break
    return a[:, np.argsort(-(a * a).sum(axis=0), kind="stable")]


@dataclass(frozen=True)
class Whitening:
    """What whitens vectors of ``size`` entries: values less ``middle`` (whole numbers), of which
    ``rest`` is what they sum to over the ``n`` rows fitted; components are columns."""

    n: int
    size: int
    middle: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def near(self, x: np.ndarray) -> np.ndarray:
        return x - self.middle

    def whitened(self, z: np.ndarray) -> np.ndarray:
        """Rows of :meth:`near` on the components, each with variance one."""
        return (z - self.rest / self.n) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, z: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2.  Integers modulo 2**64 are exact where the sum is
        a long, which doubles tell but for sums next to 2**63, where the top bit does."""
        off = np.int64(self.n) * z - self.rest
        exact = (off * off).sum(axis=1)
        about = ((float(self.n) * z - self.rest) ** 2).sum(axis=1)
        near = np.abs(about / 2.0**63 - 1) < 1e-6
        return pa.array(exact, pa.int64(), mask=~np.where(near, exact >= 0, about < 2.0**63))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))


def _moments(vectors: DataFrame) -> tuple[int, list[int]] | None:
    """Rows and exact sums of each dimension of the vectors of the most frequent length."""
    parts = over_batches(vectors, lambda: _sums, "d int, pos int, n long, total decimal(38,0)")
    sums = parts.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    most = (
        sums.groupBy("d")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("totals"))
        .orderBy(F.desc("n"), F.desc("d"))
        .first()
    )
    return most and (most["n"], [int(t["total"]) for t in most["totals"]])


def _scatter(vectors: DataFrame, middle: np.ndarray) -> np.ndarray:
    """Exact sums of products of near values, a matrix of Python integers."""
    d = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in vectors_of(batch, d):
                for power, found in _products(x - middle).items():
                    whole[power] = whole.get(power, 0) + found.astype(object)
        for power, found in whole.items():
            yield {"power": [power] * d * d, "pos": list(range(d * d)), "total": _numbers(found.ravel())}

    parts = over_streams(vectors, run, "power int, pos int, total decimal(38,0)")
    out = np.zeros(d * d, object)
    for r in parts.groupBy("power", "pos").agg(F.sum("total").alias("total")).collect():
        out[r["pos"]] += int(r["total"]) << r["power"]
    return out.reshape(d, d)


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of all usable vectors; None where there is none."""
    found = _moments(vectors)
    if found is None:
        return None
    n, sums = found
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    scatter = _scatter(vectors, np.array(middle, np.int64))
    # n * n times the covariance is whole; dividing two integers rounds once
    covariance = np.array([[(n * scatter[i, j] - a * b) / (n * n) for j, b in enumerate(rest)] for i, a in enumerate(rest)])
    trace = sum(n * scatter[i, i] - a * a for i, a in enumerate(rest)) / (n * n)
    turned = one_sided_jacobi(cholesky(covariance))[:, :components]
    lengths = np.sqrt((turned * turned).sum(axis=0))
    axes = turned / lengths
    if axes.shape[1]:  # the largest entry of a component is positive
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitening(n, len(sums), np.array(middle, np.int64), np.array(rest, np.int64), axes, lengths**2, trace)


def identity_error(vectors: DataFrame, by: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = by.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in vectors_of(batch, by.size):
                w = by.whitened(by.near(x))  # centred: values are less their mean here
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield {"pos": list(range(total.size)), "total": total.ravel()}

    sums = over_streams(vectors, run, "pos int, total double").groupBy("pos").agg(F.sum("total").alias("total"))
    out = np.zeros((k + 1) * k)
    for r in sums.collect():
        out[r["pos"]] = r["total"]
    out = out.reshape(k + 1, k) / by.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


def whiten(
    embeddings: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row per usable vector and component (the first ``components`` with variance): ``vec_id``,
    ``component`` from 1 by falling variance, ``n`` vectors, ``deviation`` of the vector (sum over
    dimensions of (n x - S)^2), ``whitened`` value, ``explained`` share of the variance and
    ``identity_error`` of the whole result.

    The table is read four times, each time by itself and without a shuffle of its rows.
    """
    vectors = _vectors(embeddings, id_col, vector_col)
    by = fit(vectors, components)
    if by is None or not by.components.shape[1]:
        return embeddings.sparkSession.createDataFrame([], ROWS)
    error = identity_error(vectors, by)
    k = by.components.shape[1]

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for ids, x in vectors_of(batch, by.size):
            z = by.near(x)
            m = len(z)
            row = pa.array(np.repeat(np.arange(m), k))
            yield {
                "vec_id": ids.take(row),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, by.n)),
                "deviation": by.deviation(z).take(row),
                "whitened": pa.array(by.whitened(z).ravel()),
                "explained": pa.array(np.tile(by.eigenvalues / by.trace, m)),
                "identity_error": pa.array(np.full(m * k, error)),
            }

    return over_batches(vectors, lambda: each, ROWS)
