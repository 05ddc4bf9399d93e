"""op13 against eigenvectors of a covariance of exact integers."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import catalog, whitening
from tests.llm import fixtures as fx

SHAPE = "vec_id long, embedding array<float>"


def plain(vectors: list[list[float]]):
    """Integers, row deviations, covariance, eigenvalues (falling) and components."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    off = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    deviation = [sum(c * c for c in r) for r in off]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    return np.array([[c / n for c in r] for r in off]), deviation, cov, e[::-1], v[:, ::-1]


def table(rows) -> dict:
    return {(r.vec_id, r.component): r for r in rows}


def compare(spark, vectors, tolerance=1e-8, components=32):
    y, deviation, cov, e, v = plain(vectors)
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(vectors)], SHAPE).repartition(3)
    rows = whitening.whiten(df, components).collect()
    k = min(components, len(vectors[0]))
    assert len(rows) == len(vectors) * k
    got = table(rows)
    for c in range(1, k + 1):
        want = y @ v[:, c - 1] / math.sqrt(e[c - 1])
        found = np.array([got[i, c].whitened for i in range(len(vectors))])
        sign = 1 if found @ want > 0 else -1
        assert np.abs(found * sign - want).max() < tolerance * max(1, np.abs(want).max())
        assert abs(got[0, c].explained / (e[c - 1] / np.trace(cov)) - 1) < 1e-9
    assert [got[i, 1].deviation for i in range(len(vectors))] == [x if x < 2**63 else None for x in deviation]
    assert {r.n for r in rows} == {len(vectors)} and len({r.identity_error for r in rows}) == 1
    white = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in range(len(vectors))])
    error = np.abs(np.cov(white.T, bias=True) - np.eye(k)).max()
    assert rows[0].identity_error < tolerance and abs(rows[0].identity_error - error) < 1e-9


def test_op13_against_plain_version(spark):
    draw = np.random.default_rng(3)
    compare(spark, draw.normal(size=(300, 12)) @ draw.normal(size=(12, 12)))
    compare(spark, draw.normal(size=(200, 40)) * np.geomspace(1, 30, 40), components=5)


def test_op13_far_from_zero(spark):
    """Variance is small beside the mean: products are taken after centring."""
    draw = np.random.default_rng(5)
    compare(spark, 100_000 + draw.normal(size=(250, 6)) * [4, 3, 2.5, 2, 1, 8])


def test_op13_outliers(spark):
    """Entries of very different size are summed exactly."""
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(120, 4)) * [1e9, 1e5, 50, 4]
    compare(spark, vectors, tolerance=1e-6)


def test_op13_whole_table(spark):
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{fx.SF}/embeddings.parquet").collect()}
    rows = catalog.QUERIES["op13_whitening"](spark, fx.SF).collect()
    ids = sorted(source)
    y, deviation, cov, e, v = plain([source[i] for i in ids])
    got = table(rows)
    assert len(rows) == 32 * len(ids)
    for c in range(1, 33):
        want = y @ v[:, c - 1] / math.sqrt(e[c - 1])
        found = np.array([got[i, c].whitened for i in ids])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-8
        assert abs(got[ids[0], c].explained / (e[c - 1] / np.trace(cov)) - 1) < 1e-9
    assert [got[i, 1].deviation for i in ids] == deviation and rows[0].identity_error < 1e-9


def test_op13_edges(spark):
    draw = random.Random(1)
    good = [(i, [draw.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, math.nan, 2.0]), (53, [math.inf, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [1e38, 0.0, 0.0])]
    extra = [(None, good[0][1]), (3, good[3][1])]  # no id, and an id twice
    df = spark.createDataFrame(good + bad + extra, SHAPE).selectExpr("*", "'x' AS component", "1 AS n", "2 AS v")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 42 * 3 and {r.n for r in rows} == {42}
    assert sorted({r.vec_id for r in rows if r.vec_id is not None}) == list(range(40))
    assert sum(r.vec_id is None for r in rows) == 3 and sum(r.vec_id == 3 for r in rows) == 6
    assert whitening.whiten(df.limit(0)).columns == [f.split()[0] for f in whitening.ROWS.split(", ")]
    for same in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(same, SHAPE)).count() == 0


def test_op13_dependent_dimensions(spark):
    """Directions without variance have no component; the others are whitened as ever."""
    draw = random.Random(2)
    rows = [(i, [a := float(draw.randrange(50)), b := float(draw.randrange(9)), a + b, 7.0]) for i in range(60)]
    found = whitening.whiten(spark.createDataFrame(rows, SHAPE)).collect()
    assert {r.component for r in found} == {1, 2} and found[0].identity_error < 1e-9
    assert abs(sum(r.explained for r in found if r.vec_id == 0) - 1) < 1e-9


def test_op13_long_deviations(spark):
    """A deviation beyond a long is null; below it is exact."""
    x = np.array([[2**31], [-(2**31)], [5]], np.int64)
    by = whitening.Whitening(1, 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones((1, 1)), np.ones(1), 1.0)
    assert by.deviation(x).to_pylist() == [2**62, 2**62, 25]
    assert by.deviation(np.array([[3_037_000_499], [3_037_000_500], [2**33]], np.int64)).to_pylist() == [3_037_000_499**2, None, None]


@pytest.mark.parametrize("size", [1, 2, 5, 16])
def test_jacobi_on_the_factor(size):
    draw = np.random.default_rng(size)
    a = draw.normal(size=(3 * size, size)) * np.geomspace(1, 1e6, size)
    c = a.T @ a
    factor = whitening.cholesky(c)
    assert np.abs(factor @ factor.T - c).max() <= 1e-13 * np.abs(c).max()
    turned = whitening.one_sided_jacobi(factor)
    lengths = np.sqrt((turned**2).sum(axis=0))
    assert np.abs((turned / lengths).T @ (turned / lengths) - np.eye(size)).max() < 1e-13
    assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-9)
