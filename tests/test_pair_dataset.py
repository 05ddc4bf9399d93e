"""Pair features without wide shuffles, and baselines without models."""

from __future__ import annotations

import numpy as np
import pytest

from scriptorium.functions import vectors
from scriptorium.operators import learn


def test_baselines_of_folds_fit_no_model(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i % 9, float(i * i % 17)) for i in range(90)], "author_a int, y double")
    whole = learn.evaluate_grouped(rows.withColumn("features", array_to_vector(F.array("y"))), iterations=1)
    expected = sorted((r.fold, round(r.baseline_mae, 9), r.n_obs) for r in whole.collect())

    def refuse(*_):
        raise AssertionError("a model is fitted")

    monkeypatch.setattr(learn, "gbt", refuse)
    assert sorted((r.fold, round(r.baseline_mae, 9), r.n_obs) for r in learn.grouped_baselines(rows).collect()) == expected
    assert learn.grouped_baselines(rows.where("author_a = 1")).collect() == []


@pytest.mark.parametrize("size", [64 << 20, 600])
def test_pairs_meet_their_vectors_in_groups(spark, monkeypatch, size):
    monkeypatch.setattr(learn, "GROUP_BYTES", size)
    rng = np.random.default_rng(2)
    theme, emb = rng.normal(size=(12, 3)), rng.normal(size=(12, 2))
    themes = spark.createDataFrame([(i, theme[i].tolist()) for i in range(11)], "author_id long, vector array<double>")
    some = spark.createDataFrame([(i, emb[i].tolist()) for i in range(0, 12, 2)], "author_id long, vector array<double>")
    pairs = [(a, b, float(a)) for a in range(12) for b in range(a + 1, 12)]
    labels = spark.createDataFrame(pairs, "author_a long, author_b long, uplift double")
    rows = learn.build_pair_dataset(labels, themes, some, 3, 2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    got = {(r.author_a, r.author_b, r.y): r.features.toArray() for r in rows.collect()}
    assert set(got) == {p for p in pairs if p[1] < 11}
    for (a, b, _), found in got.items():
        both = np.array([a % 2 == 0 and b % 2 == 0])
        expected = vectors.pair_terms(theme[[a]], theme[[b]], emb[[a]], emb[[b]], both)[0]
        assert np.allclose(found, expected, atol=1e-12)


def test_features_leave_pandas_as_bytes(spark):
    themes = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "author_id long, vector array<double>")
    rows = learn.pair_vectors(spark.createDataFrame([(0, 1), (0, 2)], "author_a long, author_b long"), themes, None, 2)
    node = rows._jdf.queryExecution().analyzed()
    while "CoGroups" not in node.nodeName():
        node = node.children().head()
    assert node.schema().apply("_f").dataType().simpleString() == "binary"
    assert {r.author_b: len(r.features) for r in rows.collect()} == {1: 6, 2: 6}


def test_bytes_are_read_from_slices():
    import pyarrow as pa

    numbers = np.arange(12, dtype=float).reshape(6, 2)
    packed = pa.array([row.tobytes() for row in numbers])
    for part in (packed, packed.slice(2, 3), packed.slice(6), packed.slice(0, 0)):
        at = [int(np.frombuffer(b, float)[0]) // 2 for b in part.to_pylist()]
        assert vectors.read_doubles(part).to_pylist() == numbers[at].tolist()
