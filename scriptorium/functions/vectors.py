"""Vector columns: dot products, norms, complementarity, pair features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: weights of the complementarity score ------------------------------
COMPLEMENTARITY_WEIGHTS = {"domain": 0.2, "field": 0.3, "subfield": 0.5}
COMPLEMENTARITY_WEIGHTS_KEYWORDS = {
    "domain": 0.2,
    "field": 0.25,
    "subfield": 0.45,
    "keyword": 0.1,
}
ENSEMBLE_WEIGHTS = {"tfidf": 0.5, "embedding": 0.5}
ZERO_NORM = 1e-9
# -------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length, summed in index order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when either has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.transform(
        F.arrays_zip(a.alias("x"), F.array_repeat(norm(a), F.size(a)).alias("n")),
        lambda s: F.when(s["n"] > 0, s["x"].cast("double") / s["n"]).otherwise(
            s["x"].cast("double")
        ),
    )


def complementarity(sims: dict[str, Column]) -> Column:
    """Shared context times distance of topics.

    ``sims`` holds the normalised cosine per level (domain, field, subfield, topic and,
    when keywords take part, keyword).
    """
    weights = COMPLEMENTARITY_WEIGHTS_KEYWORDS if "keyword" in sims else COMPLEMENTARITY_WEIGHTS
    terms = [sims[level] * weight for level, weight in weights.items()]
    return sum(terms[1:], terms[0]) * (1 - sims["topic"])


def ensemble(
    tfidf: Column, embedding: Column, weights: dict[str, float] | None = None
) -> Column:
    w = weights or ENSEMBLE_WEIGHTS
    return tfidf * w["tfidf"] + embedding * w["embedding"]


def is_finite(a: Column) -> Column:
    """No NaN and no infinity in the array."""
    return F.forall(
        a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & x.isNotNull()
    )


def _stack(series: pd.Series, dim: int) -> np.ndarray:
    """Rows of an array column as a matrix, missing vectors as zeros."""
    out = np.zeros((len(series), dim))
    held = series.notna().to_numpy()
    if held.any():
        out[held] = np.concatenate(series.to_numpy()[held]).reshape(-1, dim)
    return out


def _symmetric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Terms that do not change when the two sides are swapped."""
    gap = a - b
    inner = np.einsum("ij,ij->i", a, b)[:, None]
    return np.hstack([inner, np.sqrt(np.square(gap).sum(axis=1))[:, None], np.abs(gap), a * b])


def pair_features(theme_dim: int, embedding_dim: int = 0):
    """Arrow function of two thematic and two embedding columns to a feature array.

    Layout: cosine, distance, absolute difference and product of the thematic vectors;
    then, when ``embedding_dim`` > 0, a flag and the same terms of the embeddings, all
    zero where a side has none.  Batches stream through, so a task holds one Arrow
    batch at a time.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.Series]:
        for theme_a, theme_b, emb_a, emb_b in batches:
            themes = _stack(theme_a, theme_dim), _stack(theme_b, theme_dim)
            if not embedding_dim:
                yield pd.Series(list(pair_terms(*themes)))
                continue
            present = (emb_a.notna() & emb_b.notna()).to_numpy()
            yield pd.Series(list(pair_terms(*themes, _stack(emb_a, embedding_dim), _stack(emb_b, embedding_dim), present)))

    return features


def pair_terms(theme_a, theme_b, emb_a=None, emb_b=None, present=None) -> np.ndarray:
    """Rows of :func:`pair_features` from matrices; ``present`` tells where both have embeddings."""
    parts = [_symmetric(theme_a, theme_b)]
    if emb_a is not None:
        flag = present.astype(float)[:, None]
        parts += [flag, _symmetric(emb_a, emb_b) * flag]
    return np.hstack(parts)


def stacked(vectors: pd.Series, dim: int) -> np.ndarray:
    """A column of vectors as a matrix, zeros where there is none."""
    return _stack(vectors, dim)


def packed_bytes(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a binary array without nulls start, from 0, and all their bytes."""
    if not len(packed):
        return np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.uint8)
    _, offsets, data = packed.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return ends - ends[0], np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]


def read_doubles(packed: pa.Array) -> pa.Array:
    """Bytes of little-endian doubles as arrays, without a copy; no value is null."""
    ends, data = packed_bytes(packed)
    return pa.ListArray.from_arrays(pa.array(ends // 8), pa.array(data.view(np.float64)))


def matrix(arrays: pa.Array) -> np.ndarray:
    """Arrays of equal length as rows."""
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1 if len(arrays) else 0)


def doubles(column: Column | str) -> Column:
    """:func:`read_doubles` of a binary column."""
    return F.arrow_udf(read_doubles, T.ArrayType(T.DoubleType()))(column)
