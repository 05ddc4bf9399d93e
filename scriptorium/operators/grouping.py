"""Leader clustering of strings: in order, a string joins the first leader it is like, or leads.

Like strings share a key: a segment of one that an edit distance must leave whole, or an n-gram that
a Jaccard index cannot do without.  Strings meet by their keys, pairs are compared in the stage that
joins them, and only the earliest like string of each leaves it.  Strings are taken in waves by
position, each eight times as large: a wave is settled by rounds, in which who has no earlier like
string leads and whose earliest like string leads follows it; then all later strings look for a leader
of the wave.  What a wave's leaders take goes no further, so a large group of like strings is met by
its leader and not by itself.  Waves grow with the logarithm of the strings, rounds with the longest
chain in which the choice of one string hangs on the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text
from scriptorium.operators.dedup import unique_ci
from scriptorium.session import materialize

# ---- fixed values --------------------------------------------------------------------
EDIT_THRESHOLD = 0.75
NGRAM_THRESHOLD = 0.5
NGRAM_SIZES = (2, 3)
# -------------------------------------------------------------------------------------

#: Strings of the first wave, about, and how much larger the next ones are.
FIRST_WAVE, GROWTH = 2_048, 8
#: What rounding may take from a product that is a whole number.
EPSILON = 1e-9


@dataclass(frozen=True)
class Likeness:
    """How strings are compared.

    ``score`` of what ``prepare`` makes of two strings; two that reach the threshold have an ``own``
    key of the one among the ``sought`` keys of the other, in one of the two directions (in both
    where they are the same, ``symmetric``).
    """

    prepare: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]
    own: Callable[[Column], Column]
    sought: Callable[[Column], Column]
    symmetric: bool = False


def edit_likeness(threshold: float) -> Likeness:
    """Edit similarity.  Of two strings at most d edits apart, one of d + 1 segments of the shorter
    stands in the longer, no further from its place than the edits before and after it allow."""

    def whole(x: Column) -> Column:
        return F.floor(x + EPSILON).cast("int")

    def distance(longer: Column) -> Column:
        return whole(longer * (1 - threshold))

    def segment(length: Column, d: Column, i: Column) -> tuple[Column, Column]:
        """Start (from 0) and length of segment ``i``; the last ones are one longer."""
        base = F.floor(length / (d + 1)).cast("int")
        short = d + 1 - length % (d + 1)
        return i * base + F.greatest(F.lit(0), i - short), base + F.when(i >= short, 1).otherwise(0)

    def key(length: Column, d: Column, i: Column, value: Column) -> Column:
        return F.xxhash64(length.cast("int"), d.cast("int"), i.cast("int"), value)

    def span(low: Column, high: Column, each: Callable[[Column], Column], kind: str) -> Column:
        return F.when(low <= high, F.transform(F.sequence(low, high), each)).otherwise(F.array().cast(kind))

    def own(s: Column) -> Column:
        size = F.length(s)

        def of(d: Column) -> Column:
            def one(i: Column) -> Column:
                start, length = segment(size, d, i)
                return key(size, d, i, s.substr(start + 1, length))

            return F.transform(F.sequence(F.lit(0), d), one)

        least, most = distance(size), distance(whole(size / threshold))
        return F.flatten(span(least, most, of, "array<array<bigint>>"))

    def sought(s: Column) -> Column:
        size = F.length(s)
        d = distance(size)

        def of(shorter: Column) -> Column:
            gap = size - shorter

            def one(i: Column) -> Column:
                start, length = segment(shorter, d, i)
                low = F.greatest(F.lit(0), start - i, start + gap - (d - i))
                high = F.least(size - length, start + i, start + gap + (d - i))
                return span(low, high, lambda p: key(shorter, d, i, s.substr(p + 1, length)), "array<bigint>")

            return F.flatten(F.transform(F.sequence(F.lit(0), d), one))

        least = F.ceil(size * threshold - EPSILON).cast("int")
        return F.flatten(span(least, size, of, "array<array<bigint>>"))

    return Likeness(lambda s: s, text.edit_similarity, own, sought)


def ngram_likeness(
    threshold: float, sizes: Sequence[int] = NGRAM_SIZES, weights: Sequence[float] | None = None
) -> Likeness:
    """Mean n-gram Jaccard index.  One of the indices reaches the threshold itself; sets that do
    share one of the least n - ceil(threshold n) + 1 n-grams of either, in any one order."""

    def prepare(s: Column) -> Column:
        return F.struct(s.alias("text"), *[text.ngrams(s, n).alias(f"g{n}") for n in sizes])

    def score(a: Column, b: Column) -> Column:
        mean = text.weighted_mean([text.jaccard(a[f"g{n}"], b[f"g{n}"]) for n in sizes], weights)
        return F.when(a["text"] == b["text"], F.lit(1.0)).otherwise(mean)

    def keys(s: Column) -> Column:
        def of(n: int) -> Column:
            hashed = F.array_sort(F.transform(text.ngrams(s, n), lambda g: F.xxhash64(F.lit(n), g)))
            count = F.size(hashed) - F.ceil(F.size(hashed) * threshold - EPSILON).cast("int") + 1
            return F.when(F.size(hashed) == 0, F.array(F.xxhash64(F.lit(n)))).otherwise(
                F.slice(hashed, F.lit(1), count)
            )

        return F.array_distinct(F.concat(*[of(n) for n in sizes]))

    return Likeness(prepare, score, keys, keys, symmetric=True)


def earliest_like(possible: DataFrame, lookers: DataFrame, like: Likeness, threshold: float) -> DataFrame:
    """(_norm, first, sure, score): the earliest of ``possible`` before each looker that is like it."""

    def exploded(df: DataFrame, zero: str, one: str) -> DataFrame:
        def sided(column: str, side: int) -> Column:
            return F.transform(F.array_distinct(column), lambda k: F.struct(F.lit(side).alias("side"), k.alias("key")))

        both = sided(zero, 0) if like.symmetric else F.concat(sided(zero, 0), sided(one, 1))
        return df.withColumn("_k", F.explode(both))

    left = exploded(possible, "_own", "_sought").select(
        F.col("_k.side").alias("side"), F.col("_k.key").alias("key"), F.col("_first").alias("_y"), "_sure",
        F.col("_made").alias("_other"),
    )
    right = exploded(lookers, "_sought", "_own").select(
        F.col("_k.side").alias("side"), F.col("_k.key").alias("key"), "_norm", F.col("_first").alias("_x"), "_made"
    )
    met = right.join(left, ["side", "key"]).where(F.col("_y") < F.col("_x"))
    scored = met.withColumn("_score", like.score(F.col("_other"), F.col("_made"))).where(F.col("_score") >= threshold)
    least = scored.groupBy("_norm").agg(F.min(F.struct("_y", "_sure", "_score")).alias("e"))
    return least.select("_norm", F.col("e._y").alias("first"), F.col("e._sure").alias("sure"), F.col("e._score").alias("score"))


_CARRIED = ("_norm", "_first", "_made", "_own", "_sought")


def _settle_wave(now: DataFrame, like: Likeness, threshold: float) -> DataFrame:
    """Every string of the wave with its ``leader`` and ``score``."""
    decided: list[DataFrame] = []
    leaders: list[DataFrame] = []
    while True:
        possible = reduce(DataFrame.unionByName, [now.withColumn("_sure", F.lit(False)), *leaders])
        found = earliest_like(possible, now, like, threshold)
        state = materialize(
            now.join(found, "_norm", "left").select(
                *_CARRIED,
                F.when(F.col("first").isNull(), F.col("_first")).when(F.col("sure"), F.col("first")).alias("leader"),
                F.when(F.col("first").isNull(), F.lit(1.0)).when(F.col("sure"), F.col("score")).alias("score"),
            ),
            "wave",
        )
        decided.append(state.where(F.col("leader").isNotNull()))
        leaders.append(
            state.where(F.col("leader") == F.col("_first")).select(*_CARRIED, F.lit(True).alias("_sure"))
        )
        now = state.where(F.col("leader").isNull()).select(*_CARRIED)
        if now.isEmpty():
            return reduce(DataFrame.unionByName, decided)


def group_by_leader(
    df: DataFrame,
    like: Likeness,
    threshold: float,
    column: str = "value",
    position: str = "position",
    normalize: bool = True,
    keep_duplicates: bool = False,
    wave: int = FIRST_WAVE,
) -> DataFrame:
    """Cluster strings by the first earlier leader that is similar enough.

    In order of ``position`` (numbers, each once) a string joins the first group whose leader reaches
    the threshold, or founds a group.  Returned with ``leader`` (the leader's position) and ``score``
    (similarity to the leader).  Exact; equal normal forms are one string however many copies exist.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed")
    items = df if keep_duplicates else unique_ci(df, column, position)
    norm = text.normalize_string(F.col(column)) if normalize else F.col(column)
    items = materialize(items.withColumn("_norm", norm), "strings")
    name = F.col("_norm")
    waiting = materialize(
        items.where(name.isNotNull())
        .groupBy("_norm")
        .agg(F.min(position).alias("_first"))
        .select("_norm", "_first", like.prepare(name).alias("_made"), like.own(name).alias("_own"), like.sought(name).alias("_sought")),
        "candidates",
    )
    placed: list[DataFrame] = []
    while (n := waiting.count()) > 0:
        now, rest = waiting, None
        if n > wave:
            last = waiting.agg(F.percentile_approx("_first", wave / n, 10_000).alias("last")).first()["last"]
            now, rest = waiting.where(F.col("_first") <= F.lit(last)), waiting.where(F.col("_first") > F.lit(last))
        settled = _settle_wave(now, like, threshold)
        placed.append(settled.select("_norm", "leader", "score"))
        if rest is None:
            break
        leaders = settled.where(F.col("leader") == F.col("_first")).withColumn("_sure", F.lit(True))
        found = earliest_like(leaders, rest, like, threshold).select("_norm", F.col("first").alias("leader"), "score")
        state = materialize(rest.join(found, "_norm", "left"), "settled")
        placed.append(state.where(F.col("leader").isNotNull()).select("_norm", "leader", "score"))
        waiting, wave = state.where(F.col("leader").isNull()).select(*_CARRIED), wave * GROWTH
    if not placed:
        shape = [*df.schema.fields, T.StructField("leader", df.schema[position].dataType), T.StructField("score", T.DoubleType())]
        return df.sparkSession.createDataFrame([], T.StructType(shape))
    return items.join(reduce(DataFrame.unionByName, placed), "_norm").select(*df.columns, "leader", "score")


def group_similar(df: DataFrame, threshold: float = EDIT_THRESHOLD, **options) -> DataFrame:
    """Leader clustering by edit similarity."""
    return group_by_leader(df, edit_likeness(threshold), threshold, **options)


def group_ngram(
    df: DataFrame,
    threshold: float = NGRAM_THRESHOLD,
    sizes: Sequence[int] = NGRAM_SIZES,
    weights: Sequence[float] | None = None,
    **options,
) -> DataFrame:
    """Leader clustering by n-gram similarity."""
    return group_by_leader(df, ngram_likeness(threshold, sizes, weights), threshold, **options)


def group_scores(grouped: DataFrame) -> DataFrame:
    """Size and mean similarity to the leader of each group."""
    return grouped.groupBy("leader").agg(
        F.count(F.lit(1)).alias("n_items"), F.avg("score").alias("score")
    )
