"""The best partners of every researcher by profile and embedding scores, with score bounds.

Exact over all pairs, without scoring all of them.  Researchers with the same leading labels share
a block.  A block's largest weight per dimension, its largest norm per level and the ball around its
vectors bound every score that a pair of blocks can hold.  Each researcher first finds partners in
its own block; after that a block meets another only while someone in it has a bound, against that
block, that reaches the k-th best score found so far.  The blocks with the highest bounds come first,
then the bounds are held to the better scores again.  Pairs of researchers are never rows: a task
scores a group of blocks against another and returns k rows a researcher.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scriptorium.functions import vectors
from scriptorium.operators import windows
from scriptorium.operators.neighbours import LEVELS, best_places
from scriptorium.session import materialize

# ---- fixed values --------------------------------------------------------------------
SEARCH_LIMIT = 20
MATCH_SCORES = ("tfidf_sim", "embedding_sim", "similarity", "complementarity")
# -------------------------------------------------------------------------------------

#: Levels a dimension may be of; the last holds all others.
WIDTH = len(LEVELS) + 1
#: Block number of the smallest ids, which every block meets.
FIRST_IDS = -1
#: Researchers of a block, about; a task scores one block against another.
MATCH_BLOCK = 1_024
#: Blocks whose members are held to the bounds of so many blocks in one task.
BOUND_GROUP, BOUND_CHUNK = 8, 512
#: Blocks that a block meets in the first round after its own; four times as many in each next.
FIRST_ROUND = 4
#: Groups of blocks that meet, if there are as many blocks, and the numbers one holds, about.  A
#: block is sent once to every group that it meets, not once to every block.
GROUPS, GROUP_NUMBERS = 8, 5_000_000
#: Profiles that fill so small a matrix are kept as one, as a multiple of their numbers; numbers that
#: are gathered for pairs at a time.
FULL_SHARE, GATHERED = 2, 1 << 20
#: Scores are compared at this precision so that equal ones tie exactly.
SCORE_DIGITS = 9
#: What rounding may add to a bound, and what rounds to a score of zero.
SLACK, ZERO = 1e-8, 4e-10


class Rows:
    """Profiles and embeddings of some researchers as flat arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.n = len(pdf)
        lengths = [len(d) for d in pdf["dims"]]
        self.row = np.repeat(np.arange(self.n), lengths)
        self.dim, self.level, self.weight = (
            np.concatenate([np.asarray(x, dtype=kind) for x in pdf[c]]) if sum(lengths) else np.zeros(0, kind)
            for c, kind in (("dims", np.int64), ("levels", np.int64), ("weights", np.float64))
        )
        cell = self.row * WIDTH + self.level
        self.norms = np.sqrt(np.bincount(cell, self.weight**2, self.n * WIDTH)).reshape(self.n, WIDTH)
        self.known, first = np.unique(self.dim, return_index=True)
        self.known_level = self.level[first]
        size = self.norms.ravel()[cell]
        self.unit = np.divide(self.weight, size, out=np.zeros_like(size), where=size > 0)
        self.has = pdf["vector"].notna().to_numpy()
        found = [v for v in pdf["vector"] if v is not None]
        self.vector = np.zeros((self.n, len(found[0]) if found else 0))
        if found:
            self.vector[self.has] = np.stack(found)

    def dense(self, dims: np.ndarray, kind: str) -> np.ndarray:
        """The values ``kind`` as a matrix over the sorted ``dims``."""
        full = self.__dict__.setdefault("_full", {})
        if self.n * len(self.known) <= FULL_SHARE * len(self.dim):
            if kind not in full:
                full[kind] = self._filled(self.known, kind)
            if np.isin(dims, self.known, assume_unique=True).all():
                return full[kind][:, np.searchsorted(self.known, dims)]
        return self._filled(dims, kind)

    def _filled(self, dims: np.ndarray, kind: str) -> np.ndarray:
        at = np.searchsorted(dims, self.dim)
        at[at == len(dims)] = 0
        held = dims[at] == self.dim if len(dims) else np.zeros(len(at), bool)
        out = np.zeros((self.n, len(dims)))
        out[self.row[held], at[held]] = getattr(self, kind)[held]
        return out

    def levels_of(self, dims: np.ndarray) -> np.ndarray:
        return self.known_level[np.searchsorted(self.known, dims)]


class Tops(Rows):
    """Block summaries as rows of their largest values."""

    def __init__(self, pdf: pd.DataFrame):
        self.n = len(pdf)
        lengths = [len(d) for d in pdf["dims"]]
        self.row = np.repeat(np.arange(self.n), lengths)
        self.dim, self.level, self.weight, self.unit = (
            np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("dims", "levels", "weights", "units")
        )
        self.known = np.unique(self.dim)
        self.norms = np.stack(pdf["norms"].to_numpy())
        self.block, self.plain = pdf["block"].to_numpy(), pdf["plain"].to_numpy().astype(bool)
        size = max(len(c) for c in pdf["centre"])
        self.centre = np.array([np.resize(c, size) if len(c) else np.zeros(size) for c in pdf["centre"]]).reshape(self.n, size)
        self.radius = pdf["radius"].to_numpy()


class Scores:
    """How scores are made of levels and embeddings, and how large they can become."""

    def __init__(self, by: str, keywords: bool, weights: dict[str, float] | None):
        if by not in MATCH_SCORES:
            raise ValueError(f"matches are ranked by one of {MATCH_SCORES}")
        self.by = by
        named = vectors.COMPLEMENTARITY_WEIGHTS_KEYWORDS if keywords else vectors.COMPLEMENTARITY_WEIGHTS
        self.context = {LEVELS.index(n): w for n, w in named.items()}
        self.topic = LEVELS.index("topic")
        self.mean = weights or vectors.ENSEMBLE_WEIGHTS
        if min(self.mean.values()) < 0:
            raise ValueError("weights of a mean are not negative")
        #: Share of the TF-IDF and of the embedding cosine in the score ranked by.
        self.shares = {
            "tfidf_sim": (1.0, 0.0),
            "embedding_sim": (0.0, 1.0),
            "similarity": (self.mean["tfidf"], self.mean["embedding"]),
            "complementarity": (0.0, 0.0),
        }[by]

    def ranked(self, one: Rows, two: Rows, rows: np.ndarray) -> np.ndarray:
        """The score ranked by, of the chosen rows of ``one`` with ``two``."""
        if self.by == "complementarity":
            shared = np.intersect1d(one.known, two.known, assume_unique=True)
            level = one.levels_of(shared)
            x, y = one.dense(shared, "unit")[rows], two.dense(shared, "unit")
            share, topic = self.shares_of(level), level == self.topic
            out = x[:, topic] @ y[:, topic].T
            np.subtract(1.0, out, out=out)
            out *= (x * share)[:, share > 0] @ y[:, share > 0].T
            return out
        out = np.zeros((len(rows), two.n))
        if self.shares[0]:
            shared = np.intersect1d(one.known, two.known, assume_unique=True)
            out = (one.dense(shared, "weight")[rows] * self.shares[0]) @ two.dense(shared, "weight").T
        if self.shares[1] and one.vector.size and two.vector.size:
            out += (one.vector[rows] * self.shares[1]) @ two.vector.T
        return out

    def shares_of(self, level: np.ndarray) -> np.ndarray:
        return np.array([self.context.get(n, 0.0) for n in range(WIDTH)])[level]

    def values(self, one: Rows, two: Rows, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """All scores of rows ``i`` of ``one``, each with its row ``j`` of ``two``."""
        shared = np.intersect1d(one.known, two.known, assume_unique=True)
        level = one.levels_of(shared)
        share, topic = self.shares_of(level), (level == self.topic).astype(float)
        x, y, xu, yu = (m.dense(shared, kind) for kind in ("weight", "unit") for m in (one, two))
        tfidf, embedding, context, same = np.zeros((4, len(i)))
        step = max(1, GATHERED // max(1, len(shared), one.vector.shape[1]))
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            a, b = i[part], j[part]
            tfidf[part] = np.einsum("ij,ij->i", x[a], y[b])
            both = xu[a] * yu[b]
            context[part], same[part] = both @ share, both @ topic
            if one.vector.size and two.vector.size:
                embedding[part] = np.einsum("ij,ij->i", one.vector[a], two.vector[b])
        mean = tfidf * self.mean["tfidf"] + embedding * self.mean["embedding"]
        return [tfidf, embedding, mean, context * (1 - same)]

    def bounds(self, units: dict[int, np.ndarray], weights: dict[int, np.ndarray], embedding, signs: np.ndarray) -> np.ndarray:
        """Upper bounds of the score from bounds per level of the unit and weighted products.

        ``signs`` tells where no weight is negative, so that no topic cosine is.
        """
        if self.by == "complementarity":
            context = sum(np.minimum(units[n], 1.0) * w for n, w in self.context.items())
            return context * np.where(signs, 1.0, 2.0)
        tfidf, other = self.shares
        return tfidf * sum(weights.values()) + other * embedding

    def reach(self, one: Rows, floor: np.ndarray, tops: Tops) -> tuple[np.ndarray, np.ndarray]:
        """The largest score each row of ``one`` can have in each block of ``tops``, and whether it
        reaches the row's ``floor``.  What rounds to 0 does not reach a floor of 0 where no score is
        negative, since the smallest ids with that score are known."""
        shared = np.intersect1d(one.known, tops.known, assume_unique=True)
        level = one.levels_of(shared)
        units, weights = {}, {}
        for n in range(WIDTH):
            at = shared[level == n]
            units[n] = np.abs(one.dense(at, "unit")) @ tops.dense(at, "unit").T
            product = np.abs(one.dense(at, "weight")) @ tops.dense(at, "weight").T
            weights[n] = np.minimum(product, np.outer(one.norms[:, n], tops.norms[:, n]))
        embedding = np.zeros((one.n, tops.n))
        if self.shares[1] and one.vector.size and tops.centre.size:
            size = np.sqrt((one.vector**2).sum(axis=1))
            embedding = one.vector @ tops.centre.T + np.outer(size, tops.radius)
        plain = tops.plain & (one.weight >= 0).all()
        bound = self.bounds(units, weights, embedding, plain[None, :])
        sure = plain[None, :] & (~one.has[:, None] if self.shares[1] else True)
        known = sure & (floor[:, None] >= -ZERO) & (bound < ZERO)
        return bound, (bound >= floor[:, None] - SLACK) & ~known


def _people(profiles: DataFrame, embeddings: DataFrame, key: str, block: int) -> DataFrame:
    """A row per researcher: flat profile, vector and block.

    A block holds researchers of the same leading topic, of neighbouring ones where these are few,
    and a share of them where they are more than ``block``.
    """
    profiles = materialize(profiles.select(F.col(key).alias("id"), "dim", "weight"), "match-profiles")
    names = F.array(*map(F.lit, LEVELS))
    tops = [f"top{i}" for i in range(LEVELS.index("topic") + 1)]
    dims = materialize(
        profiles.groupBy("dim").agg(F.count(F.lit(1)).alias("held")).select("dim", F.monotonically_increasing_id().alias("d")),
        "match-dims",
    )
    place = F.array_position(names, F.substring_index("dim", "::", 1)).cast("int")
    level = F.when(place > 0, place - 1).otherwise(len(LEVELS))
    flat = profiles.join(dims, "dim").select("id", "d", level.alias("level"), "weight")
    people = flat.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("d", "level", "weight"))).alias("rows"),
        *[
            F.coalesce(F.max(F.when(F.col("level") == i, F.struct("weight", "d")))["d"], F.lit(-1)).alias(top)
            for i, top in enumerate(tops)
        ],
    )
    sizes = people.groupBy(*tops).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(tops[0]).orderBy(*tops[1:]).rowsBetween(Window.unboundedPreceding, -1)
    slots = sizes.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)).cast("long")
    return materialize(
        people.join(slots, tops)
        .join(embeddings.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("vector")), "id", "left")
        .select(
            "id",
            F.xxhash64(tops[0], F.floor(F.col("first") / block) + part).alias("block"),
            F.col("rows.d").alias("dims"),
            F.col("rows.level").alias("levels"),
            F.col("rows.weight").alias("weights"),
            "vector",
        ),
        "match-people",
    )


_SUMMARY = (
    "block long, dims array<long>, levels array<int>, weights array<double>, units array<double>, norms array<double>, "
    "plain boolean, centre array<double>, radius double"
)


def _summaries(people: DataFrame) -> DataFrame:
    """A row per block with what bounds its scores."""

    return materialize(people.groupBy("block").applyInPandas(_summary, _SUMMARY), "match-blocks")


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = Rows(pdf)
    dims, first, at = np.unique(rows.dim, return_index=True, return_inverse=True)
    tops = []
    for values in (rows.weight, rows.unit):
        top = np.zeros(len(dims))
        np.maximum.at(top, at, np.abs(values))
        tops.append(top)
    # A ball that holds all vectors; a missing one is at the origin.
    centre = rows.vector.mean(axis=0)
    radius = float(np.sqrt(((rows.vector - centre) ** 2).sum(axis=1).max(initial=0)))
    plain = bool((rows.weight >= 0).all())
    return pd.DataFrame(
        [(pdf["block"].iloc[0], dims, rows.level[first], *tops, rows.norms.max(axis=0), plain, centre, radius)],
        columns=[c.split()[0] for c in _SUMMARY.split(", ")],
    )


def block_bounds(people: DataFrame, summaries: DataFrame, score: Scores) -> DataFrame:
    """(p, q, bound): blocks q != p in which someone of block p can reach their ``floor``, with the
    largest score that one of those can have there.

    Members of a few blocks meet the summaries of many, so that what grows with the square is one
    number for a researcher and a block.
    """
    blocks = summaries.count()
    groups, chunks = max(1, -(-blocks // BOUND_GROUP)), max(1, -(-blocks // BOUND_CHUNK))

    def dealt(column: str, parts: int):
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    def every(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = people.withColumn("g", dealt("block", groups)).withColumn("c", every(chunks))
    right = summaries.withColumn("c", dealt("block", chunks)).withColumn("g", every(groups))

    def bound(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"p": [], "q": [], "bound": []})]
        tops = Tops(two) if len(two) else None
        for p, members in one.groupby("block") if tops else ():
            most, reached = score.reach(Rows(members), _floor(members), tops)
            reached &= tops.block[None, :] != p
            best = np.where(reached, most, -np.inf).max(axis=0)
            at = np.flatnonzero(best > -np.inf)
            out.append(pd.DataFrame({"p": np.full(len(at), p), "q": tops.block[at], "bound": best[at]}))
        return pd.concat([x for x in out if len(x)] or out)

    pairs = left.groupBy("g", "c").cogroup(right.groupBy("g", "c"))
    return pairs.applyInPandas(bound, "p long, q long, bound double")


def _floor(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["floor"].to_numpy(dtype=float, na_value=-np.inf)


def _dealt(column: str, parts: int):
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("long")


def score_blocks(
    pairs: DataFrame, people: DataFrame, others: DataFrame, score: Scores, k: int
) -> DataFrame:
    """The ``k`` best partners of every researcher of block p in the blocks q, for the rows
    (g, h, p, q, bound) of ``pairs``: a task scores what one (g, h) names, highest bounds first.

    ``people`` has ``floor``, the k-th best score so far (null where there is none); it rises with
    what the task finds.  Rows that cannot reach it are left out before anything is scored."""
    id_type = dict(people.dtypes)["id"]
    fields = f"researcher_a {id_type}, researcher_b {id_type}, " + ", ".join(f"{n} double" for n in MATCH_SCORES)
    columns = ["id", "dims", "levels", "weights", "vector"]
    turns = pairs.groupBy("g", "h", "p").agg(F.sort_array(F.collect_list(F.struct((-F.col("bound")).alias("last"), "q"))).alias("turns"))
    left = turns.join(people, turns["p"] == people["block"]).select(
        "g", "h", "p", F.col("turns.q").alias("qs"), "floor", *columns
    )
    # Columns of their own, or the two sides of the cogroup would be taken for one.
    wanted = pairs.select(*[F.col(c).alias(f"{c}2") for c in ("g", "h", "q")]).distinct()
    right = wanted.join(others, F.col("q2") == others["block"])
    right = right.select(*[F.col(f"{c}2").alias(c) for c in ("g", "h", "q")], *[F.col(c).alias(c) for c in columns])

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in fields.split(", ")})]
        met = {}
        for q, block in two.groupby("q"):
            block = block.sort_values("id", kind="stable")
            met[q] = block["id"].to_numpy(), Rows(block), Tops(_summary(block.assign(block=q)))
        for _, block in one.groupby("p"):
            x, floor, ids = Rows(block), _floor(block), block["id"].to_numpy()
            tops, found = np.full((x.n, k), -np.inf), []
            for q in block["qs"].iloc[0]:
                if q not in met:
                    continue
                partners, y, top = met[q]
                rows = np.flatnonzero(score.reach(x, floor, top)[1][:, 0])
                if not len(rows):
                    continue
                ranks = score.ranked(x, y, rows)
                i, j, rank = best_places(ranks, ids[rows], partners, floor[rows], k, SCORE_DIGITS, SLACK)
                if not len(i):
                    continue
                # The k best so far of the rows that found some.
                some, row = np.unique(i, return_inverse=True)
                held = np.full((len(some), k), -np.inf)
                held[row, np.arange(len(i)) - np.searchsorted(i, some)[row]] = rank
                tops[rows[some]] = np.sort(np.hstack([tops[rows[some]], held]), axis=1)[:, -k:]
                floor = np.maximum(floor, tops[:, 0])
                keep = rank >= np.round(floor[rows], SCORE_DIGITS)[i]
                i, j, rank = rows[i[keep]], j[keep], rank[keep]
                found.append((i, partners[j], rank, *score.values(x, y, i, j)))
            if found:
                row, partner, rank, *values = map(np.concatenate, zip(*found, strict=True))
                keep = rank >= np.round(floor[row], SCORE_DIGITS)
                out.append(
                    pd.DataFrame(
                        {"researcher_a": ids[row[keep]], "researcher_b": partner[keep]}
                        | {n: v[keep] for n, v in zip(MATCH_SCORES, values, strict=True)}
                    )
                )
        return pd.concat([x for x in out if len(x)] or out)

    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(best, fields)


def _best_of(found: Sequence[DataFrame], score: Scores, k: int) -> DataFrame:
    """The ``k`` best of partial results."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    ranked = rows.withColumn("_rank", F.round(score.by, SCORE_DIGITS))
    order = [F.desc("_rank"), F.asc("researcher_b")]
    return windows.top_per_group(ranked, ["researcher_a"], order, k).drop("_rank", "rank")


def best_matches(
    profiles: DataFrame,
    embeddings: DataFrame,
    k: int = SEARCH_LIMIT,
    by: str = "complementarity",
    keywords: bool = False,
    weights: dict[str, float] | None = None,
    key: str = "researcher_id",
    block: int = MATCH_BLOCK,
) -> DataFrame:
    """The ``k`` best partners of every researcher among all others, with their scores.

    Exact over all pairs: no minimum, since the most complementary researchers are not the
    most similar ones.  ``embeddings``: key, ``vector``; a missing one scores 0.  Similarity is the
    weighted mean of the TF-IDF and embedding products; complementarity rewards shared context
    with distant topics.  Ties go to the smaller id: those of score 0 are found because everyone also
    meets the 2 k + 1 smallest ids.
    """
    score = Scores(by, keywords, weights)
    people = _people(profiles, embeddings, key, block)
    # As partners the smallest ids are a block of their own, so that no pair is scored twice.
    last = people.orderBy("id").limit(2 * k + 1).agg(F.max("id").alias("id")).first()["id"]
    others = people.withColumn("block", F.when(F.col("id") <= F.lit(last), F.lit(FIRST_IDS)).otherwise(F.col("block")))
    unbound = people.withColumn("floor", F.lit(None).cast("double"))
    own = materialize(people.select(F.col("block").alias("p"), F.col("block").alias("q")).distinct(), "match-own")
    # A block meets the smallest ids and itself in one task; those first, since a floor of 0 counts on them.
    first = own.select("p", F.lit(FIRST_IDS).cast("long").alias("q"), F.lit(1.0).alias("bound"))
    starts = own.withColumn("bound", F.lit(0.0)).unionByName(first).select(
        F.col("p").alias("g"), F.lit(0).cast("long").alias("h"), "p", "q", "bound"
    )
    found = materialize(_best_of([score_blocks(starts, unbound, others, score, k)], score, k), "match-found")
    blocks = own.count()
    if blocks < 2:
        return found
    numbers = people.agg(F.sum(F.size("dims") + F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)))).first()[0]
    groups = max(min(blocks, GROUPS), -(-numbers // GROUP_NUMBERS))
    summaries, done, width, met = _summaries(people), own, FIRST_ROUND, blocks
    while True:
        floors = (
            found.groupBy(F.col("researcher_a").alias("id"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.round(score.by, SCORE_DIGITS)).alias("floor"))
            .where(F.col("n") >= k)
            .select("id", "floor")
        )
        bounded = people.join(floors, "id", "left")
        open_pairs = materialize(block_bounds(bounded, summaries, score).join(done, ["p", "q"], "left_anti"), "match-open")
        left = open_pairs.count()
        if not left:
            return found
        if width > FIRST_ROUND and 2 * left > blocks * blocks - met:
            # Bounds leave out little here: more rounds would only send the blocks again.
            width = blocks
        order = Window.partitionBy("p").orderBy(F.desc("bound"), "q")
        turn = materialize(
            open_pairs.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= width)
            .select(_dealt("p", groups).alias("g"), _dealt("q", groups).alias("h"), "p", "q", "bound"),
            "match-turn",
        )
        found = materialize(_best_of([found, score_blocks(turn, bounded, others, score, k)], score, k), "match-found")
        taken = turn.count()
        if taken == left:
            return found
        done, width, met = done.unionByName(turn.select("p", "q")), 4 * width, met + taken


def top_overall(matches: DataFrame, n: int = SEARCH_LIMIT, by: str = "complementarity") -> DataFrame:
    """The ``n`` best pairs (a < b) of a match table that holds n or more partners a researcher."""
    once = matches.where("researcher_a < researcher_b")
    return windows.top_matches(
        once.withColumn("_rank", F.round(by, SCORE_DIGITS)), "_rank", n, ["researcher_a", "researcher_b"]
    ).drop("_rank")
