"""Connected components by distributed union-find (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import drop_stored, stored

#: Members outside a signature's most common component whose pairs may be rows.
FEW = 16


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``links``.

    Each round hooks the larger neighbours of every node to its least one, then the smaller
    ones, until the links are stars; the number of rounds grows with the logarithm of the
    longest chain.  Least neighbours are aggregated before the shuffle, so a node with very
    many links costs one row a task; the joins can be split.  Rounds are tables in the shared
    folder, dropped when the next one stands.  Links with a null end are ignored; no links
    give no rows.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges, mark = stored(pairs.distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # The row of ``u`` itself is in ``low`` once, not once for every neighbour.
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        ).where("u != v").distinct()
        following = stored(small, "links")
        drop_stored(edges)
        edges = following
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def with_leaders(members: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` (``keys``, ``node``, ``weight``) of the keys that two nodes share, with ``lead``: the
    node of the key with the greatest weight, the greater id of equals.

    A good leader is near to many members, which then need no further look: of copies with
    small changes, the one that most others were made from.
    """
    top = members.groupBy(*keys).agg(
        F.max(F.struct("weight", "node"))["node"].alias("lead"), F.min("node").alias("_least"), F.max("node").alias("_most")
    )
    return members.join(top.where("_least < _most").drop("_least", "_most"), keys).drop("weight")


def unresolved_members(led: DataFrame, checked: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Members of the signatures (``tier``, ``key``) whose sets are not yet in one component, where
    the triangle inequality leaves a pair open: ``node``, ``component``, ``size``, ``far``, ``step``,
    ``outer`` (not of the most common component) and ``crowded`` (more than ``FEW`` are outer).

    ``far`` is the distance to the leader; sets whose distances differ by more than that of linked
    sets can't link.  In steps of this distance, a member of the signature's most common component
    comes only if one of the others is in its step or next to it.  Rows are members, not pairs.  ``led``:
    ``tier``, ``key``, ``node``, ``lead``; ``checked``: the verified pairs of a node ``x`` and its
    leader ``y`` with ``common``, ``nx`` and ``ny``.
    """
    far = checked.select(
        F.col("x").alias("node"), F.col("y").alias("lead"),
        (1 - F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))).alias("far"), F.col("nx").alias("size"),
    )
    placed = led.join(found.select("node", "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    counts = placed.groupBy("tier", "key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("tier", "key").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n")
    )
    # The two members of a signature of two were verified.
    open_ = main.where("parts > 1 and n > 2").select("tier", "key", "main")
    # The leader itself was verified against all; it takes part in no pair.
    members = (
        placed.where("node != lead")
        .join(open_, ["tier", "key"])
        .join(far, ["node", "lead"])
        .withColumn("step", F.floor(F.col("far") / F.lit(reach(percent))))
    )
    near = members.where("component != main").select(
        "tier", "key", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step")
    )
    outer = members.groupBy("tier", "key").agg((F.count_if(F.expr("component != main")) > FEW).alias("crowded"))
    return members.join(near.distinct(), ["tier", "key", "step"], "left_semi").join(outer, ["tier", "key"]).select(
        "tier", "key", "node", "component", "size", "far", "step", F.expr("component != main").alias("outer"), "crowded"
    )


def open_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Open pairs (``x`` > ``y``) of the signatures that are not crowded: at most ``FEW`` a member and signature."""
    few = members.where("not crowded")
    left = few.where("outer").select(
        "tier", "key", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("far").alias("fx"), F.col("size").alias("sx"),
        F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"),
    )
    right = few.select(
        "tier", "key", "step", "outer", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("far").alias("fy"), F.col("size").alias("sy")
    )
    return (
        left.join(right, ["tier", "key", "step"])
        .where("cx != cy and (not outer or x > y)")
        .where(F.abs(F.col("fx") - F.col("fy")) <= reach(percent))
        .where(F.expr(f"100 * least(sx, sy) >= {percent} * greatest(sx, sy)"))
        .select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        .distinct()
    )


def reach(percent: int) -> float:
    """The largest Jaccard distance of linked sets."""
    return 1 - percent / 100 + 1e-9
