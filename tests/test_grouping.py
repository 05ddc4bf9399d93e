"""Leader clustering against plain loops, and the number of its jobs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import grouping, matching


def edit(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
    return 1.0 if a == b else 1 - row[-1] / max(len(a), len(b))


def ngram(weights):
    def score(a: str, b: str) -> float:
        total = 0.0
        for n, w in zip((2, 3), weights):
            x, y = ({s[i : i + n] for i in range(len(s) - n + 1)} for s in (a, b))
            total += w * (len(x & y) / len(x | y) if x | y else 1.0)
        return 1.0 if a == b else total

    return score


def expected(spark, df, score, threshold):
    """Leader and score of each string in order, over the first spelling of each."""
    seen, items = set(), []
    for r in sorted(df.select("position", "value", text.normalize_string(F.col("value")).alias("n")).collect()):
        if r.value.lower() not in seen:
            seen.add(r.value.lower())
            items.append((r.position, r.n))
    leaders, out = [], {}
    for at, norm in items:
        for where, other in leaders:
            if (s := score(other, norm)) >= threshold:
                out[at] = (where, round(s, 9))
                break
        else:
            leaders.append((at, norm))
            out[at] = (at, 1.0)
    return out


def strings(seed: int, n: int, families: int) -> list[str]:
    """Variants of some strings, short and long, with letters changed, added and taken out."""
    draw = random.Random(seed)
    bases = ["".join(draw.choices("abcdé ", k=draw.choice([1, 2, 4, 7, 12, 20]))) for _ in range(families)]
    values = ["", "Tokamák", "tokamak!", "TOKAMAK"]
    while len(values) < n:
        s = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            at = draw.randrange(len(s) + 1)
            s[at : at + draw.randrange(2)] = draw.choice(["", "a", "x", "É"])
        values.append("".join(s))
    return values


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_edit_clustering_is_exact(spark, threshold):
    df = spark.createDataFrame(list(enumerate(strings(5, 220, 14))), "position bigint, value string").repartition(3)
    for wave in (25, 2048):
        found = {r.position: (r.leader, round(r.score, 9)) for r in matching.group_similar(df, threshold, wave=wave).collect()}
        assert found == expected(spark, df, edit, threshold)


@pytest.mark.parametrize("weights", [None, [3.0, 1.0]])
def test_ngram_clustering_is_exact(spark, weights):
    df = spark.createDataFrame(list(enumerate(strings(6, 220, 14))), "position bigint, value string")
    share = [w / 4 for w in weights] if weights else [0.5, 0.5]
    for wave in (25, 2048):
        found = {r.position: (r.leader, round(r.score, 9)) for r in matching.group_ngram(df, 0.5, weights=weights, wave=wave).collect()}
        assert found == expected(spark, df, ngram(share), 0.5)


def test_keys_lose_no_like_string(spark):
    """Every two strings at a threshold share a key, over all pairs of short strings."""
    draw = random.Random(2)
    values = sorted({"".join(draw.choices("ab", k=draw.randrange(0, 8))) for _ in range(300)})
    for threshold in (0.4, 0.75):
        for like, score in ((grouping.edit_likeness(threshold), edit), (grouping.ngram_likeness(threshold), ngram([0.5, 0.5]))):
            df = spark.createDataFrame([(v,) for v in values], "s string")
            rows = {r.s: (set(r.own), set(r.sought)) for r in df.select("s", like.own(F.col("s")).alias("own"), like.sought(F.col("s")).alias("sought")).collect()}
            for a in values:
                for b in values:
                    if a < b and score(a, b) >= threshold:
                        assert rows[a][0] & rows[b][1] or rows[a][1] & rows[b][0], (a, b)


def test_jobs_do_not_follow_leaders(spark, monkeypatch):
    """Ten times the leaders: the searches grow with waves and rounds only."""
    counts = []
    for n in (40, 400):
        seen = []
        inner = grouping.earliest_like
        monkeypatch.setattr(grouping, "earliest_like", lambda *a, i=inner: seen.append(1) or i(*a))
        draw = random.Random(n)
        values = ["".join(draw.choices("abcdefghijklmnop", k=14)) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(values)), "position bigint, value string")
        found = matching.group_similar(df, wave=100).collect()
        monkeypatch.undo()
        assert len({r.leader for r in found}) > 0.9 * n
        counts.append(len(seen))
    assert counts[1] <= counts[0] + 4


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "A"), (4, "")], "position bigint, value string")
    assert {(r.position, r.leader) for r in matching.group_similar(df).collect()} == {(2, 2), (4, 4)}
    assert {(r.position, r.leader) for r in matching.group_similar(df, keep_duplicates=True).collect()} == {(2, 2), (3, 2), (4, 4)}
    assert matching.group_similar(df.limit(0)).columns == ["position", "value", "leader", "score"]
    with pytest.raises(ValueError):
        matching.group_similar(df, 0.0)
