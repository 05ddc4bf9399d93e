"""Best matches against scores of all pairs, and how many blocks they score."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from scriptorium.functions.vectors import COMPLEMENTARITY_WEIGHTS, ENSEMBLE_WEIGHTS
from scriptorium.operators import matches, matching

LEVELS = ("domain", "field", "subfield", "topic", "keyword", "other")


def people(seed: int, n: int, fields: int, embedded: float = 0.4):
    """Unit TF-IDF profiles around a field each, some equal, and vectors for a share of them."""
    draw = random.Random(seed)
    profiles, vectors = {}, {}
    for i in range(n):
        f = draw.randrange(fields)
        own = {f"domain::{f % 3}", f"field::{f}", f"subfield::{f}.{draw.randrange(2)}", f"topic::{f}.{draw.randrange(6)}", f"topic::{draw.randrange(9)}"}
        if draw.random() < 0.3:
            own |= {f"field::{draw.randrange(fields)}", f"keyword::{draw.randrange(20)}", "other thing"}
        profiles[i] = {d: draw.choice([0.5, 1.0, draw.random()]) for d in sorted(own)}
        if i % 9 == 0 and i:
            profiles[i] = dict(profiles[i - 1])
        if draw.random() < embedded:
            v = np.array([draw.gauss(0, 1) for _ in range(4)]) + 3 * np.eye(4)[f % 4]
            vectors[i] = (v / np.sqrt(v @ v)).tolist()
    held = Counter(d for p in profiles.values() for d in p)
    for i, p in profiles.items():
        weights = {d: w * math.log(n / (held[d] + 1) + 1) for d, w in p.items()}
        size = sum(w * w for w in weights.values()) ** 0.5
        profiles[i] = {d: w / size for d, w in weights.items()}
    return profiles, vectors


def tables(spark, profiles, vectors):
    rows = [(i, d, w) for i, p in profiles.items() for d, w in p.items()]
    return (
        spark.createDataFrame(rows, "researcher_id int, dim string, weight double"),
        spark.createDataFrame(list(vectors.items()), "researcher_id int, vector array<double>"),
    )


def all_scores(profiles, vectors):
    """Scores of every two researchers, by dictionaries."""

    def product(p, q, level=None):
        same = [d for d in p if d in q and (level is None or d.split("::")[0] == level)]
        if level is None:
            return sum(p[d] * q[d] for d in same)
        size = [sum(w * w for d, w in x.items() if d.split("::")[0] == level) ** 0.5 for x in (p, q)]
        return sum(p[d] * q[d] for d in same) / (size[0] * size[1]) if same else 0.0

    found = {}
    for a, p in profiles.items():
        for b, q in profiles.items():
            tfidf = product(p, q)
            embedding = float(np.dot(vectors[a], vectors[b])) if a in vectors and b in vectors else 0.0
            context = sum(w * product(p, q, n) for n, w in COMPLEMENTARITY_WEIGHTS.items())
            found[a, b] = {
                "tfidf_sim": tfidf,
                "embedding_sim": embedding,
                "similarity": tfidf * ENSEMBLE_WEIGHTS["tfidf"] + embedding * ENSEMBLE_WEIGHTS["embedding"],
                "complementarity": context * (1 - product(p, q, "topic")),
            }
    return found


@pytest.mark.parametrize("by", matching.MATCH_SCORES)
def test_best_matches_are_exact(spark, by):
    profiles, vectors = people(3, 90, 7)
    profiles[90] = {"keyword::alone": 1.0}  # scores 0 with everyone
    scores = all_scores(profiles, vectors)
    want = {}
    for a in profiles:
        order = sorted((-round(scores[a, b][by], 9), b) for b in profiles if b != a)
        want[a] = [b for _, b in order[:6]]
    for block in (6, 1000):
        found = matching.best_matches(*tables(spark, profiles, vectors), 6, by, block=block).collect()
        got = {}
        for r in sorted(found, key=lambda r: (-round(r[by], 9), r.researcher_b)):
            got.setdefault(r.researcher_a, []).append(r.researcher_b)
            for name, value in scores[r.researcher_a, r.researcher_b].items():
                assert abs(r[name] - value) < 1e-9
        assert got == want


def scored(spark, monkeypatch, n: int, by: str) -> int:
    """Pairs of blocks scored for ``n`` researchers in a number of fields that grows with them."""
    seen = []
    inner = matches.score_blocks

    def counting(pairs, *rest):
        seen.append(pairs.where(f"q != {matches.FIRST_IDS}").count())
        return inner(pairs, *rest)

    monkeypatch.setattr(matches, "score_blocks", counting)
    matching.best_matches(*tables(spark, *people(5, n, n // 20, 1.0)), 3, by, block=20).count()
    monkeypatch.undo()
    return sum(seen)


@pytest.mark.parametrize("by", ["tfidf_sim", "complementarity"])
def test_scored_blocks_grow_slower_than_pairs(spark, monkeypatch, by):
    few, many = scored(spark, monkeypatch, 240, by), scored(spark, monkeypatch, 960, by)
    assert many < 10 * few  # all pairs of blocks would be 16 times as many


def test_blocks_are_sent_to_groups_not_to_every_block(spark, monkeypatch):
    """Where bounds leave out little, a block goes to the few groups of blocks in two rounds."""
    met, sent = [], []
    inner = matches.score_blocks

    def counting(pairs, *rest):
        met.append(pairs.where(f"q != {matches.FIRST_IDS}").count())
        sent.append(sum(pairs.select("g", "h", side).distinct().count() for side in "pq"))
        return inner(pairs, *rest)

    monkeypatch.setattr(matches, "score_blocks", counting)
    matching.best_matches(*tables(spark, *people(5, 400, 1, 0.0)), 3, block=5).count()
    blocks = met[0]
    assert blocks >= 40 and sum(met) > blocks * blocks / 2
    assert sum(sent) < blocks * (4 + 4 * matches.GROUPS) and sum(sent) < sum(met)


def test_only_what_reaches_the_floor_is_sorted(monkeypatch):
    draw = np.random.default_rng(4)
    ranks = np.round(draw.random((40, 60)), 2)  # many ties
    ranks[3, 5] = np.nan
    ids, partners = np.arange(40), np.sort(np.append(np.arange(57), [5, 5, 9]))  # some partners come twice
    floor = np.where(np.arange(40) % 3 == 0, -np.inf, draw.random(40))
    floor[1], floor[2] = 0.999, 2.0
    want = []
    for a in range(40):
        order = sorted((-ranks[a, j], j) for j, b in enumerate(partners) if b != a and not np.isnan(ranks[a, j]))
        want += [(a, j, -r) for r, j in order if -r >= floor[a] - 1e-9][:7]
    sizes, inner = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or inner(keys))
    row, column, rank = matches.best_places(ranks.copy(), ids, partners, floor, 7, 9, 1e-8)
    monkeypatch.undo()
    assert list(zip(row.tolist(), column.tolist(), rank.tolist(), strict=True)) == want
    assert sizes[0] < ranks.size / 2
    names = [np.array([f"{x:02}" for x in some], dtype=object) for some in (ids, partners)]
    again = matches.best_places(ranks.copy(), *names, floor, 7, 9, 1e-8)
    assert np.array_equal(again[1], column)
