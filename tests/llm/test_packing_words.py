"""op9: seeds ask with all their words."""

from __future__ import annotations

from collections import Counter

import numpy as np

from scriptorium.llm import packing


def test_seeds_ask_with_all_their_words():
    draw = np.random.default_rng(4)
    arrays = [draw.zipf(1.3, draw.integers(20, 900)).clip(max=4000).astype("<u4") for _ in range(120)]
    counts = [Counter(a.tolist()) for a in arrays]
    docs = Counter(t for c in counts for t in c)
    idf = np.zeros(4001, np.float32)
    for t, n in docs.items():
        idf[t] = np.log1p((120 - n + 0.5) / (n + 0.5))
    mean = sum(map(len, arrays)) / 120

    def score(query: int, d: int) -> float:
        norm = packing.K1 * (1 - packing.B + packing.B * len(arrays[d]) / mean)
        return sum(float(idf[t]) * counts[d][t] * (packing.K1 + 1) / (counts[d][t] + norm) for t in counts[query])

    index = packing.ShardIndex(arrays, idf, mean)
    used = np.zeros(120, bool)
    for query in range(0, 120, 7):
        plain = {d: score(query, d) for d in range(120) if not used[d] and counts[d].keys() & counts[query].keys()}
        found = index.neighbours(arrays[query]).tolist()
        assert set(found) == set(plain)
        assert np.allclose([plain[d] for d in found], sorted(plain.values(), reverse=True), rtol=1e-5)
        if query % 14:  # what is used leaves the index, and the rest is ranked as before
            used[draw.integers(0, 120, 10)] = True
            index.forget(used)
