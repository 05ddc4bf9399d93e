"""Open sets of the n-gram join: links by cells, rows that follow the sets, not their pairs."""

from __future__ import annotations

import random

import pytest

from scriptorium.llm import components, ngram_join
from tests.llm import fixtures as fx


def family(n: int) -> list[tuple[int, str]]:
    """Copies of one text, each with some words of its own: many link with others, not with all."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(n):
        words = list(base)
        for _ in range(draw.randrange(0, 6)):
            words[draw.randrange(80)] = f"own{draw.randrange(6)}"
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("slice_bytes", [8 << 20, 4000])
def test_open_sets_are_joined_exactly(spark, slice_bytes, monkeypatch):
    docs = family(160)
    counted = []
    stored = ngram_join.stored

    def watched(df, label):
        out = stored(df, label)
        counted.append((label, out.count()))
        return out

    def pairs(members, percent):
        out = components.open_pairs(members, percent)
        watched.pairs = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", watched)
    monkeypatch.setattr(ngram_join, "open_pairs", pairs)
    sets = {d: fx.ngrams(t, 4) for d, t in docs}
    union = fx.linked(sets, 85)
    found = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), slice_bytes=slice_bytes)
    assert {r.doc_id: r.component_id for r in found.collect()} == {d: union.root(d) for d in sets}
    counts = dict(counted)
    assert 0 < counts["open"] <= counts["led"] and counts["rest"] <= counts["open"]
    assert watched.pairs <= components.FEW * counts["open"]
