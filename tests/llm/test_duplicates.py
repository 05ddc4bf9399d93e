"""Components, n-gram join, line dedup and the pipeline against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from scriptorium.llm import catalog, components, line_dedup, ngram_join
from tests.llm import fixtures as fx
from tests.llm.test_full_lines import full


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    union = fx.Union({x for pair in links for x in pair})
    for a, b in links:
        union.join(a, b)
    found = {r.node: r.component for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert found == {x: union.root(x) for a, b in links for x in (a, b) if a != b}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op10_whole_table(spark):
    sets = {d: fx.ngrams(t, 4) for d, t, _ in fx.documents(spark)}
    union = fx.linked(sets, 85)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.QUERIES["op10_ngram_join"](spark, fx.SF).collect()}
    assert rows == {d: (len(s), union.root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("frequent", "words", "percent"), [(64, 4, 85), (3, 4, 85), (1, 5, 80)])
def test_near_copies_are_joined_exactly(spark, frequent, words, percent):
    docs = fx.near_copies(frequent, 400)
    sets = {d: fx.ngrams(t, words) for d, t in docs}
    union = fx.linked(sets, percent)
    found = ngram_join.jaccard_components(
        spark.createDataFrame(docs, "doc_id long, text string"), words=words, percent=percent, frequent=frequent
    )
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {
        d: (len(s), union.root(d)) for d, s in sets.items()
    }


def test_linked_sets_share_enough_segments():
    part = ngram_join.Partition(85)
    for total in range(2, 3000):
        least = -(-85 * total // 185)  # the least intersection of linked sets
        assert part.differing(total) >= total - 2 * least
    for size in (1, 6, 7, 40, 300, 5000):
        for _, m, most in part.bands(size):
            assert m > most


def test_op10_edges(spark):
    rows = ngram_join.jaccard_components(fx.odd(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in fx.ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[6] == (1, 6)
    assert by[4][1] == by[5][1] == 4 and by[None][1] is None
    assert ngram_join.jaccard_components(fx.nothing(spark)).count() == 0




def plain_lines(docs, percent=80):
    places = {}
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                places.setdefault(line.lower().strip(" "), []).append((d, i))
    union = fx.linked({k: full(k) for k in places}, percent)
    groups = {}
    for k, at in places.items():
        groups.setdefault(union.root(k), []).extend(at)
    dropped = {}
    for at in groups.values():
        at.sort()
        for d, i in at[1:]:
            dropped.setdefault(d, []).append((i, *at[0]))
    return {d: sorted(v) for d, v in dropped.items()}


def test_op7_whole_table(spark):
    docs = [(d, t) for d, t, _ in fx.documents(spark)]
    want = plain_lines(docs)
    rows = {r.doc_id: r for r in catalog.QUERIES["op7_line_dedup"](spark, fx.SF).collect()}
    assert len(rows) == len(docs)
    total = missed = 0
    for d, text in docs:
        got = [tuple(x) for x in rows[d].dropped]
        assert rows[d].n_lines == len(text.split("\n")) and rows[d].n_dropped == len(got)
        total += len(want.get(d, []))
        missed += len(set(want.get(d, [])) ^ set(got))
    assert missed <= 0.005 * total  # banding may miss a pair near the threshold


def test_op7_drops_lines(spark):
    docs = [(1, "A long first line of many words here.\n\nonly here, in one"), (2, "a long first line of many words here.  \nsomething else entirely"),
            (3, "A long first line of many words here."), (4, None), (5, ""), (None, "A long first line of many words here.")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, line string")
    rows = {r.doc_id: r for r in line_dedup.drop_duplicate_lines(df).collect()}
    assert rows[1].text == docs[0][1] and rows[2].text == "something else entirely"
    assert 3 not in rows and rows[4].text is None and rows[5].text == "" and rows[None].text == docs[5][1]


def test_op7_runs_no_python(spark):
    lines = line_dedup.lines_of(spark.read.parquet(f"{fx.SF}/documents.parquet"), "doc_id", "text")
    assert not re.search("Python|Pandas|Arrow", line_dedup.signatures(lines)._jdf.queryExecution().toString())


def test_op7_edges(spark):
    rows = line_dedup.line_report(fx.odd(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in fx.ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_lines == 0 and by[9].n_dropped == 1 and by[5].n_dropped == 1
    assert line_dedup.line_report(fx.nothing(spark)).count() == 0
    assert line_dedup.drop_duplicate_lines(fx.odd(spark)).columns == fx.odd(spark).columns


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{fx.SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "secret_scan", "packing"]
    known = stages["language_id"](spark, docs, fx.SF).cache()
    assert known.columns == columns and known.count() >= 0.99 * docs.count()
    lines = stages["line_dedup"](spark, known, fx.SF).cache()
    want = plain_lines([(r.doc_id, r.text) for r in known.collect()])
    for r in lines.collect():
        gone = {i for i, *_ in want.get(r.doc_id, [])}
        text = next(x.text for x in known.where(known.doc_id == r.doc_id).collect())
        if r.doc_id % 20 == 0 and not gone:
            assert r.text == text
        assert r.n_chars == len(r.text)
    near = stages["ngram_join"](spark, lines, fx.SF).cache()
    sets = {r.doc_id: fx.ngrams(r.text, 5) for r in lines.collect()}
    union = fx.linked(sets, 80)
    assert {r.doc_id for r in near.collect()} == {d for d in sets if union.root(d) == d}
    clean = stages["secret_scan"](spark, near, fx.SF).cache()
    assert clean.columns == columns and clean.count() == near.count()
    assert stages["packing"](spark, clean, fx.SF).select("doc_id").distinct().count() == clean.count()


def test_pipeline_of_odd_and_no_rows(spark):
    for docs in (spark.createDataFrame(fx.ODD, fx.SCHEMA), fx.nothing(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, fx.SF)
        docs.count()
