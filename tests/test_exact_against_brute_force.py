"""Distributed algorithms against plain loops on small data."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text
from scriptorium.operators import learn, matching, neighbours, reshape, series, windows
from scriptorium.session import scratch_path
from scriptorium.streaming import jobs


@pytest.mark.parametrize(("pivots", "block", "chunk"), [(8, 16, 40), (64, 2048, 8192)])
def test_knn_is_exact(spark, pivots, block, chunk):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6)) * 3
    vectors = centres[rng.integers(0, 5, 120)] + rng.normal(size=(120, 6))
    vectors[60:90] = vectors[60]  # a quarter of identical copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "author_id bigint, vector array<double>")
    found = neighbours.knn(df, 4, pivots=pivots, block=block, chunk=chunk).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    np.fill_diagonal(sims, -np.inf)
    expected = {(i, int(j)) for i in range(120) for j in np.argsort(-sims[i], kind="stable")[:4]}
    assert {(r.author_id, r.neighbour) for r in found} == expected


def routed_rows(spark, monkeypatch, n: int) -> tuple[int, int]:
    """Rows of targets and of queries that are shuffled for ``n`` clustered vectors."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(n // 50, 8)) * 4
    vectors = np.repeat(centres, 50, axis=0) + rng.normal(size=(n, 8)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "author_id bigint, vector array<double>")
    seen = []
    inner = neighbours.routed

    def counting(*args):
        queries, targets = inner(*args)
        seen.append((targets.count(), queries.count()))
        return queries, targets

    monkeypatch.setattr(neighbours, "routed", counting)
    found = neighbours.knn(df, 4, block=32, chunk=128).collect()
    monkeypatch.undo()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    np.fill_diagonal(sims, -np.inf)
    assert {(r.author_id, r.neighbour) for r in found} == {(i, int(j)) for i in range(n) for j in np.argsort(-sims[i], kind="stable")[:4]}
    return tuple(map(sum, zip(*seen)))


def test_knn_routes_what_is_reached(spark, monkeypatch):
    """A copy of every target to every chunk of 128 queries would be n * n / 128 rows."""
    (few, _), (many, queries) = (routed_rows(spark, monkeypatch, n) for n in (600, 2400))
    assert many < 12 * few and many < 2400 * 2400 / 128 / 4 and queries < 2400 * 16


@pytest.mark.parametrize("minimum", [0.2, 0.6])
def test_similarity_join_is_exact(spark, minimum):
    rng = random.Random(1)
    rows = [(i, f"d{d}", rng.random()) for i in range(40) for d in rng.sample(range(12), 5)]
    profiles = {}
    for i, d, w in rows:
        profiles.setdefault(i, {})[d] = w
    for p in profiles.values():
        size = sum(w * w for w in p.values()) ** 0.5
        for d in p:
            p[d] /= size
    df = spark.createDataFrame([(i, d, w) for i, p in profiles.items() for d, w in p.items()], "researcher_id int, dim string, weight double")
    expected = set()
    for a, b in itertools.combinations(range(40), 2):
        if sum(w * profiles[b].get(d, 0) for d, w in profiles[a].items()) >= minimum:
            expected.add((a, b))
    assert {(r.a, r.b) for r in neighbours.similar_profiles(df, minimum).collect()} == expected


@pytest.mark.parametrize("by", ["similarity", "complementarity"])
def test_best_matches_do_not_depend_on_blocks(spark, by):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        own = {f"{level}::{rng.randrange(size)}" for level, size in (("domain", 2), ("field", 4), ("subfield", 8), ("topic", 40)) for _ in range(3)}
        weights = [rng.random() for _ in own]
        size = sum(w * w for w in weights) ** 0.5
        rows += [(i, d, w / size) for d, w in zip(sorted(own), weights)]
    profiles = spark.createDataFrame(rows, "researcher_id int, dim string, weight double")
    embedded = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(0, 60, 3)], "researcher_id int, vector array<double>")
    found = [
        {(r.researcher_a, r.researcher_b, round(r[by], 9)) for r in matching.best_matches(profiles, embedded, 5, by, block=b).collect()}
        for b in (7, 1000)
    ]
    assert found[0] == found[1] and len(found[0]) == 300
    top = matching.top_overall(matching.best_matches(profiles, embedded, 5, by), 5, by).collect()
    assert [round(r[by], 9) for r in top] == sorted((s for a, b, s in found[0] if a < b), reverse=True)[:5]


def test_scope_of_any_length(spark):
    works = spark.createDataFrame(
        [(i, 2000 + i % 3, [{"author": {"id": f"A{i}"}, "institutions": [{"ror": f"r{i}"}, {"ror": f"r{i + 1}"}]}]) for i in range(50)],
        "work_id int, publication_year int, authorships array<struct<author: struct<id: string>, institutions: array<struct<ror: string>>>>",
    )
    ids = [f"r{i}" for i in range(30, 5_000)]
    table = spark.createDataFrame([(i,) for i in ids], "ror string")
    for scope in (ids, table):
        kept = reshape.filter_scope(works, scope, 2001)
        assert {r.work_id for r in kept.collect()} == {i for i in range(29, 50) if i % 3}
        assert reshape.affiliated_authors(works, scope).count() == 21
    assert reshape.filter_scope(works, []).count() == 0


def test_stored_index_reads_its_terms(spark, monkeypatch):
    """Runs add up and replace themselves; a search reads the row groups of its terms."""
    monkeypatch.setattr(matching, "INDEX_ROWS", 500)
    path = scratch_path(spark, "t")
    rows = [(i, " ".join(f"w{(i * k) % 997:03d}" for k in range(1, 30))) for i in range(400)]
    for run, part in (("a", rows[:250]), ("b", rows[:9]), ("b", rows[250:])):
        df = spark.createDataFrame(part, "doc_id long, text string")
        matching.add_to_index(matching.text_index(df, "doc_id").coalesce(2), path, run, "doc_id")
    stored = matching.stored_index(spark, path)
    whole = matching.text_index(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    wanted = dict(all_of=["w012"], any_of=["w012", "w024"], none_of=["w036"], n=50)
    found = matching.search_index(stored, "doc_id", **wanted)
    assert {(r.doc_id, round(r["rank"], 9)) for r in found.collect()} == {
        (r.doc_id, round(r["rank"], 9)) for r in matching.search_index(whole, "doc_id", **wanted).collect()
    }
    hits = stored.where(F.col("term").isin("w012"))
    plan = hits._jdf.queryExecution().executedPlan()
    hits.collect()
    assert "PushedFilters: [In(term" in plan.toString() or "EqualTo(term" in plan.toString()
    files = [f for f in stored.inputFiles()]
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in files]
    total = sum(m.num_row_groups for m in groups)
    holding = sum(
        m.row_group(g).column(0).statistics.min <= "w012" <= m.row_group(g).column(0).statistics.max
        for m in groups for g in range(m.num_row_groups)
    )
    assert total >= 20 and holding <= total / 4


@pytest.mark.parametrize("hot", [50_000, 2])
def test_reference_matches_per_owner_in_order(spark, monkeypatch, hot):
    """Each owner's titles meet their own segments only; a trigram of many is dealt into parts."""
    monkeypatch.setattr(matching, "HOT_POSTINGS", hot)
    monkeypatch.setattr(matching, "HOT_LISTS", 10**9)
    draw = random.Random(7)
    vocabulary = ["plasma", "fusion", "of the", "muscle", "retreat", "theory", "the end"]
    titles = [(o, w, " ".join(draw.choices(vocabulary, k=4))) for o in "ab" for w in range(12)]
    lines = []
    for o in "abc":
        for place in range(40):
            line = list(draw.choice([t for p, _, t in titles if p != "b" or o == "b"]))
            for _ in range(draw.randrange(4)):
                line[draw.randrange(len(line))] = "x"
            lines.append((o, place, "see " + "".join(line) + " there"))
    works = spark.createDataFrame(titles, "owner string, work_id int, title string")
    segments = spark.createDataFrame(lines, "owner string, segment_id int, segment string")
    found = [tuple(r) for r in matching.match_references(works, segments, owner=["owner"]).collect()]

    def grams(s):
        return {s[i : i + 3] for i in range(len(s) - 2)}

    expected = []
    for o, w, title in titles:
        mine = grams(title)
        scores = sorted((len(mine - grams(line)) / len(mine), place) for p, place, line in lines if p == o)
        if scores[0][0] <= 0.2:
            expected.append((o, w, scores[0][1], scores[0][0]))
    assert found == sorted(expected, key=lambda r: (r[0], r[3], r[1])) and len(found) > 10


def test_reference_matching_is_exact(spark):
    titles = [(1, "Magnetic confinement of fusion plasmas"), (2, "A short"), (3, "Muscle metabolism and nutrition")]
    lines = [
        (1, "Martin A. (2019). Magnetic confinement of fusion plasma. Journal."),
        (2, "Unrelated text about Muscle metabolismand nutrtion in sports"),
        (3, "Nothing of interest is written in this line at all"),
    ]
    works = spark.createDataFrame(titles, "work_id int, title string")
    segments = spark.createDataFrame(lines, "segment_id int, segment string")
    found = {r.work_id: r.score for r in matching.match_references(works, segments).collect()}

    def grams(s):
        s = " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
        return {s[i : i + 3] for i in range(len(s) - 2)}

    expected = {}
    for work, title in titles:
        if len(title) < 10:
            continue
        best = min(len(grams(title) - grams(line)) / len(grams(title)) for _, line in lines)
        if best <= 0.2:
            expected[work] = pytest.approx(best)
    assert found == expected and 1 in found


def test_features_do_not_see_the_future(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    before = spark.createDataFrame([("u", d, i) for i, d in enumerate(days)], "key string, day date, n int")
    after = spark.createDataFrame([("u", d, i if i < 30 else 999) for i, d in enumerate(days)], "key string, day date, n int")

    def at_30(df):
        features = windows.rolling_features(series.densify(df, "key", "day", "n"), "key", "day", "n")
        return features.where(F.col("t") == 29).drop("n").first()

    assert at_30(before) == at_30(after)
    assert at_30(before).lag_1 == 29.0 and at_30(before).trend_7 == 6.0


def test_densify_fills_gaps(spark):
    df = spark.createDataFrame([("u", dt.date(2024, 1, 31), 2), ("u", dt.date(2024, 2, 3), 1)], "key string, day date, n int")
    assert [r.n for r in series.densify(df, "key", "day", "n").orderBy("day").collect()] == [2, 0, 0, 1]


def test_seasonal_naive_falls_back_to_persistence(spark):
    df = spark.createDataFrame([("u", dt.date(2024, 1, i), i) for i in (1, 2, 3)], "key string, day date, n int")
    found = {r.horizon: r.prediction for r in series.seasonal_naive(df, "key", "day", "n", range(1, 9)).collect()}
    values = [1.0, 2.0, 3.0]
    for h, prediction in found.items():
        src = 2 + h
        while src > 2:
            src -= 7
        assert prediction == (values[src] if src >= 0 else 3.0)


def test_rolling_kpis_against_a_loop(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    stamps = [start + dt.timedelta(hours=rng.randrange(0, 24 * 12)) for _ in range(150)] + [dt.datetime(2024, 1, 5)]
    raw = [(1, t, f"user{rng.randrange(6)}", "Page") for t in stamps]
    logs = reshape.clean_logs(spark.createDataFrame(raw, "project_id int, timestamp timestamp, username string, action string"))
    found = {r.date: (r.users_logged, r.actions_total) for r in windows.rolling_kpis(logs, days=4).collect()}
    first, last = min(stamps).date(), max(stamps).date()
    day, expected = first + dt.timedelta(days=4), {}
    while day <= last:
        to = dt.datetime.combine(day, dt.time())
        inside = [u for _, t, u, _ in raw if to - dt.timedelta(days=4) < t <= to]
        expected[day] = (len(set(inside)), len(inside))
        day += dt.timedelta(days=1)
    assert found == expected


def test_group_folds_do_not_split_groups(spark):
    df = spark.range(300).select((F.col("id") % 40).alias("g"))
    folds = windows.group_folds(df, "g").groupBy("g").agg(F.countDistinct("fold").alias("n"))
    assert folds.where("n > 1").count() == 0


def test_drift_of_equal_samples_is_zero(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("v"))
    row = learn.column_drift(df, df, "v").first()
    assert row.ks == 0.0 and row.psi == pytest.approx(0.0) and not row.drift_detected


def test_retrain_loop_terminates():
    def verdict(i, **changed):
        return {"run_id": f"r{i:02d}", "schema_version": 1, "drift_detected": True, "watermark": "w", "produced_at": i * 10**6} | changed

    started, memory = jobs.retrainings(pd.DataFrame([verdict(i) for i in range(20)]), (None, None, None))
    assert started == ["r00"] and memory == ("r19", "w", 0)
    assert jobs.retrainings(pd.DataFrame([verdict(30, watermark="w2")]), memory)[0] == ["r30"]
    for blocked in ({"schema_version": 2}, {"drift_detected": False}, {"run_id": "r19"}, {"run_id": None}, {"produced_at": 60}):
        assert jobs.retrainings(pd.DataFrame([verdict(30, watermark="w2") | blocked]), memory)[0] == []


def test_retrain_stream_remembers_over_batches(spark, tmp_path):
    """Each batch continues where the one before ended, as one search over all verdicts does."""
    schema = "pipeline string, run_id string, schema_version int, drift_detected boolean, watermark string, produced_at long"
    rng = random.Random(11)
    rows = [
        (f"p{rng.randrange(3)}", f"r{i:03d}", rng.choice([1, 1, 1, 2]), rng.random() < 0.7, rng.choice(["a", "b", "c"]), i * 5_000)
        for i in range(120)
    ]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in range(3):
        batch = rows[part * 40 : part * 40 + 40]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.retrain_triggers(jobs.file_stream(spark, source, T._parse_datatype_string(schema)))
        jobs.run_to_files(stream, out, progress)
    found = {r.run_id for r in spark.read.parquet(out).collect()}
    expected = set()
    for pipeline in ("p0", "p1", "p2"):
        mark = since = None
        for _, run, version, drift, watermark, at in (r for r in rows if r[0] == pipeline):
            if version == 1 and drift and watermark != mark and (since is None or at - since >= jobs.COOLDOWN_SECONDS):
                expected.add(run)
                mark, since = watermark, at
    assert found == expected and len(found) > 3


def test_no_table_of_queries_by_blocks_is_stored_or_broadcast(spark, monkeypatch):
    stored, rows = {}, 300
    real = neighbours.materialize

    def kept(df, label="table"):
        stored.setdefault(label, []).append(real(df, label))
        return stored[label][-1]

    monkeypatch.setattr(neighbours, "materialize", kept)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(rows, 8)))], "author_id long, vector array<double>")
    assert neighbours.knn(df, 3, pivots=12, block=32, chunk=64).count() == 3 * rows
    # Without clusters every vector reaches every cell; still each is one row, with its blocks in a list.
    assert [t.count() for t in stored["reached"]] == [rows, rows]
    asked, _ = neighbours.routed(stored["reached"][1], spark.createDataFrame([], "id long, v array<double>, cell int, sub int"), 64)
    assert asked.count() > rows


@pytest.mark.parametrize("block", [20_000, 3])
def test_reference_candidates_are_counted_where_the_segment_is(spark, monkeypatch, block):
    """No row per trigram, nor per title and segment: the plan explodes nothing but blocks and parts."""
    monkeypatch.setattr(matching, "HOT_POSTINGS", 16)
    monkeypatch.setattr(matching, "TITLE_BLOCK", block)
    works = spark.createDataFrame([(w, f"common words in title {w % 7} of {w}") for w in range(20)], "work_id int, title string")
    rows = [((i % 5, i), f"common words in title {i % 7} of {i % 20} and more") for i in range(60)]
    segments = spark.createDataFrame(rows, "segment_id struct<doc:int,place:int>, segment string")
    # A segment without an id of its owner, and one without text, match nothing.
    found = matching.match_references(works, segments.unionByName(segments.limit(1).withColumn("segment", F.lit(None).cast("string"))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_hits" not in plan and "array_except" not in plan
    got = {r.work_id: (tuple(r.segment_id), r.score) for r in found.collect()}
    mine = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    for w, title in works.collect():
        best = min((len(mine(title) - mine(line)) / len(mine(title)), at) for at, line in rows)
        assert got[w] == (best[1], best[0])
