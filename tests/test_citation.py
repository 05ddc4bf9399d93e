"""Hand-derived values over ten works and three authors."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.operators import aggregates, dedup, joins, reshape, windows
from scriptorium.plans import citation

A, B, C = "A1", "A2", "A3"
PHYSICS, MATERIALS, BIOLOGY = "3106", "2505", "1312"
TOPICS = {
    "T1": ("Magnetic confinement fusion research", PHYSICS),
    "T2": ("Fusion materials and technologies", MATERIALS),
    "T3": ("Glycosylation and Glycoproteins Research", BIOLOGY),
    "T4": ("Muscle metabolism and nutrition", BIOLOGY),
    "T5": ("Tokamak plasma diagnostics", PHYSICS),
}
#: work -> (authors, year, impact, topics, keywords)
WORKS = {
    "W1": ([A, B], 2018, 0.5, {"T1": 0.9991, "T2": 0.9982}, {"plasma": 0.5598, "shield": 0.2103}),
    "W2": ([A, B], 2019, 1.2, {"T1": 0.9876}, {"plasma": 0.4471}),
    "W3": ([A, C], 2020, 0.8, {"T3": 0.9678}, {"chemistry": 0.8414, "reagent": 0.1138}),
    "W4": ([A, B, C], 2021, 1.5, {"T5": 0.95}, {"fusion": 0.8}),
    "W5": ([A], 2022, 0.3, {"T4": 0.951}, {"chemistry": 0.6627}),
    "W6": ([A], 2016, 0.5, {"T1": 0.91}, {"plasma": 0.6}),
    "W7": ([A], 2017, 0.6, {"T2": 0.92}, {"shield": 0.3}),
    "W8": ([B], 2016, 0.4, {"T1": 0.88}, {"plasma": 0.55}),
    "W9": ([B], 2017, 0.5, {"T5": 0.91}, {"fusion": 0.7}),
    "W10": ([C], 2017, 0.7, {"T3": 0.93}, {"chemistry": 0.8}),
}


@pytest.fixture(scope="module")
def works(spark):
    def labelled(value):
        return {"id": value, "display_name": f"name {value}"}

    rows = [
        {
            "work_id": work,
            "publication_year": year,
            "title": f" Work {work} ",
            "type": "article",
            "fwci": impact,
            "cited_by_count": 1,
            "updated_date": dt.date(year + 1, 1, 1),
            "authorships": [
                {
                    "author": {"id": a, "display_name": a, "orcid": None},
                    "author_position": "first" if i == 0 else "middle",
                    "is_corresponding": True if i == 0 else None,
                    "institutions": [{"id": "I1", "ror": "R1", "display_name": "One", "country_code": "FR", "type": "education"}],
                }
                for i, a in enumerate(authors)
            ],
            "topics": [
                {
                    "id": t,
                    "display_name": TOPICS[t][0],
                    "score": score,
                    "subfield": labelled(TOPICS[t][1]),
                    "field": labelled("f"),
                    "domain": labelled("d"),
                }
                for t, score in topics.items()
            ],
            "keywords": [{"id": k, "display_name": k.capitalize(), "score": s} for k, s in keywords.items()],
        }
        for work, (authors, year, impact, topics, keywords) in WORKS.items()
    ]
    return spark.createDataFrame(rows, schemas.WORKS).cache()


@pytest.fixture(scope="module")
def marts(works):
    return citation.build_marts(works)


def test_pairs(marts):
    found = {(r.author_a, r.author_b): r.co_publications for r in marts.collab.collect()}
    assert found == {(A, B): 3, (A, C): 2, (B, C): 1}


def test_labels(marts):
    rows = {(r.author_id, r.kind, r.label_id): (round(r.weight, 4), r.freq) for r in marts.labels.collect()}
    assert len(rows) == 19
    assert rows[A, "keyword", "plasma"] == (1.6069, 3)
    assert rows[A, "topic", "T1"] == (2.8967, 3)
    assert rows[B, "topic", "T5"] == (1.86, 2)
    assert not any(label == "reagent" for _, _, label in rows)


def test_profiles(marts):
    rows = {(r.author_id, r.subfield_id): (round(r.weight, 4), r.freq) for r in marts.profiles.collect()}
    assert len(rows) == 7
    assert rows[A, PHYSICS] == (3.8467, 4)
    assert rows[B, PHYSICS] == (4.7267, 5)


def test_documents(marts):
    lengths = {r.author_id: len(r.doc_text) for r in marts.documents.collect()}
    assert lengths == {A: 340, B: 240, C: 135}


def test_uplift_is_leakage_free(marts):
    rows = {(r.author_a, r.author_b): (r.uplift, r.n_copubs) for r in marts.uplift.collect()}
    assert set(rows) == {(A, B), (A, C)}
    assert rows[A, B] == (pytest.approx(199 / 360), 3)
    assert rows[A, C] == (pytest.approx(9 / 20), 2)


def test_copublication_uplift(works, marts):
    links = reshape.explode_authorships(works)
    rows = {(r.author_a, r.author_b, r.work_id): r.uplift for r in citation.copublication_uplift(marts.works, links).collect()}
    assert rows[A, B, "W1"] == pytest.approx(0.0)
    assert rows[A, B, "W2"] == pytest.approx(0.7)
    assert rows[A, C, "W3"] == pytest.approx(0.1)


def test_purge(works):
    links = reshape.explode_authorships(works).select("author_id", "work_id")
    assert reshape.purge(links, "[]").count() == links.count()
    kept = reshape.purge(links, '[{"author_id": "A1", "work_id": "W1"}]')
    assert kept.count() == links.count() - 1


def test_scope(works):
    assert reshape.filter_scope(works, ["R1"], 2019).count() == 4
    assert reshape.filter_scope(works, ["R2"]).count() == 0
    assert reshape.filter_scope(works, []).count() == 0
    assert {r.author_id for r in reshape.affiliated_authors(works, ["R1"]).collect()} == {A, B, C}


def test_missing_corresponding_is_false(works):
    rows = reshape.explode_authorships(works).where("author_position = 'middle'").collect()
    assert rows and not any(r.is_corresponding for r in rows)


def test_salted_pairs_equal_plain_pairs(spark):
    links = spark.createDataFrame([(w, a) for w in range(4) for a in range(40 if w == 0 else 5)], "work_id int, author_id int")
    plain = joins.coauthor_pairs(links)
    salted = joins.coauthor_pairs(links, hot=7)
    assert plain.count() == 40 * 39 // 2 + 3 * 10
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_latest_ignores_input_order(spark):
    rows = [("k", None, 1), ("k", 5, 2), ("k", 5, 3), ("j", None, 9)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "key string, a int, b int")
        found = {r.key: (r.a, r.b) for r in dedup.latest_by(df, ["key"], ["a", "b"]).collect()}
        assert found == {"k": (5, 3), "j": (None, 9)}


def test_earliest_puts_nulls_last(spark):
    df = spark.createDataFrame([("k", None, "x"), ("k", 3, "y")], "key string, p int, v string")
    assert dedup.earliest_by(df, ["key"], ["p"]).first().v == "y"


def test_top_partners_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("a", "c", 1.0), ("a", "b", 1.0), ("b", "c", 2.0)], "author_a string, author_b string, uplift double")
    rows = [(r.author_id, r.partner_id, r.rank) for r in windows.top_partners(df, 1).orderBy("author_id").collect()]
    assert rows == [("a", "b", 1), ("b", "c", 1), ("c", "b", 1)]


def test_regression_metrics_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 0.0, 1.0)], "y double, prediction double, baseline double")
    row = aggregates.regression_metrics(df).first()
    assert (row.r2, row.mae, row.baseline_mae) == (0.0, 1.0, 0.0)


def test_profile_keywords(works):
    dims = citation.profile_dimensions(
        reshape.explode_authorships(works), reshape.explode_topics(works), reshape.explode_keywords(works)
    )
    row = dims.where((F.col("researcher_id") == A) & (F.col("dim") == "keyword::plasma")).first()
    assert row.score == pytest.approx(1.6069)


def test_pairs_are_made_by_as_many_tasks_as_they_need(spark, monkeypatch):
    """The tasks follow the pairs that come out, not the few bytes of the links."""
    monkeypatch.setattr(joins, "PAIRS_OF_TASK", 100)
    rows = [(w, a) for w in range(20) for a in range(15)]
    links = spark.createDataFrame(rows, "work_id int, author_id int")
    pairs = joins.coauthor_pairs(links, hot=4)
    per_task = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count(F.lit(1)), F.sum("count")).first()
    assert per_task[2] == 20 * 15 * 14 / 2 and per_task[1] > 10 and per_task[0] <= 1_000


def _many_works(spark, shared: int = 20, authors: int = 15):
    works = spark.createDataFrame([(w, 2000 + w % 5, 1.0 + w / 7) for w in range(shared)], "work_id int, publication_year int, fwci double")
    links = spark.createDataFrame([(w, a) for w in range(shared) for a in range(authors) if (w + a) % 4], "work_id int, author_id int")
    return works, links


def test_copublications_stay_in_tasks_of_their_size(spark, monkeypatch):
    """Uplifts leave as many tasks as their pairs need, whatever the number of shuffle partitions."""
    works, links = _many_works(spark)
    whole = {tuple(r[:3]): r[3] for r in citation.copublication_uplift(works, links).collect()}
    monkeypatch.setattr(joins, "PAIRS_OF_TASK", 100)
    uplift = citation.copublication_uplift(works, links)
    tasks = uplift.groupBy(F.spark_partition_id()).count().count()
    assert tasks > 8
    assert {tuple(r[:3]): r[3] for r in uplift.collect()} == pytest.approx(whole)


def test_collab_pairs_are_counted_in_tasks_of_their_size(spark, monkeypatch):
    works, links = _many_works(spark)
    whole = {tuple(r) for r in aggregates.collab_pairs(links).collect()}
    monkeypatch.setattr(joins, "PAIRS_OF_TASK", 100)
    counted = aggregates.collab_pairs(links)
    assert counted.groupBy(F.spark_partition_id()).count().count() > 8
    assert {tuple(r) for r in counted.collect()} == whole
