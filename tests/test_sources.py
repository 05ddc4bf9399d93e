"""Selections, sinks, manifests and dictionaries."""

from __future__ import annotations

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import quality
from scriptorium.plans import review
from scriptorium.session import scratch_path
from scriptorium.sources import scans, selection, sinks, synth


def test_run_is_never_overwritten(spark):
    root = scratch_path(spark, "t")
    sinks.write_run(spark.range(3), root, "2024-01", "a")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_run(spark.range(3), root, "2024-01", "a")


def test_manifest_detects_every_violation(spark):
    root = scratch_path(spark, "t")
    sinks.write_run(spark.range(10).repartition(2), root, "2024-01", "a")
    manifest = sinks.build_manifest(spark, root, "2024-01", "a", "now")
    sinks.write_manifest(manifest, root, "2024-01", "a")
    assert sinks.verify_manifest(spark, root, "2024-01", "a").count() == 0
    assert sinks.manifest_json(sinks.read_manifest(spark, root, "2024-01", "a"))["row_count"] == 10

    broken = (
        sinks.read_manifest(spark, root, "2024-01", "a")
        .withColumn("schema_version", F.lit(9))
        .withColumn("row_count", F.lit(11).cast("bigint"))
        .withColumn(
            "parts",
            F.transform(
                "parts",
                lambda p, i: F.struct(
                    F.when(i == 0, F.lit("dt=2024-01/run=a/gone.parquet")).otherwise(p["key"]).alias("key"),
                    F.when(i == 1, F.lit("00")).otherwise(p["sha256"]).alias("sha256"),
                    p["bytes"].alias("bytes"),
                ),
            ),
        )
    )
    copy = scratch_path(spark, "t")
    sinks.write_run(spark.read.parquet(sinks.run_path(root, "2024-01", "a")).coalesce(1), copy, "2024-01", "a")
    sinks.write_manifest(broken, copy, "2024-01", "a")
    kinds = {r.kind for r in sinks.verify_manifest(spark, copy, "2024-01", "a").collect()}
    assert {"unknown_version", "row_count", "missing_part"} <= kinds


def test_malformed_partition_fails(spark):
    df = spark.createDataFrame([("updated_date=2024-01-01",), ("manifest",)], "partition string")
    with pytest.raises(Exception, match="unexpected name"):
        selection.partitions_after(df, "2020-01-01").collect()
    assert selection.partitions_after(df, None, explicit="manifest").count() == 1


def test_months_to_collect(spark):
    def months(*args):
        return [r.month for r in selection.months_to_collect(spark, *args).collect()]

    assert months("202311", "202402") == ["202312", "202401", "202402"]
    assert months("202311", "202402", 2) == ["202312", "202401"]
    assert months("202402", "202402") == []
    assert months(None, "202402", 2) == ["202401", "202402"]
    assert len(months(None, "202402")) == 36


def test_writers_at_once_lose_no_advance(spark):
    """Every advance of eight threads has a version of its own, and the last one counts."""
    root = scratch_path(spark, "t")
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda i: (selection.advance_watermark(spark, root, "works", str(i)), str(i)), range(40)))
    assert sorted(v for v, _ in versions) == list(range(40))
    assert selection.read_watermark(spark, root, "works") == max(versions)[1]


def test_watermarks_are_independent(spark):
    root = scratch_path(spark, "t")
    assert selection.read_watermark(spark, root, "works") is None
    selection.advance_watermark(spark, root, "works", "1")
    selection.advance_watermark(spark, root, "authors", "x")
    selection.advance_watermark(spark, root, "works", "2")
    assert selection.read_watermark(spark, root, "works") == "2"
    assert selection.read_watermark(spark, root, "authors") == "x"


def test_runs_by_time_then_id(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("m/dt=1/run=b/p.parquet", t[1]), ("m/dt=1/run=a/p.parquet", t[1]), ("m/dt=1/run=z/p.parquet", t[0]), ("m/dt=1/run=q/p.json", t[2])]
    files = spark.createDataFrame(rows, "path string, modified timestamp")
    assert selection.latest_run_per_dt(files).first().run == "b"
    assert selection.previous_run(files, "b").first().run == "a"
    assert selection.previous_run(files, "z").count() == 0


def test_batches(spark):
    rows = [("a", 4), ("b", 4), ("c", 20), ("d", 1), ("e", 9), ("f", 0), ("g", 11), ("h", 0)]
    files = spark.createDataFrame([("x", *r) for r in rows] + [("y", "a", 9)], "folder string, file string, num_rows int")
    found = {(r.folder, r.file): r.batch for r in selection.plan_batches(files, ["folder"], 10).collect()}
    assert found == {("x", f): b for f, b in zip("abcdefgh", (0, 0, 1, 2, 2, 2, 3, 4))} | {("y", "a"): 0}


@pytest.mark.parametrize("group", [[], ["folder"]])
def test_batches_are_those_of_a_walk(spark, group):
    """The plan over ranges of files against a walk from file to file."""
    draw = random.Random(3)
    rows = [(f"d{draw.randrange(3)}", f"f{i:04d}", draw.choice([0, 0, 1, 3, 9, 11, 40, None])) for i in range(400)]
    files = spark.createDataFrame(rows, "folder string, file string, num_rows int").repartition(5)
    expected, held, number = {}, {}, {}
    for folder, file, n in sorted(rows, key=lambda r: (r[0] if group else "", r[1])):
        key, n = folder if group else "", n or 0
        if held.get(key, 0) > 0 and held[key] + n > 10:
            held[key], number[key] = 0, number[key] + 1
        held[key] = held.get(key, 0) + n
        expected[folder, file] = number.setdefault(key, 0)
    assert {(r.folder, r.file): r.batch for r in selection.plan_batches(files, group, 10).collect()} == expected
    sampled = sorted((r.folder, r.file) for r in selection.sample_files(files, 7, group).collect())
    wanted = []
    for key in sorted({r[0] for r in rows}) if group else [None]:
        names = sorted((r[1], r[0]) for r in rows if key in (None, r[0]))
        wanted += [(d, f) for f, d in names[:: max(len(names) // 7, 1)][:7]]
    assert sampled == sorted(wanted)


def test_dictionary_rejects_unknown_types(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame([("a", "f", "weird", "l")], "field_name string, form_name string, field_type string, field_label string").write.option("header", "true").csv(path)
    with pytest.raises(Exception, match="unknown field type"):
        scans.scan_dictionary(spark, path).collect()


def test_researchers_need_their_columns(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame([("1", "x")], "userid string, last_name string").write.option("header", "true").csv(path)
    with pytest.raises(ValueError, match="middle_name"):
        scans.scan_researchers(spark, path)


def test_generated_records_replay(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame(
        [("id", "f", "text", "l", None), ("c", "f", "checkbox", "l", "1, A | 2, B"), ("n", "f", "descriptive", "l", None)],
        "field_name string, form_name string, field_type string, field_label string, select_choices_or_calculations string",
    ).write.option("header", "true").csv(path)
    dictionary = scans.scan_dictionary(spark, path)
    ids = spark.range(5).select(F.col("id").alias("record"))
    first, second = (sorted(map(tuple, synth.generate_records(dictionary, ids, 3, record_field="id").collect())) for _ in range(2))
    assert first == second and {r[1] for r in first} == {"id", "c___1", "c___2"} and len(first) == 15


@pytest.mark.parametrize("mode", ["full", "bounded", "ephemeral", "unknown"])
def test_cache_mode_does_not_change_rows(spark, mode):
    with sinks.with_cache(spark.range(7), mode) as cached:
        assert cached.count() == 7


def test_upsert_updates_and_inserts(spark):
    target = scratch_path(spark, "t")
    schema = "author_id int, v string, w string"
    sinks.load_partition(spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], schema), target, "1", "r")
    fresh = spark.createDataFrame([(2, "B", "1", "r"), (3, "c", "1", "r")], "researcher_id int, v string, dt string, run string")
    sinks.upsert(fresh, target, ["researcher_id", "dt", "run"], ["v"])
    assert sorted((r.researcher_id, r.v, r.w) for r in spark.read.parquet(target).collect()) == [(1, "a", "k"), (2, "B", "k"), (3, "c", None)]


def test_zero_vectors_only_fail_the_strict_contract(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.6, 0.8])], "id string, v array<double>")
    assert quality.vector_suite(df, "id", "v", 2).where("NOT passed").count() == 0
    assert quality.vector_suite(df, "id", "v", 2, strict=True).where("NOT passed").count() == 1


def test_review_store_carries_decisions(spark):
    store_rows = [("A1", "O1", "author", "affiliation", "I1", "accepted", "2024", "x", 0)]
    schema = "`from` string, id string, entity string, field string, value string, status string, hasBeenExtendedAt string, dataIntegrity string, position int"
    fresh_rows = [("A2", "O1", "author", "affiliation", "I1", "pending", "never", "y", 1), ("A2", "O1", "author", "affiliation", "I1", "pending", "never", "y", 2)]
    updated = review.update_store(spark.createDataFrame(store_rows, schema), spark.createDataFrame(fresh_rows, schema))
    assert sorted((r.dataIntegrity, r.status, r.hasBeenExtendedAt) for r in updated.collect()) == [("x", "accepted", "2024"), ("y", "accepted", "2024")]
