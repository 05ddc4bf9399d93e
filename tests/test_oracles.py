"""A sample of registered queries beside their SQL; ``tools/check_oracles.py`` runs all."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
SAMPLE = ("a1_collab_pairs", "a2_researcher_labels", "a4_uplift_labels", "a10_calendar_kpis_week", "j18_carry_forward", "u5_rejected_ids", "w6_rolling_kpis", "t2_supervised", "x1_match_key", "r4_stream_duplicates")

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, connection, name):
    ok, message, *_ = check_oracles.compare(spark, connection, name, driver.queries()[name], driver.oracle_sql()[name], SF)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
