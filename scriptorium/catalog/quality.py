"""Queries that check data: violations and suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.base import query
from scriptorium.operators import aggregates, quality
from scriptorium.plans import adapters


def _suite_sql(rows: list[tuple[str, str]], table: str, prefix: str = "") -> str:
    """(expectation, condition that fails) rows over a table."""
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS expectation, (SELECT count(*) FROM {table}) AS checked, "
        f"(SELECT count(*) FROM {table} WHERE {bad}) AS failed"
        for name, bad in rows
    )
    return f"{prefix} SELECT *, failed = 0 AS passed FROM ({parts})"


@query(
    "q1_not_null",
    f"WITH {sql.VIEWS} SELECT university_id, CAST(view_date AS VARCHAR) AS view_date, page_title, event_id FROM raw_views WHERE views IS NULL",
)
def q1_not_null(spark, sf):
    broken = quality.null_violations(adapters.raw_views(spark, sf), ["university_id", "views"])
    return broken.select(
        "university_id",
        F.col("view_date").cast("string").alias("view_date"),
        "page_title",
        F.col("filename").cast("bigint").alias("event_id"),
    )


@query(
    "q1_accepted_values",
    """SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1""",
)
def q1_domain(spark, sf):
    return quality.domain_violations(
        adapters.table(spark, sf, "events"), "event_type", ["click", "view", "purchase"]
    )


@query(
    "q1_foreign_key",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def q1_fk(spark, sf):
    orders = adapters.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    solvent = adapters.table(spark, sf, "customer").where("c_acctbal > 0")
    return quality.foreign_key_violations(orders, "o_custkey", solvent, "c_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "q2_unique_grain",
    f"WITH {sql.AUTHORSHIPS} SELECT work_id, author_id, count(*) AS n FROM authorships GROUP BY 1, 2 HAVING count(*) > 1",
)
def q2(spark, sf):
    return quality.grain_violations(adapters.authorships(spark, sf), ["work_id", "author_id"])


@query(
    "q3_pairs_consistent",
    """SELECT l_suppkey AS author_a, l_partkey AS author_b, CAST(l_linenumber - 1 AS BIGINT) AS co_publications FROM lineitem
       WHERE NOT l_suppkey < l_partkey OR l_linenumber - 1 < 1""",
)
def q3(spark, sf):
    pairs = adapters.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("author_a"),
        F.col("l_partkey").alias("author_b"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("co_publications"),
    )
    return quality.pair_violations(pairs)


@query(
    "q5_candidates_in_referential",
    f"""WITH {sql.MENTIONS}, {sql.REFERENTIAL} SELECT record_id, org_key FROM mentions
    WHERE org_key IN (SELECT org_key FROM referential)""",
)
def q5(spark, sf):
    from scriptorium.operators import reshape

    staged = reshape.stage_mentions(reshape.mentions(adapters.native_news(spark, sf)))
    return quality.known_candidates(staged, adapters.referential(spark, sf)).select("record_id", "org_key")


@query(
    "q6_negative_views",
    f"WITH {sql.VIEWS} SELECT event_id, views FROM raw_views WHERE views < 0",
)
def q6(spark, sf):
    return quality.negative_views(adapters.raw_views(spark, sf)).select(
        F.col("filename").cast("bigint").alias("event_id"), "views"
    )


@query(
    "q7_expectation_suite",
    _suite_sql(
        [
            ("o_orderkey.not_null", "o_orderkey IS NULL"),
            ("o_orderpriority.matches", "NOT regexp_matches(o_orderpriority, '^[1-3]-')"),
            ("o_totalprice.between", "NOT (o_totalprice >= 1000 AND o_totalprice <= 400000)"),
            ("o_orderstatus.in_set", "o_orderstatus NOT IN ('F', 'O')"),
            ("o_orderpriority.length", "length(o_orderpriority) NOT BETWEEN 5 AND 8"),
            ("o_orderkey.exists", "false"),
            ("o_missing.exists", "o_orderkey = 0"),
            ("row_count", "false"),
        ],
        "orders",
    ),
)
def q7(spark, sf):
    return quality.suite(
        adapters.table(spark, sf, "orders"),
        [
            quality.not_null("o_orderkey"),
            quality.matches("o_orderpriority", "^[1-3]-"),
            quality.between("o_totalprice", 1000, 400000),
            quality.in_set("o_orderstatus", ["F", "O"]),
            quality.length_between("o_orderpriority", 5, 8),
        ],
        min_rows=1,
        columns=["o_orderkey", "o_missing"],
    )


@query(
    "q8_vector_contract",
    _suite_sql(
        [
            ("label.not_null", "label IS NULL"),
            ("vector.not_null", "embedding IS NULL"),
            ("dimension", "len(embedding) <> 64"),
            ("finite", "false"),
            ("norm", "abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-6"),
        ],
        "embeddings",
    )
    + """ UNION ALL SELECT 'unique', (SELECT count(*) FROM embeddings), s, s = 0 FROM
      (SELECT CAST(sum(n - 1) AS BIGINT) AS s FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))""",
)
def q8(spark, sf):
    return quality.vector_suite(
        adapters.vectors(spark, sf), "label", "vector", 64, strict=True, tolerance=1e-6
    )


_PAIRS_SQL = f"""WITH {sql.LINKS}, pairs AS (SELECT x.author_id AS author_a, y.author_id AS author_b, count(*) AS co_publications
  FROM links x JOIN links y ON x.work_id = y.work_id AND x.author_id < y.author_id GROUP BY 1, 2)"""


@query(
    "q4_collab_contract",
    _suite_sql(
        [
            ("author_a.not_null", "author_a IS NULL"),
            ("author_b.not_null", "author_b IS NULL"),
            ("co_publications.not_null", "co_publications IS NULL"),
            ("co_publications.between", "co_publications < 1 OR co_publications > 25"),
        ],
        "pairs",
        _PAIRS_SQL,
    ),
)
def q4_collab(spark, sf):
    return quality.collab_suite(aggregates.collab_pairs(adapters.authorships(spark, sf)), 25)


@query(
    "q4_labels_contract",
    _suite_sql(
        [
            ("author_id.not_null", "author_id IS NULL"),
            ("kind.not_null", "kind IS NULL"),
            ("label_id.not_null", "label_id IS NULL"),
            ("weight.not_null", "weight IS NULL"),
            ("freq.not_null", "freq IS NULL"),
            ("kind.in_set", "kind NOT IN ('topic', 'keyword')"),
            ("weight.between", "NOT weight > 0 OR weight > 15"),
            ("freq.between", "freq < 1"),
        ],
        "labels_",
        f"""WITH {sql.LINKS}, {sql.TOPICS}, {sql.KEYWORDS}, scored AS (
          SELECT work_id, 'topic' AS kind, topic_id AS label_id, score FROM topics WHERE score >= 0.5
          UNION ALL SELECT work_id, 'keyword', keyword_id, score FROM keywords WHERE score >= 0.2),
        labels_ AS (SELECT author_id, kind, label_id, sum(score) AS weight, count(DISTINCT l.work_id) AS freq
          FROM links l JOIN scored s ON s.work_id = l.work_id GROUP BY 1, 2, 3)""",
    ),
)
def q4_labels(spark, sf):
    labels = aggregates.researcher_labels(
        adapters.authorships(spark, sf),
        adapters.topics(spark, sf),
        adapters.keywords(spark, sf),
    )
    return quality.labels_suite(labels, 15)


@query(
    "q9_predictions_contract",
    _suite_sql(
        [
            ("author_a.not_null", "false"),
            ("author_b.not_null", "false"),
            ("uplift.not_null", "false"),
            ("canonical", "NOT l_suppkey < l_partkey"),
            ("served_mode.in_set", "l_returnflag = 'R'"),
        ],
        "lineitem",
    ),
)
def q9_predictions(spark, sf):
    rows = adapters.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("author_a"),
        F.col("l_partkey").alias("author_b"),
        F.col("l_tax").alias("uplift"),
        F.when(F.col("l_returnflag") == "R", "unknown").otherwise("predictive").alias("served_mode"),
    )
    return quality.predictions_suite(rows)


@query(
    "q9_recommendations_contract",
    _suite_sql(
        [
            ("author_id.not_null", "false"),
            ("partner_id.not_null", "false"),
            ("not_self", "l_suppkey = l_partkey"),
            ("rank.between", "l_linenumber - 1 < 1"),
        ],
        "lineitem",
    ),
)
def q9_recommendations(spark, sf):
    rows = adapters.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("author_id"),
        F.col("l_partkey").alias("partner_id"),
        (F.col("l_linenumber") - 1).alias("rank"),
    )
    return quality.recommendations_suite(rows)


@query(
    "q10_count_matches",
    """SELECT (SELECT count(*) FROM orders) AS loaded, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS declared,
       (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS passed""",
)
def q10(spark, sf):
    declared = adapters.table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey")).scalar()
    return quality.count_matches(adapters.table(spark, sf, "orders"), declared)


@query(
    "q11_schema_check",
    """SELECT name, name <> 'l_missing' AS present, name IN ('l_orderkey', 'l_quantity') AS typed
       FROM (SELECT unnest(['l_orderkey', 'l_quantity', 'l_tax', 'l_missing']) AS name)""",
)
def q11(spark, sf):
    return quality.schema_check(
        spark,
        [f"{sf}/lineitem.parquet"],
        {"l_orderkey": "bigint", "l_quantity": "double", "l_tax": "string", "l_missing": "int"},
    )


@query(
    "w3_unique_grain_flag",
    f"""WITH {sql.AUTHORSHIPS} SELECT work_id, author_id, author_position, count(*) OVER (PARTITION BY work_id, author_id) = 1 AS unique_grain FROM authorships""",
)
def w3(spark, sf):
    from scriptorium.operators import windows

    flagged = windows.unique_grain(adapters.authorships(spark, sf), ["work_id", "author_id"])
    return flagged.select("work_id", "author_id", "author_position", "unique_grain")
