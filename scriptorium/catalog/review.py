"""Queries over review events."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.base import query
from scriptorium.operators import aggregates, dedup, joins, reshape, sets
from scriptorium.plans import adapters, review

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(
    "f23_filter_by",
    f"""WITH {sql.REVIEW} SELECT position, "from", id, value FROM review
    WHERE entity = 'author' AND field = 'affiliation' AND status = 'pending'""",
)
def f23(spark, sf):
    kept = reshape.filter_by(
        adapters.review_events(spark, sf),
        {"entity": "author", "field": "affiliation", "status": "pending"},
    )
    return kept.select("position", "from", "id", "value")


@query(
    "f24_decide",
    f"""WITH {sql.REVIEW} SELECT position, value, CASE WHEN value IN ('V1', 'V3', 'V5') THEN 'accepted' ELSE 'rejected' END AS status,
    '2024-02-01' AS "updatedAt" FROM review WHERE entity = 'author' AND status = 'pending'""",
)
def f24(spark, sf):
    decided = reshape.decide(
        adapters.review_events(spark, sf),
        ["V1", "V3", "V5"],
        {"entity": "author"},
        F.lit("2024-02-01"),
    )
    return decided.select("position", "value", "status", "updatedAt")


def _authors(spark, sf):
    """Suppliers as catalogue authors with two names and the institutions of their nation."""
    nation = F.col("s_nationkey").cast("string")
    name = F.col("s_name")
    return adapters.table(spark, sf, "supplier").select(
        F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("from"),
        F.concat(F.lit("O"), (F.col("s_suppkey") % 10).cast("string")).alias("id"),
        F.array(name, F.upper(name)).alias("display_name_alternatives"),
        F.array(
            F.struct(
                F.concat(F.lit("I"), nation).alias("id"),
                F.concat(F.lit("Institution "), nation).alias("display_name"),
            )
        ).alias("affiliations"),
    )


@query(
    "f30_author_events",
    """SELECT concat('A', s_suppkey) AS "from", concat('O', s_suppkey % 10) AS id, 'author' AS entity,
              unnest(['display_name_alternatives', 'display_name_alternatives', 'affiliation']) AS field,
              unnest([s_name, upper(s_name), concat('I', s_nationkey)]) AS value,
              unnest([NULL, NULL, concat('Institution ', s_nationkey)]) AS label, 'pending' AS status FROM supplier""",
)
def f30(spark, sf):
    return reshape.author_events(_authors(spark, sf))


@query(
    "f31_work_events",
    """WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
    SELECT concat('A', l_suppkey) AS "from", concat('O', l_suppkey % 10) AS id,
      unnest(['author', 'author', 'institution', 'work']) AS entity,
      unnest(['display_name_alternatives', 'affiliation', 'display_name_alternatives', 'id']) AS field,
      unnest([upper(s_name), concat('I', s_nationkey), concat('Lab of nation ', s_nationkey), CAST(o_orderkey AS VARCHAR)]) AS value,
      unnest([s_name, concat('Institution ', s_nationkey), NULL, concat(year(o_orderdate), ' - ', o_orderpriority)]) AS label,
      'pending' AS status
    FROM l JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey""",
)
def f31(spark, sf):
    nation = F.col("s_nationkey").cast("string")
    lines = adapters.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey"
    ).distinct()
    works = (
        lines.join(adapters.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(adapters.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("from"),
            F.concat(F.lit("O"), (F.col("l_suppkey") % 10).cast("string")).alias("id"),
            F.col("o_orderkey").cast("string").alias("work_id"),
            reshape.format_reference(F.col("o_orderpriority"), F.year("o_orderdate")).alias("reference"),
            F.upper("s_name").alias("raw_author_name"),
            F.col("s_name").alias("author_name"),
            F.array(
                F.struct(
                    F.concat(F.lit("Lab of nation "), nation).alias("raw_affiliation_string"),
                    F.array(
                        F.struct(
                            F.concat(F.lit("I"), nation).alias("id"),
                            F.concat(F.lit("Institution "), nation).alias("display_name"),
                        )
                    ).alias("institutions"),
                )
            ).alias("affiliations"),
        )
    )
    return reshape.work_events(works)


# ---- identity ----------------------------------------------------------------------------
_UUID_SQL = """h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat('{"entity":"', entity,
    '","field":"', field, '","from":"', "from", '","id":"', id, '","value":"', value, '"}'))) AS d FROM review),
identified AS (SELECT *, concat(substr(d, 1, 8), '-', substr(d, 9, 4), '-5', substr(d, 14, 3), '-',
    translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(d, 18, 3), '-', substr(d, 21, 12)) AS "dataIntegrity" FROM h)"""


def _identified(spark, sf):
    return adapters.review_events(spark, sf).withColumn(
        "dataIntegrity", dedup.event_id(NAMESPACE)
    )


@query("d6_event_id", f'WITH {sql.REVIEW}, {_UUID_SQL} SELECT position, "dataIntegrity" FROM identified')
def d6(spark, sf):
    return _identified(spark, sf).select("position", "dataIntegrity")


@query(
    "d6_unique_events",
    f"""WITH {sql.REVIEW}, {_UUID_SQL}
    SELECT "dataIntegrity", position, status FROM identified
    QUALIFY row_number() OVER (PARTITION BY "dataIntegrity" ORDER BY position) = 1""",
)
def d6_unique(spark, sf):
    return dedup.unique_events(_identified(spark, sf)).select("dataIntegrity", "position", "status")


@query(
    "d7_merge_events",
    f"""WITH {sql.REVIEW}, {_UUID_SQL}, u AS (SELECT * FROM identified WHERE position % 5 = 0)
    SELECT position, "dataIntegrity" FROM identified WHERE position % 5 <> 0
      AND "dataIntegrity" NOT IN (SELECT "dataIntegrity" FROM u)
    UNION ALL SELECT position, "dataIntegrity" FROM u""",
)
def d7(spark, sf):
    events = _identified(spark, sf)
    merged = dedup.merge_events(events.where("position % 5 <> 0"), events.where("position % 5 = 0"))
    return merged.select("position", "dataIntegrity")


@query(
    "j18_carry_forward",
    f"""WITH {sql.REVIEW}, old AS (SELECT * FROM review WHERE position % 3 = 0), fresh AS (SELECT * FROM review WHERE position % 3 <> 0),
    memory AS (SELECT id, entity, field, value,
        min_by(status, position) FILTER (status IN ('accepted', 'rejected')) AS st,
        min_by(extended, position) FILTER (extended <> 'never') AS ext FROM old GROUP BY 1, 2, 3, 4)
    SELECT f.position, f.id, f.entity, f.field, f.value, coalesce(m.st, f.status) AS status, coalesce(m.ext, f.extended) AS "hasBeenExtendedAt"
    FROM fresh f LEFT JOIN memory m ON m.id = f.id AND m.entity = f.entity AND m.field = f.field AND m.value = f.value""",
)
def j18(spark, sf):
    events = adapters.review_events(spark, sf)
    carried = joins.carry_forward(events.where("position % 3 = 0"), events.where("position % 3 <> 0"))
    return carried.select("position", "id", "entity", "field", "value", "status", "hasBeenExtendedAt")


# ---- verdicts ------------------------------------------------------------------------------
@query(
    "a12_affiliation_years",
    f"""WITH {sql.REVIEW} SELECT id, coalesce(label, 'unknown') AS affiliation, value AS year, count(*) AS n FROM review
    WHERE entity = 'institution' AND field = 'publication_date' AND status = 'accepted' GROUP BY 1, 2, 3""",
)
def a12(spark, sf):
    return aggregates.affiliation_years(adapters.review_events(spark, sf))


_STATUS_SQL = ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}" for s in ("accepted", "pending", "rejected")
)
_VALUES_SQL = ", ".join(
    f"count(DISTINCT value) FILTER (status = '{s}') AS {s}" for s in ("accepted", "pending", "rejected")
)


@query(
    "a13_status_counts",
    f"WITH {sql.REVIEW} SELECT id, entity, field, {_STATUS_SQL} FROM review GROUP BY 1, 2, 3",
)
def a13(spark, sf):
    return aggregates.status_counts(adapters.review_events(spark, sf))


@query("a13_status_counts_global", f"WITH {sql.REVIEW} SELECT id, {_STATUS_SQL} FROM review GROUP BY 1")
def a13_global(spark, sf):
    return aggregates.status_counts(adapters.review_events(spark, sf), by=["id"])


@query(
    "a13_status_values",
    f"WITH {sql.REVIEW} SELECT id, entity, field, {_VALUES_SQL} FROM review GROUP BY 1, 2, 3",
)
def a13_values(spark, sf):
    return aggregates.status_counts(adapters.review_events(spark, sf), distinct_values=True)


@query(
    "a14_id_verdict",
    f"""WITH {sql.REVIEW}, f AS (SELECT id, "from",
      bool_or(field = 'affiliation' AND status = 'accepted') AS a,
      bool_or(field = 'display_name_alternatives' AND status = 'accepted') AS n,
      bool_or(entity = 'work' AND status = 'accepted') AS w,
      bool_or(status IN ('accepted', 'pending')) AS alive
      FROM review WHERE entity = 'author' OR (entity = 'work' AND field = 'id') GROUP BY 1, 2)
    SELECT id, "from", CASE WHEN a AND n AND w THEN 'accepted' WHEN alive THEN 'pending' ELSE 'rejected' END AS verdict FROM f""",
)
def a14(spark, sf):
    return aggregates.id_verdict(adapters.review_events(spark, sf))


_ID_SETS = f"""WITH {sql.REVIEW},
aff AS (SELECT DISTINCT id, "from", status FROM review WHERE entity = 'author' AND field = 'affiliation'),
nam AS (SELECT DISTINCT id, "from", status FROM review WHERE entity = 'author' AND field = 'display_name_alternatives'),
wrk AS (SELECT DISTINCT id, "from" FROM review WHERE entity = 'work' AND field = 'id' AND status = 'accepted'),
acc AS ((SELECT id, "from" FROM aff WHERE status = 'accepted' INTERSECT SELECT id, "from" FROM nam WHERE status = 'accepted')
        UNION SELECT id, "from" FROM wrk),
pen AS ((SELECT id, "from" FROM aff WHERE status <> 'rejected' UNION SELECT id, "from" FROM nam WHERE status <> 'rejected')
        EXCEPT SELECT id, "from" FROM acc),
rej AS ((SELECT id, "from" FROM aff UNION SELECT id, "from" FROM nam)
        EXCEPT (SELECT id, "from" FROM acc UNION SELECT id, "from" FROM pen))"""


@query("u3_accepted_ids", f'{_ID_SETS} SELECT id, "from" FROM acc')
def u3(spark, sf):
    return sets.accepted_ids(adapters.review_events(spark, sf))


@query("u4_pending_ids", f'{_ID_SETS} SELECT id, "from" FROM pen')
def u4(spark, sf):
    return sets.pending_ids(adapters.review_events(spark, sf))


@query("u5_rejected_ids", f'{_ID_SETS} SELECT id, "from" FROM rej')
def u5(spark, sf):
    return sets.rejected_ids(adapters.review_events(spark, sf))


@query("u6_ids_from_works", f'{_ID_SETS} SELECT id, "from" FROM wrk')
def u6(spark, sf):
    return sets.ids_from_works(adapters.review_events(spark, sf))


@query(
    "u7_accepted_values",
    f"""WITH {sql.REVIEW} SELECT DISTINCT 'aliases' AS what, id, value FROM review
      WHERE entity = 'author' AND field = 'display_name_alternatives' AND status = 'accepted'
    UNION ALL SELECT DISTINCT 'affiliations', id, value FROM review
      WHERE entity = 'author' AND field = 'affiliation' AND status = 'accepted'
    UNION ALL SELECT DISTINCT 'institution_aliases', id, value FROM review
      WHERE entity = 'institution' AND field = 'display_name_alternatives' AND status = 'accepted'
    UNION ALL SELECT DISTINCT 'works', id, value FROM review WHERE entity = 'work' AND field = 'id' AND status = 'accepted'""",
)
def u7(spark, sf):
    events = adapters.review_events(spark, sf)
    out = None
    for name in ("aliases", "affiliations", "institution_aliases", "works"):
        part = sets.accepted(events, name).select(F.lit(name).alias("what"), "id", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "u7_status_of",
    f"""WITH {sql.REVIEW} SELECT id, value, min_by(status, position) AS status FROM review
    WHERE entity = 'author' AND field = 'affiliation' GROUP BY 1, 2""",
)
def u7_status(spark, sf):
    return sets.status_of(adapters.review_events(spark, sf), "affiliations")


@query(
    "u7_has_pending",
    f"""WITH {sql.REVIEW} SELECT count(*) > 0 AS found FROM review WHERE entity = 'work' AND status = 'pending'""",
)
def u7_has(spark, sf):
    return sets.has_events(adapters.review_events(spark, sf), entity="work", status="pending")


@query(
    "u7_names_to_extend",
    f"""WITH {sql.REVIEW} SELECT position, id, value FROM review WHERE entity = 'author'
    AND field = 'display_name_alternatives' AND status = 'accepted' AND extended = 'never'""",
)
def u7_extend(spark, sf):
    return sets.to_extend(adapters.review_events(spark, sf)).select("position", "id", "value")


@query(
    "review_resolution",
    f"""{_ID_SETS} SELECT id, "from", 'accepted' AS resolution FROM acc UNION ALL SELECT id, "from", 'pending' FROM pen
    UNION ALL SELECT id, "from", 'rejected' FROM rej""",
)
def resolution(spark, sf):
    return review.resolve(adapters.review_events(spark, sf))
