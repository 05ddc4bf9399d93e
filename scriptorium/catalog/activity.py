"""Queries over activity logs, commits and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.base import query
from scriptorium.functions import text
from scriptorium.operators import aggregates, dedup, joins, reshape, windows
from scriptorium.plans import adapters, logs as log_plans

_COUNTERS = """count(*) AS actions_total,
  count(*) FILTER (user_type = 'enquêté') AS actions_surveyed_user,
  count(*) FILTER (action_category = 'Enregistrements') AS actions_records,
  count(*) FILTER (action_category = 'Questionnaires') AS actions_surveys,
  count(*) FILTER (action_category = 'Fichiers') AS actions_files,
  count(*) FILTER (action_category = 'Projet') AS actions_project,
  count(*) FILTER (action_category = 'Utilisateurs') AS actions_users,
  count(*) FILTER (action_category = 'API') AS actions_api,
  count(*) FILTER (action_category = 'Authentification') AS actions_auth,
  count(*) FILTER (action_category = 'Autre') AS actions_other"""
_PEOPLE = """count(DISTINCT CASE WHEN user_type = 'loggé' THEN username END) AS users_logged,
  count(DISTINCT CASE WHEN user_type = 'enquêté' THEN respondent END) AS users_surveyed,
  count(DISTINCT project_id) AS projects_active"""


def _cleaned(spark, sf):
    return reshape.clean_logs(adapters.raw_logs(spark, sf))


@query("f18_user_type", f"WITH {sql.LOGS} SELECT position, username, user_type FROM logs")
def f18(spark, sf):
    raw = adapters.raw_logs(spark, sf).withColumn("username", F.trim(F.lower("username")))
    return raw.select("position", "username", text.user_type(F.col("username")).alias("user_type"))


@query("f19_action_category", f"WITH {sql.LOGS} SELECT position, action, action_category FROM logs")
def f19(spark, sf):
    return adapters.raw_logs(spark, sf).select(
        "position", "action", text.action_category(F.col("action")).alias("action_category")
    )


@query(
    "f20_clean_logs",
    f"""WITH {sql.LOGS} SELECT position, project_id, username, action, user_type, action_category,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS timestamp FROM logs""",
)
def f20(spark, sf):
    return _cleaned(spark, sf).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS")
    )


@query("f21_respondent_id", f"WITH {sql.LOGS} SELECT position, respondent FROM logs")
def f21(spark, sf):
    return _cleaned(spark, sf).select(
        "position", text.respondent_id(F.col("action"), F.col("username")).alias("respondent")
    )


@query(
    "d5_dedupe_logs",
    f"""WITH {sql.LOGS} SELECT project_id, username, action, max(position) AS position
    FROM logs GROUP BY project_id, date_trunc('day', ts), username, action""",
)
def d5(spark, sf):
    # Whole days stand in for milliseconds so that the data holds duplicates.
    by_day = _cleaned(spark, sf).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return dedup.dedupe_logs(by_day).select("project_id", "username", "action", "position")


def _calendar_sql(grain: str) -> str:
    return f"""WITH {sql.LOGS}, p AS (
      SELECT CAST(CAST(date_trunc('{grain}', ts) AS DATE) AS VARCHAR) AS date, {_COUNTERS}, {_PEOPLE}
      FROM logs GROUP BY 1)
    SELECT *, users_logged + users_surveyed AS users_total FROM p"""


def _calendar(grain: str):
    def run(spark, sf):
        return aggregates.calendar_kpis(_cleaned(spark, sf), grain).withColumn(
            "date", F.col("date").cast("string")
        )

    return run


for _grain in ("day", "week", "month", "quarter"):
    query(f"a10_calendar_kpis_{_grain}", _calendar_sql(_grain))(_calendar(_grain))


@query(
    "a10_calendar_kpis_rollup",
    f"""WITH {sql.LOGS}, p AS (
      SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS date, {_COUNTERS}, {_PEOPLE} FROM logs GROUP BY 1
      UNION ALL SELECT NULL, {_COUNTERS}, {_PEOPLE} FROM logs)
    SELECT *, users_logged + users_surveyed AS users_total FROM p""",
)
def a10_rollup(spark, sf):
    return aggregates.calendar_kpis(_cleaned(spark, sf), "week", rollup=True).withColumn(
        "date", F.col("date").cast("string")
    )


@query(
    "a11_distinct_respondents",
    f"""WITH {sql.LOGS} SELECT project_id, count(DISTINCT respondent) AS respondents
    FROM logs WHERE user_type = 'enquêté' GROUP BY 1""",
)
def a11(spark, sf):
    return log_plans.respondents_per_project(_cleaned(spark, sf))


def rolling_sql(until: str) -> str:
    """Points over 30 days at the midnights from the first day + 30 to ``until``."""
    return f"""WITH {sql.ORDER_LOGS}, days AS (
      SELECT unnest(generate_series(CAST(min(ts) AS DATE) + INTERVAL 30 DAY, CAST({until} AS DATE), INTERVAL 1 DAY)) AS t FROM logs),
    p AS (SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS date, {_COUNTERS}, {_PEOPLE}
          FROM days JOIN logs ON ts > t - INTERVAL 30 DAY AND ts <= t GROUP BY 1)
    SELECT *, users_logged + users_surveyed AS users_total FROM p"""


@query("w6_rolling_kpis", rolling_sql("max(ts)"))
def w6(spark, sf):
    return windows.rolling_kpis(reshape.clean_logs(adapters.order_logs(spark, sf))).withColumn(
        "date", F.col("date").cast("string")
    )


@query(
    "f34_unpivot_actions",
    f"""WITH {sql.LOGS}, p AS (SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS date, {_COUNTERS} FROM logs GROUP BY 1)
    SELECT date, category, value FROM (
      UNPIVOT (SELECT * EXCLUDE (actions_total, actions_surveyed_user) FROM p)
      ON COLUMNS(* EXCLUDE date) INTO NAME category VALUE value)""",
)
def f34(spark, sf):
    points = aggregates.calendar_kpis(_cleaned(spark, sf), "day").withColumn(
        "date", F.col("date").cast("string")
    )
    return reshape.unpivot_actions(points)


# ---- commits and code --------------------------------------------------------------------
@query(
    "a20_commits_by_hour",
    f"""WITH {sql.COMMITS} SELECT strftime(ts, '%Y-%m-%dT%H') AS period, count(*) AS commits,
    CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
    CAST(sum(files_changed) AS BIGINT) AS files_changed,
    string_agg(DISTINCT author, ',' ORDER BY author) AS authors FROM commits GROUP BY 1""",
)
def a20(spark, sf):
    hourly = aggregates.commits_by_hour(adapters.commits(spark, sf))
    return hourly.withColumn("authors", F.array_join("authors", ","))


@query(
    "a21_commit_totals",
    f"""WITH {sql.COMMITS} SELECT CAST(sum(additions) AS BIGINT) AS total_additions,
    CAST(sum(deletions) AS BIGINT) AS total_deletions, CAST(sum(files_changed) AS BIGINT) AS total_files_changed,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_commit, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_commit FROM commits""",
)
def a21(spark, sf):
    totals = aggregates.commit_totals(adapters.commits(spark, sf))
    for name in ("first_commit", "last_commit"):
        totals = totals.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return totals


@query(
    "f26_parse_numstat",
    """SELECT concat('src/', p_partkey, '.ts') AS path,
       CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size % 10 END AS additions,
       CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size % 4 END AS deletions,
       CASE WHEN p_size % 7 = 0 THEN 'modified'
            WHEN p_size % 10 > 0 AND p_size % 4 = 0 THEN 'added'
            WHEN p_size % 10 = 0 AND p_size % 4 > 0 THEN 'deleted' ELSE 'modified' END AS status
       FROM part WHERE p_partkey % 9 <> 0""",
)
def f26(spark, sf):
    size = F.col("p_size")
    lines = adapters.table(spark, sf, "part").select(
        F.concat_ws(
            "\t",
            F.when(size % 7 == 0, "-").otherwise((size % 10).cast("string")),
            F.when(size % 7 == 0, "-").otherwise((size % 4).cast("string")),
            # Every ninth line is malformed: no path.
            F.when(
                F.col("p_partkey") % 9 != 0,
                F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".ts")),
            ),
        ).alias("value")
    )
    return reshape.parse_numstat(lines)


_CODE = """concat(repeat(concat('export const A', page_id, ' = 1; export type T = {}; '), CAST(page_id % 4 AS INT)),
  repeat('describe("d", () => { it("works", f); test(''x'', g); }); ', CAST(page_id % 3 AS INT)), html)"""
_PATHS = """CASE page_id % 4 WHEN 0 THEN concat('a', page_id, '.ts') WHEN 1 THEN concat('a', page_id, '.test.ts')
  WHEN 2 THEN concat('a', page_id, '.d.ts') ELSE concat('a', page_id, '.spec.ts') END"""


def _code_files(spark, sf):
    page = F.col("page_id").cast("string")
    rest = F.col("page_id") % 4
    path = (
        F.when(rest == 0, F.concat(F.lit("a"), page, F.lit(".ts")))
        .when(rest == 1, F.concat(F.lit("a"), page, F.lit(".test.ts")))
        .when(rest == 2, F.concat(F.lit("a"), page, F.lit(".d.ts")))
        .otherwise(F.concat(F.lit("a"), page, F.lit(".spec.ts")))
    )
    source = F.repeat(
        F.concat(F.lit("export const A"), page, F.lit(" = 1; export type T = {}; ")), rest.cast("int")
    )
    tests = F.repeat(
        F.lit("describe(\"d\", () => { it(\"works\", f); test('x', g); }); "),
        (F.col("page_id") % 3).cast("int"),
    )
    return adapters.table(spark, sf, "pages").select(
        path.alias("path"), F.concat(source, tests, "html").alias("content"), "page_id"
    )


@query(
    "f25_code_counts",
    f"""WITH files AS (SELECT {_PATHS} AS path, {_CODE} AS content, page_id FROM pages),
    k AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'source' WHEN 2 THEN 'other' ELSE 'test' END AS kind FROM files)
    SELECT path, kind,
      CASE WHEN kind = 'source' THEN len(regexp_extract_all(content, 'export\\s+const\\s+\\w+\\s*[=:]')) ELSE 0 END AS constants,
      CASE WHEN kind = 'source' THEN len(regexp_extract_all(content, 'export\\s+(?:const\\s+\\w+\\s*=\\s*(?:async\\s*)?\\([^)]*\\)\\s*(?::[^=]+)?=>|function\\s+\\w+)')) ELSE 0 END AS functions,
      CASE WHEN kind = 'source' THEN len(regexp_extract_all(content, 'export\\s+(?:type|interface)\\s+\\w+')) ELSE 0 END AS types,
      CASE WHEN kind = 'test' THEN len(regexp_extract_all(content, 'describe\\s*\\(\\s*[''"`]')) ELSE 0 END AS describes,
      CASE WHEN kind = 'test' THEN len(regexp_extract_all(content, '(?:it|test)\\s*\\(\\s*[''"`]')) ELSE 0 END AS tests
    FROM k""",
)
def f25(spark, sf):
    return reshape.code_counts(_code_files(spark, sf).drop("page_id"))


@query(
    "j21_code_delta",
    """WITH s AS (SELECT l_suppkey AS module, l_linestatus AS side, count(*) AS files, CAST(sum(l_quantity) AS BIGINT) AS constants
                  FROM lineitem GROUP BY 1, 2),
    j AS (SELECT coalesce(b.module, a.module) AS module, coalesce(a.files, 0) - coalesce(b.files, 0) AS f,
                 coalesce(a.constants, 0) - coalesce(b.constants, 0) AS c
          FROM (SELECT * FROM s WHERE side = 'F') b FULL JOIN (SELECT * FROM s WHERE side = 'O') a ON a.module = b.module)
    SELECT module, greatest(f, 0) AS added_files, greatest(c, 0) AS added_constants,
           greatest(-f, 0) AS deleted_files, greatest(-c, 0) AS deleted_constants FROM j""",
)
def j21(spark, sf):
    state = (
        adapters.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("module"), "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("l_quantity").cast("bigint").alias("constants"),
        )
    )
    return joins.code_delta(
        state.where("l_linestatus = 'F'"),
        state.where("l_linestatus = 'O'"),
        ["module"],
        ["files", "constants"],
    )


# ---- packages ------------------------------------------------------------------------------
_TODAY = "2000-09-30"
_PACKAGE_SQL = f"""packages AS (
  SELECT concat('@scope/pkg-', c_custkey) AS name, c_mktsegment AS version, DATE '2000-08-01' + CAST(c_custkey % 400 AS INT) AS date FROM customer),
periods AS (SELECT unnest(['day', 'week', 'month', 'quarter']) AS period, DATE '{_TODAY}' + 1 - unnest([1, 7, 30, 90]) AS d),
downloads AS (SELECT concat('@scope/pkg-', o_custkey) AS name, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS BIGINT) AS downloads
  FROM orders GROUP BY 1, 2),
rows AS (SELECT period, d, p.name, p.version, p.date, CAST(coalesce(sum(x.downloads), 0) AS BIGINT) AS total,
    coalesce(string_agg(concat(x.day, '=', x.downloads), ' ' ORDER BY x.day) FILTER (x.day IS NOT NULL), '') AS points
  FROM packages p CROSS JOIN periods LEFT JOIN downloads x ON x.name = p.name AND x.day >= d GROUP BY ALL)"""


def _stats(spark, sf):
    return aggregates.package_stats(
        adapters.releases(spark, sf),
        adapters.packages(spark, sf),
        adapters.downloads(spark, sf),
        F.lit(_TODAY).cast("date"),
    )


@query(
    "a18_package_kpi",
    f"""WITH {_PACKAGE_SQL}
    SELECT period, count(*) AS packages_total, count(*) FILTER (date >= d) AS packages_active, CAST(sum(total) AS BIGINT) AS downloads_total,
           (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) >= d) AS releases FROM rows GROUP BY period, d""",
)
def a18_kpi(spark, sf):
    return _stats(spark, sf)[0]


@query(
    "a18_package_rows",
    f"""WITH {_PACKAGE_SQL} SELECT period, name, version, CAST(date AS VARCHAR) AS last_published_at,
    total AS total_downloads, points FROM rows""",
)
def a18_rows(spark, sf):
    rows = _stats(spark, sf)[1]
    points = F.transform("daily_downloads", lambda p: F.concat_ws("=", p["day"].cast("string"), p["downloads"].cast("string")))
    return rows.select(
        "period", "name", "version", F.col("last_published_at").cast("string").alias("last_published_at"),
        "total_downloads", F.array_join(points, " ").alias("points"),
    )


@query(
    "a19_release_counts",
    """SELECT concat('@scope/pkg-', o_custkey) AS name, count(*) AS releases FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def a19(spark, sf):
    return aggregates.release_counts(adapters.releases(spark, sf), adapters.packages(spark, sf))
