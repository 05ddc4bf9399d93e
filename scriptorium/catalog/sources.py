"""Queries over scans, selections, sinks and manifests.

Where a reader or writer is the point, the query writes rows of the driver tables to the
session's shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.catalog import sql
from scriptorium.catalog.base import query
from scriptorium.plans import adapters
from scriptorium.session import scratch_path
from scriptorium.sources import scans, selection, sinks, synth


@query(
    "s1_scan_works",
    f"""WITH {sql.WORKS}, {sql.AFFILIATIONS} SELECT CAST(w.work_id AS VARCHAR) AS work_id, publication_year, count(a.work_id) AS n_authorships
    FROM works w LEFT JOIN affiliations a ON a.work_id = w.work_id WHERE publication_year >= 1998 GROUP BY 1, 2""",
)
def s1(spark, sf):
    path = scratch_path(spark, "lake")
    adapters.nested_works(spark, sf).write.parquet(path)
    works = scans.scan_works(spark, path, ["work_id", "publication_year", "authorships"])
    return works.where("publication_year >= 1998").select(
        "work_id",
        "publication_year",
        F.coalesce(F.greatest(F.size("authorships"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_authorships"),
    )


def _written_runs(spark, sf):
    """All orders as runs of their months: run a of every month, without a status column before
    1998-02, and from then on a second run b of the orders with an even key."""
    root = scratch_path(spark, "runs")
    orders = adapters.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("work_id"),
        F.col("o_totalprice").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM").alias("m"),
        "o_orderstatus",
    )

    def write(rows, run):
        placed = rows.withColumnRenamed("m", "dt").withColumn("run", F.lit(run))
        placed.repartition("dt").sortWithinPartitions("work_id").write.mode("append").partitionBy("dt", "run").parquet(root)

    write(orders.where("m < '1998-02'").drop("o_orderstatus"), "a")
    write(orders.where("m >= '1998-02'"), "a")
    write(orders.where("m >= '1998-02' and work_id % 2 = 0"), "b")
    return root


@query(
    "s2_scan_runs",
    """WITH o AS (SELECT o_orderkey AS work_id, o_orderstatus, strftime(o_orderdate, '%Y-%m') AS m FROM orders)
    SELECT work_id, m AS dt, 'a' AS run, CASE WHEN m >= '1998-02' THEN o_orderstatus END AS o_orderstatus, true AS named FROM o
    UNION ALL SELECT work_id, m, 'b', o_orderstatus, true FROM o WHERE m >= '1998-02' AND work_id % 2 = 0""",
)
def s2(spark, sf):
    runs = scans.scan_runs(spark, _written_runs(spark, sf))
    return runs.select(
        "work_id",
        F.col("dt").cast("string").alias("dt"),
        "run",
        "o_orderstatus",
        F.col("filename").endswith(".parquet").alias("named"),
    )


@query(
    "s3_scan_jsonl",
    """SELECT event_id, user_id, round(value, 2) AS value, props FROM events""",
)
def s3(spark, sf):
    path = scratch_path(spark, "jsonl")
    events = adapters.table(spark, sf, "events").select("event_id", "user_id", F.round("value", 2).alias("value"), "props")
    events.write.option("compression", "gzip").json(path)
    return scans.scan_jsonl(spark, path, events.schema)


def _file_lines(spark, sf):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    kind = F.when(F.col("event_id") % 3 == 0, ".gkg.csv.zip").when(
        F.col("event_id") % 3 == 1, ".export.CSV.zip"
    ).otherwise(".mentions.CSV.zip")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.md5(stamp), F.concat(F.lit("http://data.example/"), stamp, kind))
    return adapters.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 50 == 0, F.lit("broken")).otherwise(line).alias("value")
    )


_LIST_SQL = """list AS (SELECT strftime(ts, '%Y%m%d%H%M%S') AS timestamp, concat('http://data.example/', strftime(ts, '%Y%m%d%H%M%S'), '.gkg.csv.zip') AS url
  FROM events WHERE event_id % 3 = 0 AND event_id % 50 <> 0)"""


@query("s6_parse_file_list", f"WITH {_LIST_SQL} SELECT timestamp, url FROM list")
def s6(spark, sf):
    return selection.parse_file_list(_file_lines(spark, sf))


@query(
    "s7_files_in_day",
    f"""WITH {_LIST_SQL} SELECT timestamp, url, (SELECT count(*) FROM list WHERE timestamp LIKE '20240105%') > 12 AS truncated
    FROM list WHERE timestamp LIKE '20240105%' ORDER BY timestamp, url LIMIT 12""",
)
def s7(spark, sf):
    return selection.files_in_day(selection.parse_file_list(_file_lines(spark, sf)), "2024-01-05", 12)


def _partitions(spark, sf):
    return (
        adapters.table(spark, sf, "orders")
        .select(F.concat(F.lit("updated_date="), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("partition"))
        .distinct()
    )


@query(
    "s8_partitions_after",
    """SELECT DISTINCT concat('updated_date=', strftime(o_orderdate, '%Y-%m-%d')) AS partition FROM orders
       WHERE strftime(o_orderdate, '%Y-%m-%d') > '1998-06-01' ORDER BY 1 LIMIT 25""",
)
def s8(spark, sf):
    return selection.partitions_after(_partitions(spark, sf), "1998-06-01", 25)


@query(
    "s9_merged_ids_after",
    """WITH n AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1998-01-01'),
    c AS (SELECT date FROM n ORDER BY date LIMIT 10)
    SELECT concat(date, '.csv.gz') AS name, date, (SELECT max(date) FROM c) AS next_after FROM c""",
)
def s9(spark, sf):
    files = (
        adapters.table(spark, sf, "orders")
        .select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".csv.gz")).alias("name"))
        .distinct()
    )
    return selection.merged_ids_after(files, "1998-01-01", 10)


@query(
    "s10_partition_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""",
)
def s10(spark, sf):
    name = F.concat(F.lit("updated_date="), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey", selection.partition_date(name).alias("date")
    )


@query(
    "s11_months_to_collect",
    """WITH m AS (SELECT max(o_orderdate) AS last FROM orders)
    SELECT strftime(unnest(generate_series(date_trunc('month', last) - INTERVAL 10 MONTH, date_trunc('month', last) - INTERVAL 1 MONTH, INTERVAL 1 MONTH)), '%Y%m') AS month FROM m""",
)
def s11(spark, sf):
    from scriptorium.functions import calendar

    day = F.to_date("last")
    row = (
        adapters.table(spark, sf, "orders")
        .agg(F.max("o_orderdate").alias("last"))
        .select(
            calendar.last_complete_month(day).alias("until"),
            calendar.month_key(F.add_months(day, -11)).alias("after"),
        )
        .first()
    )
    return selection.months_to_collect(spark, row["after"], row["until"])


@query(
    "s12_watermarks",
    """SELECT 'authors' AS key, CAST(count(*) AS VARCHAR) AS value FROM supplier
       UNION ALL SELECT 'works', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders""",
)
def s12(spark, sf):
    root = scratch_path(spark, "watermarks")
    last = adapters.table(spark, sf, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).first()[0]
    selection.advance_watermark(spark, root, "works", "1990-01-01")
    selection.advance_watermark(spark, root, "authors", str(adapters.table(spark, sf, "supplier").count()))
    selection.advance_watermark(spark, root, "works", last)
    return selection.read_watermarks(spark, root).select("key", "value")


@query(
    "s13_latest_run_per_dt",
    f"WITH {sql.FILES} SELECT dt, run FROM runs QUALIFY row_number() OVER (PARTITION BY dt ORDER BY modified DESC, run DESC) = 1",
)
def s13(spark, sf):
    return selection.latest_run_per_dt(adapters.run_files(spark, sf))


@query(
    "s14_previous_run",
    f"""WITH {sql.FILES}, one AS (SELECT run, modified FROM runs),
    cur AS (SELECT max(modified) AS m FROM one WHERE run = 'r7')
    SELECT run FROM one, cur WHERE run <> 'r7' AND (modified < m OR (modified = m AND run < 'r7')) ORDER BY modified DESC, run DESC LIMIT 1""",
)
def s14(spark, sf):
    return selection.previous_run(adapters.run_files(spark, sf), "r7")


@query(
    "s15_read_latest",
    """WITH o AS (SELECT o_orderkey AS work_id, strftime(o_orderdate, '%Y-%m') AS dt FROM orders),
    second AS (SELECT DISTINCT dt FROM o WHERE dt >= '1998-02' AND work_id % 2 = 0)
    SELECT work_id, dt, 'a' AS run FROM o WHERE dt NOT IN (SELECT dt FROM second)
    UNION ALL SELECT work_id, dt, 'b' FROM o WHERE dt >= '1998-02' AND work_id % 2 = 0""",
)
def s15(spark, sf):
    rows = selection.read_latest(spark, _written_runs(spark, sf))
    return rows.select("work_id", F.col("dt").cast("string").alias("dt"), "run")


@query(
    "s16_ingested_partitions",
    "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS dt FROM orders",
)
def s16(spark, sf):
    return selection.ingested_partitions(adapters.run_files(spark, sf))


@query(
    "s17_plan_batches",
    """WITH RECURSIVE f AS (SELECT c_nationkey AS folder, c_custkey AS file, CAST(floor(abs(c_acctbal)) AS BIGINT) AS num_rows,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer),
    b AS (SELECT folder, file, num_rows, rn, CAST(0 AS INT) AS batch, num_rows AS held FROM f WHERE rn = 1
      UNION ALL SELECT f.folder, f.file, f.num_rows, f.rn, CASE WHEN b.held > 0 AND b.held + f.num_rows > 20000 THEN b.batch + 1 ELSE b.batch END,
        CASE WHEN b.held > 0 AND b.held + f.num_rows > 20000 THEN f.num_rows ELSE b.held + f.num_rows END
      FROM b JOIN f ON f.folder = b.folder AND f.rn = b.rn + 1)
    SELECT CAST(folder AS INT) AS folder, file, num_rows, batch FROM b""",
)
def s17(spark, sf):
    files = adapters.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("folder"),
        F.col("c_custkey").alias("file"),
        F.floor(F.abs("c_acctbal")).alias("num_rows"),
    )
    return selection.plan_batches(files, ["folder"], 20_000)


@query("s18_file_inventory", "SELECT 'orders.parquet' AS file, count(*) AS num_rows FROM orders")
def s18(spark, sf):
    found = selection.file_inventory(adapters.table(spark, sf, "orders"))
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "num_rows")


@query(
    "s19_sample_files",
    """WITH f AS (SELECT c_nationkey AS folder, c_custkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i,
        greatest(count(*) OVER (PARTITION BY c_nationkey) // 7, 1) AS step FROM customer)
    SELECT folder, file FROM f WHERE i % step = 0 AND i < step * 7""",
)
def s19(spark, sf):
    files = adapters.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("folder"), F.col("c_custkey").alias("file")
    )
    return selection.sample_files(files, 7, ["folder"])


# ---- sinks ---------------------------------------------------------------------------------
@query("s20_write_run", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s20(spark, sf):
    root = scratch_path(spark, "sink")
    orders = adapters.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = sinks.write_run(orders, root, "1998-01", "r1", ["o_orderkey"])
    return spark.read.schema(orders.schema).parquet(path)


@query(
    "s21_write_by_month",
    """SELECT strftime(o_orderdate, '%Y%m') AS dt, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1""",
)
def s21(spark, sf):
    root = scratch_path(spark, "months")
    rows = adapters.table(spark, sf, "orders").select(
        "o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("month")
    )
    sinks.write_by_month(rows, root, order=["o_custkey"])
    return spark.read.parquet(root).groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total")
    )


@query(
    "s22_write_native",
    """SELECT CAST(event_id AS VARCHAR) AS gkg_record_id, strftime(ts, '%Y%m%d%H%M%S') AS v21_date, CAST(27 AS INT) AS n_columns FROM events""",
)
def s22(spark, sf):
    path = scratch_path(spark, "native")
    sinks.write_native(adapters.native_news(spark, sf), path)
    native = spark.read.parquet(path)
    return native.select("gkg_record_id", "v21_date", F.lit(len(native.columns)).alias("n_columns"))


def _manifested(spark, sf):
    root = scratch_path(spark, "mart")
    orders = adapters.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    sinks.write_run(orders.repartition(3, "o_orderkey"), root, "1998-01", "r1", ["o_orderkey"])
    manifest = sinks.build_manifest(spark, root, "1998-01", "r1", "2024-01-01T00:00:00Z")
    sinks.write_manifest(manifest, root, "1998-01", "r1")
    return root


@query(
    "s23_build_manifest",
    """SELECT 'dt=1998-01/run=r1' AS partition, 1 AS schema_version, count(*) AS row_count, CAST(3 AS INT) AS n_parts, true AS hashed FROM orders""",
)
def s23(spark, sf):
    manifest = sinks.read_manifest(spark, _manifested(spark, sf), "1998-01", "r1")
    return manifest.select(
        "partition",
        "schema_version",
        "row_count",
        F.size("parts").alias("n_parts"),
        F.forall("parts", lambda p: F.length(p["sha256"]) == 64).alias("hashed"),
    )


@query(
    "s24_verify_manifest",
    """SELECT 'r2' AS run, 'unknown_version' AS kind, '9' AS detail
       UNION ALL SELECT 'r2', 'row_count', CAST(count(*) + 1 AS VARCHAR) FROM orders
       UNION ALL SELECT 'r2', 'missing_part', 'gone.parquet' UNION ALL SELECT 'r2', 'hash_mismatch', 'a part'
       UNION ALL SELECT 'r3', 'no_parts', ''""",
)
def s24(spark, sf):
    """A whole run, one with a fault of every kind that goes with parts, and one without parts."""
    root = _manifested(spark, sf)
    orders = adapters.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    for run in ("r2", "r3"):
        sinks.write_run(orders.repartition(3, "o_orderkey"), root, "1998-01", run, ["o_orderkey"])
        manifest = sinks.build_manifest(spark, root, "1998-01", run, "2024-01-01T00:00:00Z")
        if run == "r2":
            faulty = F.transform(
                "parts",
                lambda p, i: F.struct(
                    F.when(i == 0, F.lit("dt=1998-01/run=r2/gone.parquet")).otherwise(p["key"]).alias("key"),
                    F.when(i == 1, F.lit("00")).otherwise(p["sha256"]).alias("sha256"),
                    p["bytes"].alias("bytes"),
                ),
            )
            changes = {"schema_version": F.lit(9), "row_count": F.col("row_count") + 1, "parts": faulty}
        else:
            changes = {"parts": F.filter("parts", lambda p: F.lit(False))}
        sinks.write_manifest(manifest.withColumns(changes), root, "1998-01", run)
    found = [
        sinks.verify_manifest(spark, root, "1998-01", run).select(F.lit(run).alias("run"), "kind", "detail")
        for run in ("r1", "r2", "r3")
    ]
    # Part files have random names.
    named = F.when(F.col("kind") == "hash_mismatch", F.lit("a part")).otherwise(F.col("detail"))
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("detail", named)


@query(
    "s25_load_partition",
    """SELECT o_orderkey AS researcher_id, '1998-01' AS dt, 'r1' AS run FROM orders WHERE o_orderkey % 2 = 0
       UNION ALL SELECT o_orderkey, '1998-02', 'r1' FROM orders""",
)
def s25(spark, sf):
    target = scratch_path(spark, "serving")
    rows = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("author_id"))
    sinks.load_partition(rows, target, "1998-01", "r1")
    sinks.load_partition(rows, target, "1998-02", "r1")
    sinks.load_partition(rows.where("author_id % 2 = 0"), target, "1998-01", "r1")
    return spark.read.parquet(target).select(
        "researcher_id", F.col("dt").cast("string").alias("dt"), "run"
    )


@query(
    "s26_upsert",
    """SELECT c_custkey AS researcher_id, CASE WHEN c_custkey % 3 = 0 THEN concat('new ', c_name) ELSE c_name END AS doc, c_acctbal AS score FROM customer
       WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""",
)
def s26(spark, sf):
    target = scratch_path(spark, "index")
    customers = adapters.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("researcher_id"), F.col("c_name").alias("doc"), F.col("c_acctbal").alias("score")
    )
    stored = customers.where("researcher_id % 2 = 0")
    fresh = customers.where("researcher_id % 3 = 0").withColumn("doc", F.concat(F.lit("new "), "doc"))
    sinks.load_partition(stored, target, "1998-01", "r1", {})
    keyed = fresh.withColumn("dt", F.lit("1998-01")).withColumn("run", F.lit("r1"))
    sinks.upsert(keyed, target, ["researcher_id", "dt", "run"], ["doc", "score"])
    return spark.read.parquet(target).select("researcher_id", "doc", "score")


@query(
    "s27_cache_modes",
    """SELECT unnest(['full', 'bounded', 'ephemeral', 'odd']) AS mode, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders""",
)
def s27(spark, sf):
    orders = adapters.table(spark, sf, "orders").where("o_totalprice > 0")
    out = None
    for mode in ("full", "bounded", "ephemeral", "odd"):
        with sinks.with_cache(orders, mode) as cached:
            part = cached.agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total")).select(
                F.lit(mode).alias("mode"), "n", "total"
            )
        out = part if out is None else out.unionByName(part)
    return out


# ---- CSV sources -----------------------------------------------------------------------------
@query(
    "s28_scan_researchers",
    """SELECT CAST(c_custkey AS VARCHAR) AS userid, c_name AS last_name, '' AS middle_name, c_mktsegment AS first_name,
       CASE WHEN c_custkey % 2 = 0 THEN concat('0000-', c_custkey) ELSE '' END AS orcid, '' AS oa_imported_at, '' AS oa_locked_at, '' AS openalex_complete FROM customer""",
)
def s28(spark, sf):
    path = scratch_path(spark, "researchers")
    key = F.col("c_custkey").cast("string")
    adapters.table(spark, sf, "customer").select(
        key.alias("userid"),
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("last_name"),
        F.lit("").alias("middle_name"),
        F.col("c_mktsegment").alias("first_name"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0000-"), key)).alias("orcid"),
    ).write.option("header", "true").csv(path)
    return scans.scan_researchers(spark, path)


def _dictionary(spark, sf):
    """A data dictionary with one field per product, written as export CSV."""
    path = scratch_path(spark, "dictionary")
    key = F.col("p_partkey").cast("string")
    kinds = ("text", "radio", "checkbox", "slider", "descriptive", "yesno")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 6 + 1).cast("int"))
    adapters.table(spark, sf, "part").select(
        F.concat(F.lit("f"), key).alias("Variable / Field Name"),
        F.lower("p_type").alias("Form Name"),
        kind.alias("Field Type"),
        F.col("p_name").alias("Field Label"),
        F.when(kind.isin("radio", "checkbox"), F.concat(F.lit("1, "), "p_brand", F.lit(" | 2, Two, or more | x"))).alias(
            "Choices, Calculations, OR Slider Labels"
        ),
        F.when(F.col("p_partkey") % 12 == 0, "date_ymd").alias("Text Validation Type OR Show Slider Number"),
        F.lit("ignored").alias("Something Else"),
    ).write.option("header", "true").csv(path)
    return scans.scan_dictionary(spark, path)


@query(
    "s29_scan_dictionary",
    """SELECT concat('f', p_partkey) AS field_name, lower(p_type) AS form_name, ['text', 'radio', 'checkbox', 'slider', 'descriptive', 'yesno'][CAST(p_partkey % 6 + 1 AS INT)] AS field_type,
       CASE WHEN p_partkey % 6 IN (1, 2) THEN concat('1=', p_brand, '|2=Two, or more|x=x') ELSE '' END AS choices,
       CASE WHEN p_partkey % 12 = 0 THEN 'date_ymd' END AS validation FROM part""",
)
def s29(spark, sf):
    return _dictionary(spark, sf).select(
        "field_name",
        "form_name",
        "field_type",
        F.array_join(F.transform("choices", lambda c: F.concat_ws("=", c["code"], c["label"])), "|").alias("choices"),
        F.col("text_validation_type_or_show_slider_number").alias("validation"),
    )


@query(
    "s30_generate_records",
    """WITH f AS (SELECT p_partkey, p_partkey % 6 AS k FROM part WHERE p_partkey % 6 <> 4)
    SELECT CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'radio' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'slider' ELSE 'yesno' END AS kind,
      CAST(count(*) * CASE WHEN k = 2 THEN 3 ELSE 1 END * (SELECT count(*) FROM nation) AS BIGINT) AS n, true AS valid FROM f GROUP BY k""",
)
def s30(spark, sf):
    ids = adapters.table(spark, sf, "nation").select(F.col("n_nationkey").alias("record"))
    cells = synth.generate_records(_dictionary(spark, sf), ids, seed=7)
    number = F.regexp_extract("field", "^f([0-9]+)", 1).cast("bigint")
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("text", "radio", "checkbox", "slider", "descriptive", "yesno")]),
        (number % 6 + 1).cast("int"),
    )
    value = F.col("value")
    valid = (
        F.when(kind == "radio", value.isin("1", "2", "x"))
        .when(kind.isin("checkbox", "yesno"), value.isin("0", "1"))
        .when(kind == "slider", value.cast("int").between(0, 100))
        .otherwise(value.rlike(r"^([a-z]+-\d{3}|\d{4}-\d{2}-\d{2})$"))
    )
    return cells.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(valid).alias("valid")
    )


@query(
    "s32_scan_seed",
    """SELECT concat('ror-', n_nationkey) AS university_id, n_name AS name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def s32(spark, sf):
    path = scratch_path(spark, "seed")
    adapters.table(spark, sf, "nation").join(
        adapters.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.concat(F.lit("ror-"), F.col("n_nationkey").cast("string")).alias("university_id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("country"),
    ).write.option("header", "true").csv(path)
    return scans.scan_seed(spark, path, T.StructType.fromDDL("university_id string, name string, country string"))
