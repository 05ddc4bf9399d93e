"""Domain tables projected from the driver's star schema.

Only what an operator needs is read: every adapter is a projection or a join Catalyst
prunes further.  ``catalog.sql`` states the same projections in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    """The number inside ``events.props``."""
    return F.get_json_object("props", "$.k").cast("int")


# ---- citation ------------------------------------------------------------------------
def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("work_id"),
        F.year("o_orderdate").alias("publication_year"),
        F.to_date("o_orderdate").alias("publication_date"),
        F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(status == "F", "article").when(status == "O", "book").otherwise("review").alias("type"),
        (F.col("o_totalprice") / F.lit(1e5)).alias("fwci"),
        F.col("o_custkey").alias("cited_by_count"),
        F.to_date("o_orderdate").alias("updated_date"),
        F.concat(F.lit("10.1234/ABC"), (F.col("o_orderkey") % 200).cast("string")).alias("doi"),
    )


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("work_id"),
        F.col("l_suppkey").alias("author_id"),
        F.col("l_linenumber").cast("string").alias("author_position"),
        (F.col("l_linenumber") == 1).alias("is_corresponding"),
    )


def _lines_with_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )


def _topic_columns() -> list[Column]:
    field, domain = F.floor(F.col("p_size") / 10), F.col("p_size") % 3
    return [
        F.col("p_brand").alias("topic_id"),
        F.concat(F.lit("Topic "), "p_brand").alias("topic_display_name"),
        # Adding zero turns -0.0 into 0.0.
        (F.round(1 - F.col("l_discount") * 8, 4) + 0.0).alias("score"),
        F.col("p_type").alias("subfield_id"),
        F.concat(F.lit("Subfield "), "p_type").alias("subfield_display_name"),
        F.concat(F.lit("F"), field.cast("string")).alias("field_id"),
        F.concat(F.lit("Field "), field.cast("string")).alias("field_display_name"),
        F.concat(F.lit("D"), domain.cast("string")).alias("domain_id"),
        F.concat(F.lit("Domain "), domain.cast("string")).alias("domain_display_name"),
    ]


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_with_part(spark, sf_dir).select(
        F.col("l_orderkey").alias("work_id"), *_topic_columns()
    )


def _keyword_score() -> Column:
    return F.round(F.col("l_tax") * 10, 4) + 0.0


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_with_part(spark, sf_dir).select(
        F.col("l_orderkey").alias("work_id"),
        F.explode(F.split("p_name", " ")).alias("keyword_id"),
        _keyword_score().alias("score"),
    ).select(
        "work_id",
        "keyword_id",
        F.concat(F.lit("Keyword "), "keyword_id").alias("keyword_display_name"),
        "score",
    )


def nested_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works in their landed shape (``schemas.WORKS``): arrays of structs, string ids."""
    supplier = table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("string")
    lines = _lines_with_part(spark, sf_dir).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    ).select("*", *_topic_columns())
    authorship = F.struct(
        F.struct(
            F.col("l_suppkey").cast("string").alias("id"),
            F.col("s_name").alias("display_name"),
            F.lit(None).cast("string").alias("orcid"),
        ).alias("author"),
        F.col("l_linenumber").cast("string").alias("author_position"),
        (F.col("l_linenumber") == 1).alias("is_corresponding"),
        F.array(
            F.struct(
                F.concat(F.lit("I"), nation).alias("id"),
                F.concat(F.lit("R"), nation).alias("ror"),
                F.concat(F.lit("Institution "), nation).alias("display_name"),
                F.concat(F.lit("C"), (F.col("s_nationkey") % 5).cast("string")).alias("country_code"),
                F.lit("education").alias("type"),
            )
        ).alias("institutions"),
    )

    def level(name: str) -> Column:
        return F.struct(
            F.col(f"{name}_id").alias("id"), F.col(f"{name}_display_name").alias("display_name")
        ).alias(name)

    topic = F.struct(
        F.col("topic_id").alias("id"),
        F.col("topic_display_name").alias("display_name"),
        "score",
        level("subfield"),
        level("field"),
        level("domain"),
    )
    keyword = F.transform(
        F.split("p_name", " "),
        lambda token: F.struct(
            token.alias("id"),
            F.concat(F.lit("Keyword "), token).alias("display_name"),
            _keyword_score().alias("score"),
        ),
    )
    gathered = lines.groupBy("l_orderkey").agg(
        F.collect_list(authorship).alias("authorships"),
        F.collect_list(topic).alias("topics"),
        F.flatten(F.collect_list(keyword)).alias("keywords"),
    )
    flat = works(spark, sf_dir)
    joined = flat.join(gathered, flat["work_id"] == gathered["l_orderkey"], "left")
    return joined.select(
        F.col("work_id").cast("string").alias("work_id"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.WORKS.fields[1:]],
    )


# ---- activity ------------------------------------------------------------------------
def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a month, in the shape of an activity log."""
    return _log_entries(
        table(spark, sf_dir, "events").select(
            "user_id", _k().alias("k"), F.col("ts").alias("timestamp"), F.col("event_id").alias("position")
        )
    )


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of several years, a quarter of them at midnight."""
    hours = F.make_dt_interval(hours=(F.col("o_orderkey") % 4 * 6).cast("int"))
    return _log_entries(
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("user_id"),
            (F.col("o_orderkey") % 97).cast("int").alias("k"),
            (F.col("o_orderdate").cast("timestamp") + hours).alias("timestamp"),
            F.col("o_orderkey").alias("position"),
        )
    )


def _log_entries(rows: DataFrame) -> DataFrame:
    """Users, projects and actions made from ``user_id`` and ``k``."""
    user, k = F.col("user_id").cast("string"), F.col("k")
    actions = [
        "Login depuis la page",
        "API export record",
        "Modifier utilisateur: rôle",
        "Paramètres du Projet",
        None,
        "Téléchargement du fichier",
        None,
        None,
        "Mise à jour",
        "Page view",
    ]
    action = F.lit("")
    for digit, label in reversed(list(enumerate(actions))):
        if digit == 4:
            value = F.concat(F.lit("Réponse créée R-"), user)
        elif digit == 6:
            value = F.concat(F.lit("Enregistrement "), k.cast("string"), F.lit(" mise à jour"))
        elif digit == 7:
            value = F.concat(F.lit("Enreg. "), k.cast("string"))
        else:
            value = F.lit(label)
        action = F.when(k % 10 == digit, value).otherwise(action)
    username = (
        F.when(F.col("user_id") % 5 == 0, F.md5(user))
        .when(F.col("user_id") % 5 == 1, F.lit("[Survey Respondent] "))
        .otherwise(F.concat(F.lit(" User_"), user))
    )
    return rows.select(
        (F.col("user_id") % 7).cast("int").alias("project_id"),
        "timestamp",
        username.alias("username"),
        action.alias("action"),
        "position",
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = _k(), F.col("event_type")
    aspect = k % 5
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("A"), (k % 20).cast("string")).alias("from"),
        F.concat(F.lit("O"), (F.col("user_id") % 50).cast("string")).alias("id"),
        F.when(aspect <= 1, "author").when(aspect == 2, "work").otherwise("institution").alias("entity"),
        F.when(aspect == 0, "affiliation")
        .when(aspect == 2, "id")
        .when(aspect == 4, "publication_date")
        .otherwise("display_name_alternatives")
        .alias("field"),
        F.when(aspect == 4, (k % 10 + 2010).cast("string"))
        .otherwise(F.concat(F.lit("V"), (F.col("user_id") % 7).cast("string")))
        .alias("value"),
        F.when((aspect == 4) & (k % 3 != 0), F.concat(F.lit("Lab "), (F.col("user_id") % 4).cast("string"))).alias(
            "label"
        ),
        F.when((F.col("user_id") % 50 + k % 20) % 7 == 0, "rejected")
        .when(kind.isin("click", "purchase"), "accepted")
        .when(kind.isin("view", "signup"), "pending")
        .otherwise("rejected")
        .alias("status"),
        F.when(F.col("value") > 100, F.date_format("ts", "yyyy-MM-dd")).otherwise("never").alias(
            "hasBeenExtendedAt"
        ),
        F.col("event_id").alias("position"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.sha1(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("hash"),
        (
            F.col("l_shipdate").cast("timestamp")
            + F.make_dt_interval(hours=F.col("l_linenumber"))
        ).alias("timestamp"),
        F.concat(F.lit("dev"), (F.col("l_suppkey") % 10).cast("string")).alias("author"),
        F.col("l_quantity").cast("bigint").alias("additions"),
        F.col("l_linenumber").cast("bigint").alias("deletions"),
        (F.col("l_partkey") % 5 + 1).alias("files_changed"),
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("@scope/pkg-"), F.col("c_custkey").cast("string")).alias("name"),
        F.col("c_mktsegment").alias("version"),
        F.date_add(F.lit("2000-08-01").cast("date"), (F.col("c_custkey") % 400).cast("int")).alias("date"),
    )


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("@scope/pkg-"), F.col("o_custkey").cast("string")).alias("name"),
        F.to_date("o_orderdate").alias("day"),
        F.floor(F.col("o_totalprice") / 1000).alias("downloads"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = (
        F.when(F.col("o_orderkey") % 3 == 0, "@scope/pkg-")
        .when(F.col("o_orderkey") % 3 == 1, "scope/pkg-")
        .otherwise("pkg-")
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(prefix, F.col("o_custkey").cast("string"), F.lit("@"), "o_orderpriority").alias("tag_name"),
        F.to_date("o_orderdate").alias("published_at"),
    )


# ---- news and views ------------------------------------------------------------------
def native_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 27-field native layer."""
    k = _k()
    university = F.concat(F.lit("University of Nation "), (F.col("user_id") % 25).cast("string"))
    organisations = F.concat(
        university,
        F.lit(",12;Acme, Corp "),
        (k % 5).cast("string"),
        F.lit(",7; ;"),
        F.when(
            k % 4 == 0,
            F.concat(F.lit("Université Nationale "), (k % 10).cast("string"), F.lit(", Campus,99;")),
        ).otherwise(""),
        university,
        F.lit(",40"),
    )
    known = {
        "gkg_record_id": F.col("event_id").cast("string"),
        "v21_date": F.date_format("ts", "yyyyMMddHHmmss"),
        "v2_source_common_name": F.concat("event_type", F.lit(".example")),
        "v2_document_identifier": F.concat(
            F.lit("http://example.org/"), F.col("event_id").cast("string")
        ),
        "v2_enhanced_organizations": F.when(k % 11 == 0, "").otherwise(organisations),
        "v21_translation_info": F.when(F.col("event_type") == "signup", "srclc:fra").otherwise(""),
    }
    return table(spark, sf_dir, "events").select(
        *[known.get(name, F.lit("")).alias(name) for name in schemas.NEWS_COLUMNS]
    )


def referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.functions.text import match_key

    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("university_id"),
            F.concat(F.lit("University of Nation "), F.col("n_nationkey").cast("string")).alias(
                "university_name"
            ),
            F.col("r_name").alias("country"),
        )
        .withColumn("org_key", match_key(F.col("university_name")))
    )


def raw_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), (F.col("user_id") % 25).cast("string")).alias("university_id"),
        F.to_date("ts").alias("view_date"),
        F.concat(F.lit("Page "), "event_type").alias("page_title"),
        F.lit("en.wikipedia").alias("wiki"),
        F.lit("dump").alias("source_dump"),
        F.when(k % 17 == 0, F.lit(None))
        .when(k % 19 == 0, F.lit(-1))
        .otherwise(F.floor("value"))
        .cast("bigint")
        .alias("views"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("filename"),
    )


# ---- series --------------------------------------------------------------------------
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, day, n): orders per priority and day over several years, days without one absent."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, month, n): orders per customer nation and month."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").alias("key"),
            F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- files -----------------------------------------------------------------------------
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, modified, bytes): part files of runs, listed from the orders."""
    return table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("mart/dt="),
            F.date_format("o_orderdate", "yyyy-MM"),
            F.lit("/run=r"),
            (F.col("o_custkey") % 40).cast("string"),
            F.lit("/part-"),
            F.col("o_orderkey").cast("string"),
            F.when(F.col("o_orderkey") % 13 == 0, ".json").otherwise(".parquet"),
        ).alias("path"),
        F.col("o_orderdate").cast("timestamp").alias("modified"),
        F.floor("o_totalprice").alias("bytes"),
    )


# ---- texts and vectors -------------------------------------------------------------------
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, value): product names in several spellings."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("position"),
        F.when(F.col("p_partkey") % 3 == 0, F.upper(name))
        .when(F.col("p_partkey") % 3 == 1, F.regexp_replace(name, " ", "-"))
        .otherwise(F.concat(name, F.lit("s")))
        .alias("value"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("author_id"), F.col("embedding").alias("vector"), "label"
    )
