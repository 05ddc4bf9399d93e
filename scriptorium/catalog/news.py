"""Queries over news mentions, the university referential and page views."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.base import query
from scriptorium.functions import text
from scriptorium.operators import aggregates, joins, reshape
from scriptorium.plans import adapters, news, views
from scriptorium.sources import landed, scans

LANGS = ("en", "fr", "de")


@query(
    "s4_native_news",
    f"""SELECT CAST(event_id AS VARCHAR) AS gkg_record_id, strftime(ts, '%Y%m%d%H%M%S') AS v21_date,
    concat('"', event_type, '.example') AS v2_source_common_name, CASE WHEN event_type = 'signup' THEN 'srclc:fra' ELSE '' END AS v21_translation_info
    FROM events WHERE event_id % 7 <> 0""",
)
def s4(spark, sf):
    native = adapters.native_news(spark, sf)
    record = F.col("gkg_record_id").cast("bigint")
    fields = [
        F.concat(F.lit(' "'), F.col(c)) if c == "v2_source_common_name" else F.concat(F.lit(" "), F.col(c))
        for c in native.columns
    ]
    full = F.concat_ws("\t", *fields)
    # Every seventh line is cut short; every fifth carries an extra field.
    lines = native.select(
        F.when(record % 7 == 0, F.concat_ws("\t", *fields[:20]))
        .when(record % 5 == 0, F.concat(full, F.lit("\textra")))
        .otherwise(full)
        .alias("value")
    )
    return scans.parse_native_news(lines).select(
        "gkg_record_id", "v21_date", "v2_source_common_name", "v21_translation_info"
    )


@query(
    "s5_project_mentions",
    f"""WITH {sql.MENTIONS} SELECT record_id, stamp AS date, org AS organization, source_name AS source_common_name,
    url AS document_identifier, translated FROM mentions""",
)
def s5(spark, sf):
    return reshape.mentions(adapters.native_news(spark, sf))


@query("f8_split_orgs", f"WITH {sql.MENTIONS} SELECT record_id, org FROM mentions")
def f8(spark, sf):
    return adapters.native_news(spark, sf).select(
        F.col("gkg_record_id").alias("record_id"),
        F.explode(text.split_orgs(F.col("v2_enhanced_organizations"))).alias("org"),
    )


def _staged(spark, sf):
    return news.stage(reshape.mentions(adapters.native_news(spark, sf)).withColumn("filename", F.lit("f")))


@query(
    "f10_stage_mentions",
    f"""WITH {sql.MENTIONS} SELECT record_id, stamp AS gkg_timestamp, CAST(day AS VARCHAR) AS event_date, org AS org_name,
    org_key, source_name, url AS document_url, translated FROM mentions""",
)
def f10(spark, sf):
    return _staged(spark, sf).withColumn("event_date", F.col("event_date").cast("string"))


@query(
    "f11_looks_university",
    f"""WITH {sql.MENTIONS} SELECT DISTINCT org, NOT starts_with(org, 'Acme') AS looks FROM mentions""",
)
def f11(spark, sf):
    names = reshape.mentions(adapters.native_news(spark, sf)).select(F.col("organization").alias("org")).distinct()
    return names.select("org", text.looks_university(F.col("org")).alias("looks"))


@query(
    "x1_match_key",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS match_key
    FROM documents""",
)
def x1(spark, sf):
    return adapters.table(spark, sf, "documents").select(
        "doc_id", text.match_key(F.col("text")).alias("match_key")
    )


@query("x2_fold_accents", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def x2(spark, sf):
    return adapters.table(spark, sf, "documents").select(
        "doc_id", text.fold_accents(F.col("text")).alias("folded")
    )


@query(
    "x3_normalize_string",
    """SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s+', ' ', 'g'))) AS norm
    FROM documents""",
)
def x3(spark, sf):
    return adapters.table(spark, sf, "documents").select(
        "doc_id", text.normalize_string(F.col("text")).alias("norm")
    )


# ---- joins and aggregates --------------------------------------------------------------
@query(
    "d2_last_file_wins",
    f"""WITH {sql.VIEWS} SELECT university_id, CAST(view_date AS VARCHAR) AS view_date, page_title, views FROM views""",
)
def d2(spark, sf):
    return (
        views.stage(adapters.raw_views(spark, sf))
        .select("university_id", F.col("view_date").cast("string").alias("view_date"), "page_title", "views")
    )


_MATCHED = """matched AS (SELECT m.*, r.university_id, r.university_name, r.country
  FROM mentions m JOIN referential r ON r.org_key = m.org_key)"""


@query(
    "j6_university_mentions",
    f"""WITH {sql.MENTIONS}, {sql.REFERENTIAL}, {_MATCHED}
    SELECT record_id, CAST(day AS VARCHAR) AS event_date, university_id, university_name, country, org AS matched_org_name,
    source_name, url AS document_url, translated, true AS name_looks_university FROM matched""",
)
def j6(spark, sf):
    found = joins.university_mentions(_staged(spark, sf), adapters.referential(spark, sf))
    return found.withColumn("event_date", F.col("event_date").cast("string"))


@query(
    "j5_university_candidates",
    f"""WITH {sql.MENTIONS}, {sql.REFERENTIAL}
    SELECT record_id, org AS org_name, org_key, translated FROM mentions
    WHERE NOT starts_with(org, 'Acme') AND org_key NOT IN (SELECT org_key FROM referential)""",
)
def j5(spark, sf):
    found = joins.university_candidates(_staged(spark, sf), adapters.referential(spark, sf))
    return found.select("record_id", "org_name", "org_key", "translated")


@query(
    "a7_candidate_counts",
    f"""WITH {sql.MENTIONS}, {sql.REFERENTIAL}
    SELECT org AS org_name, org_key, count(*) AS mention_count, bool_or(translated) AS seen_translated FROM mentions
    WHERE NOT starts_with(org, 'Acme') AND org_key NOT IN (SELECT org_key FROM referential) GROUP BY 1, 2""",
)
def a7(spark, sf):
    return aggregates.candidate_counts(
        joins.university_candidates(_staged(spark, sf), adapters.referential(spark, sf))
    )


@query(
    "a6_university_timeline",
    f"""WITH {sql.MENTIONS}, {sql.REFERENTIAL}, {_MATCHED}
    SELECT university_id, university_name, CAST(day AS VARCHAR) AS event_date, count(DISTINCT record_id) AS n_articles,
    count(*) AS n_mentions FROM matched GROUP BY 1, 2, 3""",
)
def a6(spark, sf):
    timeline = news.timeline(adapters.native_news(spark, sf), adapters.referential(spark, sf))
    return timeline.withColumn("event_date", F.col("event_date").cast("string"))


@query(
    "a8_monthly_views",
    f"""WITH {sql.VIEWS} SELECT university_id, CAST(CAST(date_trunc('month', view_date) AS DATE) AS VARCHAR) AS view_month,
    CAST(sum(views) AS BIGINT) AS views, count(DISTINCT view_date) AS n_days FROM views GROUP BY 1, 2""",
)
def a8(spark, sf):
    monthly = aggregates.monthly_views(views.stage(adapters.raw_views(spark, sf)))
    return monthly.withColumn("view_month", F.col("view_month").cast("string"))


@query(
    "a9_views_timeline",
    f"""WITH {sql.VIEWS} SELECT university_id, CAST(CAST(date_trunc('month', view_date) AS DATE) AS VARCHAR) AS month,
    CAST(sum(views) AS BIGINT) AS views FROM views GROUP BY 1, 2""",
)
def a9(spark, sf):
    timeline = views.timeline(adapters.raw_views(spark, sf))
    return timeline.withColumn("month", F.col("month").cast("string"))


# ---- referential -------------------------------------------------------------------------
def _registry_json(spark, sf):
    """One registry record per customer; every third is not a university, some are broken."""
    key = F.col("c_custkey")
    name = F.col("c_name")
    flagged = F.struct(F.concat(name, F.lit(" University")).alias("value"), F.array(F.lit("ror_display")).alias("types"))
    alias = F.struct(F.concat(F.lit(" "), name).alias("value"), F.array(F.lit("alias")).alias("types"))
    record = F.to_json(
        F.struct(
            F.concat(F.lit("https://ror.org/"), key.cast("string")).alias("id"),
            F.when(key % 3 == 0, F.array(F.lit("company"))).otherwise(
                F.array(F.lit("funder"), F.lit("education"))
            ).alias("types"),
            F.when(key % 2 == 0, F.array(alias, flagged)).otherwise(F.array(alias)).alias("names"),
            F.when(
                key % 5 != 0,
                F.array(
                    F.struct(
                        F.struct(
                            F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("country_code")
                        ).alias("geonames_details")
                    )
                ),
            ).alias("locations"),
        )
    )
    broken = F.when(key % 7 == 0, F.concat(F.lit('{"id": "x", "types": "education", "names": '), key.cast("string")))
    return adapters.table(spark, sf, "customer").select(F.coalesce(broken, record).alias("json"))


_UNIVERSITIES_SQL = """SELECT concat('https://ror.org/', c_custkey) AS university_id,
  CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ' University') ELSE c_name END AS name,
  CASE WHEN c_custkey % 5 <> 0 THEN concat('C', c_nationkey) ELSE '' END AS country
  FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0"""


@query("f12_project_universities", _UNIVERSITIES_SQL)
def f12(spark, sf):
    return landed.flatten_registry(_registry_json(spark, sf))


def _catalogue(spark, sf):
    key = F.col("c_custkey")
    return (
        adapters.table(spark, sf, "orders")
        .join(adapters.table(spark, sf, "customer"), F.col("o_custkey") == key)
        .select(
            F.concat(F.lit("I"), key.cast("string")).alias("id"),
            F.when(key % 11 != 0, F.concat(F.lit("https://ror.org/"), key.cast("string"), F.lit("/"))).alias("ror"),
            F.when(F.col("c_mktsegment") == "BUILDING", "company").otherwise("education").alias("type"),
            F.concat(F.lit("c"), (F.col("c_nationkey") % 6).cast("string")).alias("country_code"),
            F.floor("o_totalprice").alias("works_count"),
            F.to_date("o_orderdate").alias("updated_date"),
        )
    )


_INSTITUTIONS_SQL = """institutions AS (
  SELECT id, ror, country_code, works_count FROM (
    SELECT concat('I', c_custkey) AS id, concat('https://ror.org/', c_custkey, '/') AS ror, concat('c', c_nationkey % 6) AS country_code,
           CAST(floor(o_totalprice) AS BIGINT) AS works_count,
           row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, CAST(floor(o_totalprice) AS BIGINT) DESC) AS rn
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 11 <> 0) WHERE rn = 1)"""


@query(
    "f13_institutions",
    f"WITH {_INSTITUTIONS_SQL} SELECT * FROM institutions WHERE upper(country_code) IN ('C1', 'C2')",
)
def f13(spark, sf):
    return landed.institutions(_catalogue(spark, sf), ["c1", "c2"])


@query(
    "f14_bare_id",
    """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS ror, concat('Q', c_custkey) AS qid FROM customer""",
)
def f14(spark, sf):
    key = F.col("c_custkey").cast("string")
    return adapters.table(spark, sf, "customer").select(
        "c_custkey",
        text.bare_id(F.concat(F.lit("https://ror.org/"), key, F.lit("/ "))).alias("ror"),
        text.bare_id(F.concat(F.lit("http://www.wikidata.org/entity/Q"), key)).alias("qid"),
    )


@query(
    "f15_works_band",
    """SELECT o_orderkey, CASE WHEN o_totalprice / 2 < 1000 THEN 'xs' WHEN o_totalprice / 2 < 5000 THEN 's' WHEN o_totalprice / 2 < 20000 THEN 'm'
       WHEN o_totalprice / 2 < 100000 THEN 'l' ELSE 'xl' END AS band FROM orders""",
)
def f15(spark, sf):
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey", reshape.works_band(F.col("o_totalprice") / 2).alias("band")
    )


def _titles(spark, sf):
    """(ror, qid, lang, title, batch, position): articles of customers, several per language."""
    key = F.col("o_custkey")
    lang = F.when(F.col("o_orderkey") % 4 == 0, "en").when(F.col("o_orderkey") % 4 == 1, "fr").when(
        F.col("o_orderkey") % 4 == 2, "it"
    ).otherwise("de")
    return adapters.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("position"),
        (F.col("o_orderkey") % 3).alias("batch"),
        key.cast("string").alias("ror"),
        F.concat(F.lit("Q"), key.cast("string")).alias("qid"),
        lang.alias("lang"),
        F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("Title "), (F.col("o_orderkey") % 500).cast("string")))
        .otherwise("")
        .alias("title"),
    )


_KNOWLEDGE_SQL = """bindings AS (
  SELECT o_orderkey AS position, o_orderkey % 3 AS batch, CAST(o_custkey AS VARCHAR) AS ror, concat('Q', o_custkey) AS qid,
    CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'it' ELSE 'de' END AS lang,
    CASE WHEN o_orderkey % 10 <> 0 THEN concat('Title ', o_orderkey % 500) ELSE '' END AS title FROM orders),
knowledge AS (SELECT ror, qid, lang, title FROM bindings WHERE title <> '' AND lang IN ('en', 'fr', 'de')
  QUALIFY row_number() OVER (PARTITION BY ror, lang ORDER BY batch, position) = 1)"""


@query("j10_merge_titles", f"WITH {_KNOWLEDGE_SQL} SELECT ror, qid, lang, title FROM knowledge")
def j10(spark, sf):
    return joins.merge_titles(_titles(spark, sf), LANGS).select("ror", "qid", "lang", "title")


_REDIRECTS_SQL = """norm AS (SELECT concat('Title ', o_orderkey) AS a, concat('Titre ', o_orderkey) AS b FROM orders WHERE o_orderkey % 3 = 0),
redir AS (SELECT concat('Titre ', o_orderkey) AS a, concat('Final ', o_orderkey) AS b FROM orders WHERE o_orderkey % 6 = 0
          UNION ALL SELECT concat('Title ', o_orderkey), concat('Moved ', o_orderkey) FROM orders WHERE o_orderkey % 6 = 1)"""


def _lookups(spark, sf):
    orders = adapters.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")

    def pair(a, b):
        return F.concat(F.lit(a), key).alias("from"), F.concat(F.lit(b), key).alias("to")

    normalized = orders.where("o_orderkey % 3 = 0").select(*pair("Title ", "Titre "))
    redirects = orders.where("o_orderkey % 6 = 0").select(*pair("Titre ", "Final ")).unionByName(
        orders.where("o_orderkey % 6 = 1").select(*pair("Title ", "Moved "))
    )
    return normalized, redirects


@query(
    "j11_resolve_titles",
    f"""WITH {_KNOWLEDGE_SQL}, {_REDIRECTS_SQL}, s AS (SELECT k.*, coalesce(n.b, k.title) AS step FROM knowledge k LEFT JOIN norm n ON n.a = k.title)
    SELECT ror, lang, s.title, coalesce(r.b, step) AS resolved FROM s LEFT JOIN redir r ON r.a = s.step""",
)
def j11(spark, sf):
    resolved = joins.resolve_titles(j10(spark, sf), *_lookups(spark, sf))
    return resolved.select("ror", "lang", "title", "resolved")


_TITLES_SQL = f"""{_INSTITUTIONS_SQL}, {_KNOWLEDGE_SQL}, {_REDIRECTS_SQL},
entities AS (SELECT DISTINCT ror, qid FROM knowledge),
resolved AS (SELECT DISTINCT k.qid, k.title, coalesce(r.b, n.b, k.title) AS resolved FROM knowledge k
             LEFT JOIN norm n ON n.a = k.title LEFT JOIN redir r ON r.a = coalesce(n.b, k.title)),
ref AS (SELECT i.bare AS ror, coalesce(e.qid, '') AS qid, i.id AS university_id, l.lang, coalesce(x.resolved, '') AS title,
    upper(i.country_code) AS country_code,
    CASE WHEN works_count < 1000 THEN 'xs' WHEN works_count < 5000 THEN 's' WHEN works_count < 20000 THEN 'm'
         WHEN works_count < 100000 THEN 'l' ELSE 'xl' END AS works_band, x.resolved IS NOT NULL AS has_wp
  FROM (SELECT *, regexp_extract(ror, '([0-9]+)/', 1) AS bare FROM institutions) i
  CROSS JOIN (SELECT unnest(['en', 'fr', 'de']) AS lang) l
  LEFT JOIN entities e ON e.ror = i.bare
  LEFT JOIN knowledge k ON k.ror = i.bare AND k.lang = l.lang
  LEFT JOIN resolved x ON x.qid = k.qid AND x.title = k.title)"""


def _referential(spark, sf):
    institutions = landed.institutions(_catalogue(spark, sf)).select(
        text.bare_id(F.col("ror")).alias("ror"),
        F.col("id").alias("university_id"),
        F.upper("country_code").alias("country_code"),
        reshape.works_band(F.col("works_count")).alias("works_band"),
    )
    return views.build_referential(institutions, _titles(spark, sf), *_lookups(spark, sf), LANGS)


@query("j9_university_titles", f"WITH {_TITLES_SQL} SELECT * FROM ref")
def j9(spark, sf):
    return _referential(spark, sf)


@query(
    "a25_ref_summary",
    f"""WITH {_TITLES_SQL} SELECT count(DISTINCT university_id) AS n_institutions, count(*) FILTER (has_wp) AS n_titles,
    count(DISTINCT CASE WHEN has_wp THEN lang END) AS n_langs FROM ref""",
)
def a25(spark, sf):
    return aggregates.ref_summary(_referential(spark, sf))


@query(
    "j12_aggregate_views",
    f"""WITH {_KNOWLEDGE_SQL}, fetched AS (
      SELECT CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'it' ELSE 'de' END AS lang, concat('Title ', o_orderkey % 500) AS title,
             strftime(o_orderdate, '%Y%m') AS month, CAST(floor(o_totalprice / 100000) AS BIGINT) AS views FROM orders)
    SELECT k.ror AS university_id, f.month, CAST(sum(f.views) AS BIGINT) AS views
    FROM knowledge k JOIN fetched f ON f.lang = k.lang AND f.title = k.title
    WHERE f.month BETWEEN '199801' AND '199806' GROUP BY 1, 2 HAVING sum(f.views) > 0""",
)
def j12(spark, sf):
    titles = j10(spark, sf).select(F.col("ror").alias("university_id"), "lang", "title")
    fetched = _titles(spark, sf).select(
        F.col("position"), "lang", F.concat(F.lit("Title "), (F.col("position") % 500).cast("string")).alias("title")
    ).join(
        adapters.table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("position"),
            F.date_format("o_orderdate", "yyyyMM").alias("month"),
            F.floor(F.col("o_totalprice") / 100000).alias("views"),
        ),
        "position",
    )
    months = [f"19980{m}" for m in range(1, 7)]
    return joins.aggregate_views(titles, fetched, months)


# ---- landed payloads -----------------------------------------------------------------------
@query(
    "s31_flatten_catalogue",
    """SELECT CAST(c_custkey AS VARCHAR) AS ror, concat('I', c_custkey) AS university_id, concat('C', c_nationkey) AS country_code,
       CASE WHEN c_acctbal < 1000 THEN 'xs' WHEN c_acctbal < 5000 THEN 's' ELSE 'm' END AS works_band
       FROM customer WHERE c_custkey % 5 <> 0""",
)
def s31_catalogue(spark, sf):
    key = F.col("c_custkey").cast("string")
    item = F.struct(
        F.concat(F.lit("I"), key).alias("id"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("https://ror.org/"), key)).alias("ror"),
        F.struct(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("country_code")).alias("geo"),
        F.floor("c_acctbal").alias("works_count"),
    )
    pages = adapters.table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 25)).agg(
        F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("json")
    )
    return landed.flatten_catalogue(pages)


@query(
    "s31_flatten_monthly_views",
    """SELECT o_custkey AS page, strftime(o_orderdate, '%Y%m') AS month, CAST(floor(o_totalprice) AS BIGINT) AS views
       FROM orders WHERE o_orderkey % 9 <> 0""",
)
def s31_views(spark, sf):
    item = F.struct(
        F.date_format("o_orderdate", "yyyyMM'0100'").alias("timestamp"),
        F.when(F.col("o_orderkey") % 9 != 0, F.floor("o_totalprice")).alias("views"),
    )
    pages = adapters.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page")).agg(
        F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json")
    )
    return landed.flatten_monthly_views(pages, keep=["page"])


@query(
    "s31_flatten_redirects",
    """SELECT DISTINCT o_custkey AS page, concat('Alias ', o_orderkey % 50) AS title FROM orders""",
)
def s31_redirects(spark, sf):
    redirect = F.struct(F.concat(F.lit("Alias "), (F.col("o_orderkey") % 50).cast("string")).alias("title"))
    pages = adapters.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page")).agg(
        F.to_json(
            F.struct(
                F.struct(
                    F.map_from_arrays(
                        F.array(F.first("o_custkey").cast("string")),
                        F.array(F.struct(F.collect_list(redirect).alias("redirects"))),
                    ).alias("pages")
                ).alias("query")
            )
        ).alias("json")
    )
    return landed.flatten_redirects(pages, keep=["page"])


@query(
    "s31_flatten_bindings",
    f"""WITH {_KNOWLEDGE_SQL} SELECT ror, qid, lang, title, batch FROM bindings WHERE lang IN ('en', 'fr', 'de')""",
)
def s31_bindings(spark, sf):
    def value(name, prefix=""):
        return F.struct(F.concat(F.lit(prefix), F.col(name)).alias("value")).alias(name)

    binding = F.struct(
        value("ror", "https://ror.org/"),
        F.struct(F.concat(F.lit("http://www.wikidata.org/entity/"), F.col("qid")).alias("value")).alias("item"),
        value("lang"),
        value("title"),
    )
    pages = _titles(spark, sf).groupBy("batch", F.pmod("position", F.lit(64))).agg(
        F.to_json(
            F.struct(F.struct(F.collect_list(binding).alias("bindings")).alias("results"))
        ).alias("json")
    )
    return landed.flatten_bindings(pages, LANGS).select("ror", "qid", "lang", "title", "batch")
