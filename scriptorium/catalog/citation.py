"""Queries over works, authorships, topics and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.base import query, steady
from scriptorium.operators import aggregates, dedup, joins, reshape
from scriptorium.plans import adapters, citation, network

SCOPE = ("R3", "R7", "R11")
SCOPE_SQL = "(3, 7, 11)"
OPPOSED = '[{"author_id": "1", "work_id": "0"}, {"author_id": "2", "work_id": "3"}]'


def _text(*names: str):
    return [F.col(n).cast("string").alias(n) for n in names]


# ---- nested works --------------------------------------------------------------------
@query(
    "f1_explode_authorships",
    f"""WITH {sql.AFFILIATIONS}
    SELECT CAST(work_id AS VARCHAR) AS work_id, CAST(author_id AS VARCHAR) AS author_id,
           CAST(line AS VARCHAR) AS author_position, line = 1 AS is_corresponding FROM affiliations""",
)
def f1(spark, sf):
    return reshape.explode_authorships(adapters.nested_works(spark, sf))


@query(
    "f2_explode_topics",
    f"WITH {sql.TOPICS} SELECT CAST(work_id AS VARCHAR) AS work_id, * EXCLUDE (work_id) FROM topics",
)
def f2(spark, sf):
    return reshape.explode_topics(adapters.nested_works(spark, sf))


@query(
    "f3_explode_keywords",
    f"WITH {sql.KEYWORDS} SELECT CAST(work_id AS VARCHAR) AS work_id, * EXCLUDE (work_id) FROM keywords",
)
def f3(spark, sf):
    return reshape.explode_keywords(adapters.nested_works(spark, sf))


@query(
    "f4_stage_works",
    f"""WITH {sql.WORKS} SELECT work_id, publication_year, nullif(trim(title), '') AS title,
    cited_by_count, fwci FROM works""",
)
def f4(spark, sf):
    return reshape.stage_works(adapters.works(spark, sf))


@query(
    "f5_filter_scope",
    f"""WITH {sql.WORKS}, {sql.AFFILIATIONS}
    SELECT CAST(work_id AS VARCHAR) AS work_id, publication_year, fwci FROM works
    WHERE publication_year >= 1997
      AND work_id IN (SELECT work_id FROM affiliations WHERE nation IN {SCOPE_SQL})""",
)
def f5(spark, sf):
    kept = reshape.filter_scope(adapters.nested_works(spark, sf), SCOPE, 1997)
    return kept.select("work_id", "publication_year", "fwci")


@query(
    "f6_affiliated_authors",
    f"""WITH {sql.AFFILIATIONS}
    SELECT DISTINCT CAST(author_id AS VARCHAR) AS author_id FROM affiliations WHERE nation IN {SCOPE_SQL}""",
)
def f6(spark, sf):
    return reshape.affiliated_authors(adapters.nested_works(spark, sf), SCOPE)


@query(
    "f7_prefilter",
    f"""WITH {sql.WORKS} SELECT work_id, publication_year, type, fwci
    FROM works WHERE publication_year >= 1998 AND type = 'article'""",
)
def f7(spark, sf):
    kept = reshape.prefilter(adapters.works(spark, sf), 1998, "article")
    return kept.select("work_id", "publication_year", "type", "fwci")


@query(
    "f16_threshold",
    f"""WITH {sql.KEYWORDS} SELECT work_id, keyword_id, score FROM keywords WHERE score >= 0.2""",
)
def f16(spark, sf):
    return reshape.threshold(adapters.keywords(spark, sf), "keyword").select(
        "work_id", "keyword_id", "score"
    )


@query(
    "f17_purge",
    f"""WITH {sql.LINKS} SELECT author_id, work_id FROM links
    WHERE NOT (author_id = 1 AND work_id = 0) AND NOT (author_id = 2 AND work_id = 3)""",
)
def f17(spark, sf):
    links = dedup.distinct_links(adapters.authorships(spark, sf), ["author_id", "work_id"])
    return reshape.purge(links, OPPOSED)


@query(
    "f27_normalized_works",
    f"""WITH {sql.WORKS}, {sql.TOPICS}, {sql.KEYWORDS},
    t AS (SELECT work_id, count(*) AS n, sum(score) AS s FROM topics WHERE score >= 0.3 GROUP BY 1),
    k AS (SELECT work_id, count(*) AS n, sum(score) AS s FROM keywords GROUP BY 1)
    SELECT CAST(w.work_id AS VARCHAR) AS work_id, coalesce(t.n, 0) AS n_topics,
           round(coalesce(t.s, 0), 4) AS topic_score, coalesce(k.n, 0) AS n_keywords,
           round(coalesce(k.s, 0), 4) AS keyword_score
    FROM works w LEFT JOIN t USING (work_id) LEFT JOIN k USING (work_id)""",
)
def f27(spark, sf):
    works = reshape.normalized_works(adapters.nested_works(spark, sf))

    def total(name):
        return F.round(
            F.coalesce(F.aggregate(name, F.lit(0.0), lambda s, x: s + x["score"]), F.lit(0.0)), 4
        )

    return works.select(
        "work_id",
        F.greatest(F.size("topics"), F.lit(0)).cast("bigint").alias("n_topics"),
        total("topics").alias("topic_score"),
        F.greatest(F.size("keywords"), F.lit(0)).cast("bigint").alias("n_keywords"),
        total("keywords").alias("keyword_score"),
    )


@query(
    "f28_work_text",
    f"""WITH {sql.TOPICS}, {sql.KEYWORDS},
    rows AS (SELECT work_id, 0 AS part, topic_display_name AS label, score, topic_id AS label_id FROM topics
             WHERE score >= 0.3
             UNION ALL SELECT work_id, 1, keyword_display_name, score, keyword_id FROM keywords)
    SELECT work_id, string_agg(label, ', ' ORDER BY part, score DESC, label_id) AS text
    FROM rows GROUP BY work_id""",
)
def f28(spark, sf):
    return reshape.work_text(adapters.topics(spark, sf), adapters.keywords(spark, sf))


_DIMS_SQL = """dims AS (
  SELECT l.author_id, concat('topic::', topic_id) AS dim, topic_display_name AS label, score
    FROM links l JOIN topics t ON t.work_id = l.work_id
  UNION ALL SELECT l.author_id, concat('subfield::', subfield_id), subfield_display_name, score
    FROM links l JOIN topics t ON t.work_id = l.work_id
  UNION ALL SELECT l.author_id, concat('field::', field_id), field_display_name, score
    FROM links l JOIN topics t ON t.work_id = l.work_id
  UNION ALL SELECT l.author_id, concat('domain::', domain_id), domain_display_name, score
    FROM links l JOIN topics t ON t.work_id = l.work_id
  UNION ALL SELECT l.author_id, concat('keyword::', keyword_id), keyword_display_name, score
    FROM links l JOIN keywords k ON k.work_id = l.work_id)"""


@query(
    "f29_profile_dims",
    f"""WITH {sql.LINKS}, {sql.TOPICS}, {sql.KEYWORDS}, {_DIMS_SQL}
    SELECT author_id AS researcher_id, dim, min(label) AS label, round(sum(score), 4) AS total
    FROM dims GROUP BY author_id, dim""",
)
def f29(spark, sf):
    dims = citation.profile_dimensions(
        adapters.authorships(spark, sf),
        adapters.topics(spark, sf),
        adapters.keywords(spark, sf),
    )
    return dims.groupBy("researcher_id", "dim").agg(
        F.min("label").alias("label"),
        F.round(F.sum("score"), 4).alias("total"),
    )


@query(
    "f32_format_reference",
    f"""WITH {sql.WORKS}, {sql.AFFILIATIONS},
    a AS (SELECT work_id, string_agg(author_name, ', ' ORDER BY line, author_name) AS authors FROM affiliations GROUP BY 1)
    SELECT CAST(w.work_id AS VARCHAR) AS work_id, concat(publication_year, ' - ', title) AS short_reference,
           concat(authors, ' (', publication_year, '). ', title, '. DOI: ', doi, '. OpenAlex ID: ', w.work_id) AS full_reference
    FROM works w JOIN a ON a.work_id = w.work_id""",
)
def f32(spark, sf):
    nested = adapters.nested_works(spark, sf).where(F.size("authorships") > 0)
    ordered = F.transform(
        F.sort_array(
            F.transform(
                "authorships",
                lambda a: F.struct(
                    a["author_position"].cast("int").alias("p"), a["author"]["display_name"].alias("n")
                ),
            )
        ),
        lambda s: s["n"],
    )
    title, year = F.col("title"), F.col("publication_year")
    doi = F.concat(F.lit("10.1234/ABC"), (F.col("work_id").cast("bigint") % 200).cast("string"))
    return nested.select(
        "work_id",
        reshape.format_reference(title, year).alias("short_reference"),
        reshape.format_reference(title, year, ordered, doi, F.col("work_id")).alias("full_reference"),
    )


# ---- duplicates ----------------------------------------------------------------------
@query(
    "d1_latest_by",
    """SELECT o_custkey AS key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated_date,
       o_totalprice AS fwci, o_orderkey AS cited_by_count FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey
           ORDER BY CAST(o_orderdate AS DATE) DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS rn
         FROM orders) WHERE rn = 1""",
)
def d1(spark, sf):
    versions = adapters.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"),
        F.to_date("o_orderdate").alias("updated_date"),
        F.col("o_totalprice").alias("fwci"),
        F.col("o_orderkey").alias("cited_by_count"),
    )
    latest = dedup.latest_by(versions, ["key"], ["updated_date", "fwci", "cited_by_count"])
    return latest.withColumn("updated_date", F.col("updated_date").cast("string"))


@query(
    "d3_distinct_links",
    f"WITH {sql.LINKS} SELECT work_id, author_id FROM links",
)
def d3(spark, sf):
    return dedup.distinct_links(adapters.authorships(spark, sf), ["work_id", "author_id"])


@query(
    "d4_unique_works",
    """SELECT l_orderkey AS work_id, max(l_partkey) AS version,
       max_by(l_extendedprice, (l_partkey, l_extendedprice)) AS price FROM lineitem GROUP BY 1""",
)
def d4(spark, sf):
    versions = adapters.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("work_id"),
        F.col("l_partkey").alias("version"),
        F.col("l_extendedprice").alias("price"),
    )
    return dedup.unique_works(versions)


@query(
    "d10_institutions_of",
    f"""WITH {sql.AFFILIATIONS}
    SELECT DISTINCT concat('I', nation) AS id, concat('Institution ', nation) AS display_name,
           concat('C', nation % 5) AS country_code
    FROM affiliations WHERE author_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""",
)
def d10(spark, sf):
    chosen = adapters.table(spark, sf, "supplier").where("s_acctbal > 5000").select(
        F.col("s_suppkey").cast("string").alias("author_id")
    )
    return dedup.institutions_of(adapters.nested_works(spark, sf), chosen)


# ---- joins -----------------------------------------------------------------------------
_PAIRS_SQL = """pairs AS (
  SELECT x.author_id AS author_a, y.author_id AS author_b, x.work_id
  FROM links x JOIN links y ON x.work_id = y.work_id AND x.author_id < y.author_id)"""


@query(
    "j1_coauthor_pairs",
    f"WITH {sql.LINKS}, {_PAIRS_SQL} SELECT author_a, author_b, work_id FROM pairs",
)
def j1(spark, sf):
    return joins.coauthor_pairs(adapters.authorships(spark, sf))


_UPLIFT_SQL = f"""{sql.WORKS}, {sql.LINKS},
aw AS (SELECT author_id, l.work_id, publication_year AS year, fwci FROM links l JOIN works w ON w.work_id = l.work_id),
ay AS (SELECT author_id, year, sum(fwci) AS t, count(*) AS c FROM aw GROUP BY 1, 2),
copubs AS (SELECT x.author_id AS author_a, y.author_id AS author_b, x.work_id, x.year, x.fwci
           FROM aw x JOIN aw y ON x.work_id = y.work_id AND x.author_id < y.author_id),
py AS (SELECT author_a, author_b, year, sum(fwci) AS s, count(*) AS m FROM copubs GROUP BY 1, 2, 3),
shared AS (SELECT p.author_a, p.author_b, p.year,
             coalesce((SELECT sum(q.s) FROM py q WHERE q.author_a = p.author_a AND q.author_b = p.author_b AND q.year < p.year), 0) AS s,
             coalesce((SELECT sum(q.m) FROM py q WHERE q.author_a = p.author_a AND q.author_b = p.author_b AND q.year < p.year), 0) AS m
           FROM py p),
hist AS (SELECT a.author_id, y.year, sum(a.t) AS t, sum(a.c) AS c
         FROM ay a JOIN (SELECT DISTINCT year FROM aw) y ON a.year < y.year GROUP BY 1, 2),
solo AS (SELECT s.author_a, s.author_b, s.year, (x.t - s.s) / (x.c - s.m) AS solo_a, (z.t - s.s) / (z.c - s.m) AS solo_b
         FROM shared s JOIN hist x ON x.author_id = s.author_a AND x.year = s.year
                       JOIN hist z ON z.author_id = s.author_b AND z.year = s.year
         WHERE x.c > s.m AND z.c > s.m)"""


@query(
    "j2_prior_solo_mean",
    f"""WITH {_UPLIFT_SQL}
    SELECT author_a, author_b, year, round(solo_a + 1e-9, 5) AS solo_a, round(solo_b + 1e-9, 5) AS solo_b FROM solo""",
)
def j2(spark, sf):
    solo = citation.prior_solo_means(adapters.works(spark, sf), adapters.authorships(spark, sf))
    return solo.select(
        "author_a",
        "author_b",
        "year",
        steady("solo_a", 5).alias("solo_a"),
        steady("solo_b", 5).alias("solo_b"),
    )


@query(
    "j3_copub_uplift",
    f"""WITH {_UPLIFT_SQL}
    SELECT c.author_a, c.author_b, c.work_id, round(c.fwci - (solo_a + solo_b) / 2 + 1e-9, 5) AS uplift
    FROM copubs c JOIN solo s ON s.author_a = c.author_a AND s.author_b = c.author_b AND s.year = c.year""",
)
def j3(spark, sf):
    uplift = citation.copublication_uplift(
        adapters.works(spark, sf), adapters.authorships(spark, sf)
    )
    return uplift.withColumn("uplift", steady("uplift", 5))


@query(
    "j4_works_of",
    f"""WITH {sql.WORKS}, {sql.AFFILIATIONS}
    SELECT CAST(work_id AS VARCHAR) AS work_id, publication_year FROM works WHERE work_id IN (
      SELECT work_id FROM affiliations WHERE author_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))""",
)
def j4(spark, sf):
    researchers = adapters.table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.col("s_suppkey").cast("string").alias("author_id")
    )
    return joins.works_of(adapters.nested_works(spark, sf), researchers).select(
        "work_id", "publication_year"
    )


@query(
    "j7_author_subfields",
    f"""WITH {sql.LINKS}, {sql.TOPICS}, {sql.WORKS}
    SELECT author_id, subfield_id, count(*) AS n, round(sum(score), 4) AS total
    FROM links l JOIN topics t ON t.work_id = l.work_id
    WHERE l.work_id IN (SELECT work_id FROM works WHERE publication_year >= 1997)
      AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.work_id AND o.l_suppkey = l.author_id
                      AND o.l_returnflag = 'R')
    GROUP BY 1, 2""",
)
def j7(spark, sf):
    opposed = adapters.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("author_id"), F.col("l_orderkey").alias("work_id")
    )
    links = dedup.distinct_links(adapters.authorships(spark, sf), ["work_id", "author_id"])
    rows = joins.author_subfields(
        links,
        adapters.topics(spark, sf),
        adapters.works(spark, sf).where("publication_year >= 1997"),
        opposed,
    )
    return rows.groupBy("author_id", "subfield_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total")
    )


@query(
    "j8_serving_rows",
    """SELECT s_suppkey AS author_id, s_name AS doc_text, embedding IS NOT NULL AS has_vector,
       coalesce(len(embedding), 0) AS dim FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey * 7""",
)
def j8(spark, sf):
    documents = adapters.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("doc_text")
    )
    vectors = adapters.vectors(spark, sf).where("author_id % 7 = 0").withColumn(
        "author_id", (F.col("author_id") / 7).cast("bigint")
    )
    return joins.serving_rows(documents, vectors).select(
        "author_id",
        "doc_text",
        F.col("vector").isNotNull().alias("has_vector"),
        F.coalesce(F.size("vector"), F.lit(0)).cast("bigint").alias("dim"),
    ).withColumn("dim", F.greatest("dim", F.lit(0).cast("bigint")))


@query(
    "j19_phantom_labels",
    f"""WITH {sql.LINKS}, {sql.TOPICS}, {sql.KEYWORDS},
    src AS (SELECT author_id, 'topic' AS kind, topic_id AS label_id FROM links l JOIN topics t ON t.work_id = l.work_id
            WHERE score >= 1.0
            UNION SELECT author_id, 'keyword', keyword_id FROM links l JOIN keywords k ON k.work_id = l.work_id WHERE score >= 0.8),
    mart AS (SELECT author_id, 'topic' AS kind, topic_id AS label_id, sum(score) AS weight, count(DISTINCT l.work_id) AS freq
             FROM links l JOIN topics t ON t.work_id = l.work_id WHERE score >= 0.5 GROUP BY 1, 2, 3
             UNION ALL SELECT author_id, 'keyword', keyword_id, sum(score), count(DISTINCT l.work_id)
             FROM links l JOIN keywords k ON k.work_id = l.work_id WHERE score >= 0.2 GROUP BY 1, 2, 3)
    SELECT m.author_id, m.kind, m.label_id, round(m.weight, 4) AS weight, m.freq
    FROM mart m LEFT JOIN src s ON s.author_id = m.author_id AND s.kind = m.kind AND s.label_id = m.label_id
    WHERE s.author_id IS NULL OR m.weight <= 0 OR m.freq < 1""",
)
def j19(spark, sf):
    parts = (
        adapters.authorships(spark, sf),
        adapters.topics(spark, sf),
        adapters.keywords(spark, sf),
    )
    mart = aggregates.researcher_labels(*parts)
    source = aggregates.researcher_labels(*parts, topic_min=1.0, keyword_min=0.8)
    return joins.phantom_labels(mart, source).withColumn("weight", F.round("weight", 4))


@query(
    "j20_pending_refs",
    f"""WITH {sql.WORKS} SELECT work_id FROM works WHERE work_id NOT IN (
        SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def j20(spark, sf):
    final = adapters.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("work_id")
    )
    return joins.pending_refs(adapters.works(spark, sf).select("work_id"), final)


# ---- aggregates ------------------------------------------------------------------------
@query(
    "a1_collab_pairs",
    f"""WITH {sql.LINKS}, {_PAIRS_SQL}
    SELECT author_a, author_b, count(DISTINCT work_id) AS co_publications FROM pairs GROUP BY 1, 2""",
)
def a1(spark, sf):
    return aggregates.collab_pairs(adapters.authorships(spark, sf))


_LABELS_SQL = f"""{sql.LINKS}, {sql.TOPICS}, {sql.KEYWORDS},
labels AS (
  SELECT author_id, kind, label_id, min(label) AS label, sum(score) AS weight, count(DISTINCT work_id) AS freq FROM (
    SELECT author_id, 'topic' AS kind, topic_id AS label_id, topic_display_name AS label, l.work_id, score
    FROM links l JOIN topics t ON t.work_id = l.work_id WHERE score >= 0.5
    UNION ALL SELECT author_id, 'keyword', keyword_id, keyword_display_name, l.work_id, score
    FROM links l JOIN keywords k ON k.work_id = l.work_id WHERE score >= 0.2)
  GROUP BY 1, 2, 3)"""


@query(
    "a2_researcher_labels",
    f"WITH {_LABELS_SQL} SELECT author_id, kind, label_id, label, round(weight, 4) AS weight, freq FROM labels",
)
def a2(spark, sf):
    labels = aggregates.researcher_labels(
        adapters.authorships(spark, sf),
        adapters.topics(spark, sf),
        adapters.keywords(spark, sf),
        opposed="[]",
    )
    return labels.withColumn("weight", F.round("weight", 4))


@query(
    "a3_author_profiles",
    f"""WITH {sql.LINKS}, {sql.TOPICS}
    SELECT author_id, subfield_id, min(subfield_display_name) AS subfield, round(sum(score), 4) AS weight,
           count(DISTINCT l.work_id) AS freq
    FROM links l JOIN topics t ON t.work_id = l.work_id GROUP BY 1, 2""",
)
def a3(spark, sf):
    profiles = aggregates.author_profiles(
        adapters.authorships(spark, sf), adapters.topics(spark, sf), adapters.works(spark, sf)
    )
    return profiles.withColumn("weight", F.round("weight", 4))


@query(
    "a4_uplift_labels",
    f"""WITH {_UPLIFT_SQL}
    SELECT c.author_a, c.author_b, round(avg(c.fwci - (solo_a + solo_b) / 2) + 1e-9, 5) AS uplift, count(*) AS n_copubs
    FROM copubs c JOIN solo s ON s.author_a = c.author_a AND s.author_b = c.author_b AND s.year = c.year
    GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def a4(spark, sf):
    labels = aggregates.uplift_labels(adapters.works(spark, sf), adapters.authorships(spark, sf))
    return labels.withColumn("uplift", steady("uplift", 5))


@query(
    "a5_researcher_documents",
    f"""WITH {_LABELS_SQL}
    SELECT author_id, string_agg(rtrim(repeat(concat(label, ' '), CAST(freq AS INT))), ' '
             ORDER BY round(weight, 4) DESC, kind, label_id) AS doc_text
    FROM labels GROUP BY author_id""",
)
def a5(spark, sf):
    return aggregates.researcher_documents(a2(spark, sf))


@query(
    "a22_articles_by_year",
    f"""WITH {sql.WORKS}, spine AS (SELECT unnest(['before', '1995', '1996', '1997', '1998', '1999', '2000']) AS year),
    c AS (SELECT CASE WHEN publication_year < 1995 THEN 'before' ELSE CAST(publication_year AS VARCHAR) END AS year, count(*) AS n
          FROM works WHERE type = 'article' AND publication_year <= 2000 GROUP BY 1)
    SELECT year, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (year)""",
)
def a22(spark, sf):
    return aggregates.articles_by_year(adapters.works(spark, sf), 2000)


@query(
    "a23_institution_stats",
    f"""WITH {sql.WORKS}, {sql.AFFILIATIONS}, scoped AS (
      SELECT * FROM works WHERE work_id IN (SELECT work_id FROM affiliations WHERE nation IN {SCOPE_SQL}))
    SELECT (SELECT count(*) FROM scoped WHERE publication_year BETWEEN 1995 AND 2000) AS works_count,
           (SELECT count(*) FROM scoped WHERE publication_year BETWEEN 1995 AND 2000 AND type = 'article') AS articles_count,
           (SELECT count(DISTINCT author_id) FROM affiliations WHERE nation IN {SCOPE_SQL}) AS authors_count""",
)
def a23(spark, sf):
    return aggregates.institution_stats(adapters.nested_works(spark, sf), SCOPE, 2000)


@query(
    "a24_works_count",
    f"""WITH {sql.WORKS}, {sql.AFFILIATIONS}
    SELECT count(*) AS works_count FROM works WHERE type = 'article' AND publication_date >= DATE '1998-03-01'
      AND work_id IN (SELECT work_id FROM affiliations WHERE nation IN {SCOPE_SQL})""",
)
def a24(spark, sf):
    nested = adapters.nested_works(spark, sf).withColumn("publication_date", F.col("updated_date"))
    return aggregates.works_count(nested, SCOPE, F.lit("1998-03-01").cast("date"))


# ---- two-pass network --------------------------------------------------------------------
@query(
    "u2_scope_network",
    f"""WITH {sql.WORKS}, {sql.AFFILIATIONS},
    chosen AS (SELECT DISTINCT author_id FROM affiliations WHERE nation IN {SCOPE_SQL}
               AND work_id IN (SELECT work_id FROM works WHERE publication_year >= 1996 AND type = 'article'))
    SELECT CAST(work_id AS VARCHAR) AS work_id, publication_year FROM works
    WHERE publication_year >= 1996 AND type = 'article'
      AND work_id IN (SELECT work_id FROM affiliations WHERE author_id IN (SELECT author_id FROM chosen))""",
)
def u2(spark, sf):
    _, works = network.extract(adapters.nested_works(spark, sf), SCOPE, 1996)
    return works.select("work_id", "publication_year")


def flagship(spark, sf) -> DataFrame:
    """Co-authorship pairs with their uplift label, where they have one."""
    pairs = a1(spark, sf)
    return pairs.join(a4(spark, sf), ["author_a", "author_b"], "left")


query(
    "citation_pairs_with_uplift",
    f"""WITH {_UPLIFT_SQL},
    labels AS (
      SELECT c.author_a, c.author_b, round(avg(c.fwci - (solo_a + solo_b) / 2) + 1e-9, 5) AS uplift, count(*) AS n_copubs
      FROM copubs c JOIN solo s ON s.author_a = c.author_a AND s.author_b = c.author_b AND s.year = c.year
      GROUP BY 1, 2 HAVING count(*) >= 2),
    totals AS (SELECT author_a, author_b, count(DISTINCT work_id) AS co_publications FROM copubs GROUP BY 1, 2)
    SELECT author_a, author_b, co_publications, uplift, n_copubs FROM totals LEFT JOIN labels USING (author_a, author_b)""",
)(flagship)
