"""Queries over profiles, vectors, strings and texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.base import query, steady
from scriptorium.functions import text, vectors
from scriptorium.operators import aggregates, dedup, joins, matching, neighbours, reshape, windows
from scriptorium.plans import adapters, citation
from scriptorium.session import materialize, scratch_path

# ---- strings -----------------------------------------------------------------------------
@query(
    "d8_unique_ci",
    f"""WITH {sql.STRINGS} SELECT position, value FROM strings
    QUALIFY row_number() OVER (PARTITION BY lower(value) ORDER BY position) = 1""",
)
def d8(spark, sf):
    return dedup.unique_ci(adapters.strings(spark, sf))


@query(
    "x4_edit_similarity",
    """SELECT p_partkey, round(CASE WHEN p_name = lower(p_type) THEN 1 ELSE
       1 - levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type)) END + 1e-9, 5) AS score FROM part""",
)
def x4(spark, sf):
    return adapters.table(spark, sf, "part").select(
        "p_partkey",
        steady(text.edit_similarity(F.col("p_name"), F.lower("p_type")), 5).alias("score"),
    )


def _grams_sql(column: str, n: int) -> str:
    return (
        f"CASE WHEN length({column}) >= {n} THEN list_distinct(list_transform("
        f"generate_series(1, length({column}) - {n - 1}), lambda i: substr(lower({column}), CAST(i AS INT), {n}))) ELSE [] END"
    )


def _jaccard_sql(a: str, b: str) -> str:
    return (
        f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 1)"
    )


@query(
    "x5_ngram_similarity",
    f"""WITH g AS (SELECT p_partkey, {_grams_sql('p_name', 2)} AS a2, {_grams_sql('p_name', 3)} AS a3,
      {_grams_sql('p_brand', 2)} AS b2, {_grams_sql('p_brand', 3)} AS b3 FROM part)
    SELECT p_partkey, round(({_jaccard_sql('a2', 'b2')} + {_jaccard_sql('a3', 'b3')}) / 2 + 1e-9, 5) AS score FROM g""",
)
def x5(spark, sf):
    return adapters.table(spark, sf, "part").select(
        "p_partkey",
        steady(text.ngram_similarity(F.col("p_name"), F.col("p_brand")), 5).alias("score"),
    )


_NORMS_SQL = f"""{sql.STRINGS},
items AS (SELECT position, value FROM strings QUALIFY row_number() OVER (PARTITION BY lower(value) ORDER BY position) = 1),
normed AS (SELECT position, value, lower(trim(regexp_replace(regexp_replace(strip_accents(value), '[^\\p{{L}}\\p{{N}}\\s_-]', '', 'g'), '\\s+', ' ', 'g'))) AS norm FROM items),
firsts AS (SELECT norm, min(position) AS first, row_number() OVER (ORDER BY min(position)) AS rn FROM normed GROUP BY norm)"""


def _leaders_sql(similar: str, score: str) -> str:
    """Sequential leader rule over the distinct normal forms, as a recursive query."""
    return f"""WITH RECURSIVE {_NORMS_SQL},
    steps AS (
      SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS leaders
      UNION ALL
      SELECT f.rn, CASE WHEN len(list_filter(s.leaders, lambda l: {similar.format(a='f.norm', b='l')})) > 0 THEN s.leaders
                   ELSE list_append(s.leaders, f.norm) END
      FROM steps s JOIN firsts f ON f.rn = s.rn + 1),
    leaders AS (SELECT leaders FROM steps ORDER BY rn DESC LIMIT 1),
    placed AS (SELECT f.norm, list_filter((SELECT leaders FROM leaders), lambda l: {similar.format(a='f.norm', b='l')})[1] AS leader_norm FROM firsts f),
    grouped AS (SELECT n.position, n.value, g.first AS leader, {score.format(a='n.norm', b='p.leader_norm')} AS score
      FROM normed n JOIN placed p ON p.norm = n.norm JOIN firsts g ON g.norm = p.leader_norm)"""


_EDIT = "(CASE WHEN {a} = {b} THEN 1 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"
_EDIT_SQL = _leaders_sql(_EDIT + " >= 0.75", _EDIT)


@query("m6_group_similar", _EDIT_SQL + " SELECT position, value, leader FROM grouped")
def m6(spark, sf):
    return matching.group_similar(adapters.strings(spark, sf)).select("position", "value", "leader")


@query(
    "m7_group_scores",
    _EDIT_SQL + " SELECT leader, count(*) AS n_items, round(avg(score) + 1e-9, 5) AS score FROM grouped GROUP BY 1",
)
def m7(spark, sf):
    scores = matching.group_scores(matching.group_similar(adapters.strings(spark, sf)))
    return scores.withColumn("score", steady("score", 5))


def _gram_list(x: str, n: int) -> str:
    return (
        f"list_distinct(list_transform(generate_series(1, greatest(length({x}) - {n - 1}, 1)), lambda i: substr({x}, CAST(i AS INT), {n})))"
    )


_NGRAM = "(({j2} + {j3}) / 2)".format(
    j2=_jaccard_sql(_gram_list("{a}", 2), _gram_list("{b}", 2)),
    j3=_jaccard_sql(_gram_list("{a}", 3), _gram_list("{b}", 3)),
)


@query("m8_group_ngram", _leaders_sql(_NGRAM + " >= 0.5", _NGRAM) + " SELECT position, value, leader FROM grouped")
def m8(spark, sf):
    return matching.group_ngram(adapters.strings(spark, sf)).select("position", "value", "leader")


# ---- extraction ----------------------------------------------------------------------------
def _doi_texts(spark, sf):
    k = F.get_json_object("props", "$.k")
    return adapters.table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.lit("see https://doi.org/10.1234/AbC"),
            k,
            F.lit(". and (10.55555/x"),
            F.col("user_id").cast("string"),
            F.lit("), again 10.1234/aBc"),
            k,
            F.lit(" not 10.12/short"),
        ).alias("text"),
    )


_DOIS_SQL = f"""dois AS (SELECT event_id, concat('10.1234/abc', {sql.K}) AS doi FROM events
  UNION ALL SELECT event_id, concat('10.55555/x', user_id) FROM events)"""


@query("f22_extract_dois", f"WITH {_DOIS_SQL} SELECT event_id, doi FROM dois")
def f22(spark, sf):
    return _doi_texts(spark, sf).select(
        "event_id", F.explode(text.extract_dois(F.col("text"))).alias("doi")
    )


@query(
    "j17_match_dois",
    f"""WITH {sql.WORKS}, {_DOIS_SQL} SELECT work_id, doi FROM works WHERE lower(doi) IN (SELECT doi FROM dois)""",
)
def j17(spark, sf):
    works = adapters.works(spark, sf).select("work_id", "doi")
    return joins.match_dois(works, f22(spark, sf))


@query(
    "j17_missing_dois",
    f"""WITH {sql.WORKS}, {_DOIS_SQL} SELECT DISTINCT doi FROM dois WHERE doi NOT IN (SELECT lower(doi) FROM works)""",
)
def j17_missing(spark, sf):
    return joins.missing_dois(adapters.works(spark, sf), f22(spark, sf))


_SEGMENTS_SQL = """lines AS (
  SELECT doc_id, lang, trim(unnest(string_split(text, chr(10))), ' ') AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no
  FROM documents),
windows AS (
  SELECT doc_id, lang, line AS segment, line_no, 0 AS i FROM lines WHERE length(line) > 20 AND length(line) <= 500
  UNION ALL
  SELECT doc_id, lang, substr(line, CAST(least(i * 80, length(line) - 200) AS INT) + 1, 200), line_no, i
  FROM (SELECT doc_id, lang, line, line_no, unnest(generate_series(0, CAST(ceil((length(line) - 200) / 80.0) AS BIGINT))) AS i
        FROM lines WHERE length(line) > 500)),
segments AS (SELECT doc_id, lang, segment, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) - 1 AS place FROM windows)"""


@query("f33_segments", f"WITH {_SEGMENTS_SQL} SELECT doc_id, segment FROM segments")
def f33(spark, sf):
    return adapters.table(spark, sf, "documents").select(
        "doc_id", F.explode(text.segments(F.col("text"))).alias("segment")
    )


_J16_KEY = "trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


_ABSENT = "(len(titles.g) - len(list_intersect(titles.g, grams.g))) / len(titles.g)"
_TITLES_SQL = f"""t AS (SELECT item_id, {_J16_KEY.format(x='text')} AS k FROM benchmark),
    titles AS (SELECT item_id, {_gram_list('k', 3)} AS g FROM t WHERE length(k) >= 10)"""


def _placed_segments(spark, sf):
    """Segments of documents with their owner and place."""
    rows = adapters.table(spark, sf, "documents").select("lang", "doc_id", F.posexplode(text.segments(F.col("text"))))
    return rows.select(
        F.col("lang").alias("owner"), F.struct("doc_id", F.col("pos").alias("place")).alias("segment_id"), F.col("col").alias("segment")
    )


@query(
    "j16_match_references",
    f"""WITH {_SEGMENTS_SQL}, {_TITLES_SQL},
    s AS (SELECT lang, {_J16_KEY.format(x='segment')} AS k, doc_id, place FROM segments WHERE lang IS NOT NULL),
    grams AS (SELECT lang, {_gram_list('k', 3)} AS g, doc_id, place FROM s WHERE length(k) >= 3
      QUALIFY row_number() OVER (PARTITION BY lang, k ORDER BY doc_id, place) = 1)
    SELECT lang AS owner, item_id AS work_id, doc_id, place, round({_ABSENT} + 1e-9, 5) AS score
    FROM titles JOIN grams ON {_ABSENT} <= 0.2
    QUALIFY row_number() OVER (PARTITION BY lang, item_id ORDER BY {_ABSENT}, doc_id, place) = 1""",
)
def j16(spark, sf):
    items = adapters.table(spark, sf, "benchmark").select(F.col("item_id").alias("work_id"), F.col("text").alias("title"))
    segments = _placed_segments(spark, sf)
    # Every owner looks for the same titles in texts of their own.
    owners = adapters.table(spark, sf, "documents").agg(F.collect_set("lang").alias("owners"))
    works = items.withColumn("owner", F.explode(owners.scalar()))
    found = matching.match_references(works, segments, owner=["owner"])
    return found.select("owner", "work_id", "segment_id.doc_id", "segment_id.place", steady("score", 5).alias("score"))


@query(
    "d9_union_matches",
    f"""WITH {_DOIS_SQL}, {_SEGMENTS_SQL}, {_TITLES_SQL},
    s AS (SELECT DISTINCT {_J16_KEY.format(x='segment')} AS k FROM segments),
    grams AS (SELECT {_gram_list('k', 3)} AS g FROM s WHERE length(k) >= 3),
    w AS (SELECT item_id AS work_id, concat('10.1234/ABC', item_id % 50) AS doi FROM benchmark),
    b AS (SELECT work_id, doi, 'doi' AS source FROM w WHERE lower(doi) IN (SELECT doi FROM dois)
      UNION ALL SELECT work_id, doi, 'fuzzy' FROM w
        WHERE work_id IN (SELECT item_id FROM titles JOIN grams ON {_ABSENT} <= 0.2))
    SELECT work_id, doi, source FROM b QUALIFY row_number() OVER (PARTITION BY lower(doi) ORDER BY source, work_id) = 1""",
)
def d9(spark, sf):
    # Works share a DOI in places, so that a DOI is matched both ways.
    works = adapters.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("work_id"),
        F.col("text").alias("title"),
        F.concat(F.lit("10.1234/ABC"), (F.col("item_id") % 50).cast("string")).alias("doi"),
    )
    by_doi = joins.match_dois(works.drop("title"), f22(spark, sf))
    titles = matching.match_references(works, _placed_segments(spark, sf).drop("owner"))
    by_title = works.drop("title").join(titles.select("work_id"), "work_id", "left_semi")
    return dedup.union_matches(by_doi, by_title)


@query(
    "f35_validators",
    """WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('user', c_custkey, '@mail.example.org') WHEN 1 THEN concat('user ', c_custkey, '@x.org')
       WHEN 2 THEN concat('a@b', c_custkey) ELSE concat('@', c_custkey) END AS email, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer)
    SELECT c_custkey, c_custkey % 4 IN (0, 2) AS email, c_custkey % 3 <> 0 AS hex, c_custkey % 3 = 0 AS orcid FROM v""",
)
def f35(spark, sf):
    key = F.col("c_custkey")
    word = key.cast("string")
    email = (
        F.when(key % 4 == 0, F.concat(F.lit("user"), word, F.lit("@mail.example.org")))
        .when(key % 4 == 1, F.concat(F.lit("user "), word, F.lit("@x.org")))
        .when(key % 4 == 2, F.concat(F.lit("a@b"), word))
        .otherwise(F.concat(F.lit("@"), word))
    )
    code = F.when(
        key % 3 == 0, F.concat(F.lit("https://orcid.org/0000-0001-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("-123X"))
    ).otherwise(F.md5(word))
    return adapters.table(spark, sf, "customer").select(
        "c_custkey",
        text.valid_email(email).alias("email"),
        text.valid_hex(code).alias("hex"),
        text.valid_orcid(code).alias("orcid"),
    )


@query(
    "x14_json_arrays",
    f"""SELECT event_id, {sql.K} AS k, concat('{{"event_type":"', event_type, '","user_id":"', user_id, '"}}') AS canonical FROM events""",
)
def x14(spark, sf):
    parsed = F.from_json(F.concat(F.lit("["), F.col("props"), F.lit("]")), "array<struct<k:int>>")
    return adapters.table(spark, sf, "events").select(
        "event_id",
        F.get(parsed, 0)["k"].alias("k"),
        F.to_json(
            F.struct(
                F.col("event_type").alias("event_type"), F.col("user_id").cast("string").alias("user_id")
            )
        ).alias("canonical"),
    )


@query(
    "x15_doi_and_id_tails",
    """SELECT o_orderkey, concat('10.1234/abc', o_orderkey) AS doi, concat('W', o_orderkey) AS tail FROM orders""",
)
def x15(spark, sf):
    key = F.col("o_orderkey").cast("string")
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey",
        text.normalize_doi(F.concat(F.lit("https://DOI.org/10.1234/ABC"), key, F.lit(".)"))).alias("doi"),
        text.bare_id(F.concat(F.lit("https://openalex.org/W"), key)).alias("tail"),
    )


@query("x16_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def x16(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# ---- vectors ---------------------------------------------------------------------------------
_NEXT_SQL = """pairs AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _next_pairs(spark, sf):
    left = adapters.vectors(spark, sf).select(
        F.col("author_id").alias("vec_id"), F.col("vector").cast("array<double>").alias("x")
    )
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return left.join(right, "vec_id")


@query(
    "x6_cosine",
    f"WITH {_NEXT_SQL} SELECT vec_id, round(list_cosine_similarity(x, y) + 1e-9, 6) AS score FROM pairs",
)
def x6(spark, sf):
    return _next_pairs(spark, sf).select(
        "vec_id", steady(vectors.cosine(F.col("x"), F.col("y")), 6).alias("score")
    )


_SIMS = {
    "domain": "l_quantity / 50",
    "field": "l_tax * 10",
    "subfield": "l_discount * 10",
    "topic": "l_linenumber / 10",
    "keyword": "l_quantity / 60",
}


@query(
    "x7_complementarity",
    """SELECT l_orderkey, l_linenumber,
       round((0.2 * l_quantity / 50 + 0.3 * l_tax * 10 + 0.5 * l_discount * 10) * (1 - l_linenumber / 10) + 1e-9, 5) AS plain,
       round((0.2 * l_quantity / 50 + 0.25 * l_tax * 10 + 0.45 * l_discount * 10 + 0.1 * l_quantity / 60) * (1 - l_linenumber / 10) + 1e-9, 5) AS worded
       FROM lineitem""",
)
def x7(spark, sf):
    sims = {name: F.expr(e) for name, e in _SIMS.items()}
    plain = {n: c for n, c in sims.items() if n != "keyword"}
    return adapters.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        steady(vectors.complementarity(plain), 5).alias("plain"),
        steady(vectors.complementarity(sims), 5).alias("worded"),
    )


@query(
    "x8_ensemble",
    """SELECT l_orderkey, l_linenumber, round(0.5 * l_tax + 0.5 * l_discount + 1e-9, 6) AS equal,
       round(0.8 * l_tax + 0.2 * l_discount + 1e-9, 6) AS weighted FROM lineitem""",
)
def x8(spark, sf):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return adapters.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        steady(vectors.ensemble(tax, discount), 6).alias("equal"),
        steady(vectors.ensemble(tax, discount, {"tfidf": 0.8, "embedding": 0.2}), 6).alias("weighted"),
    )


@query(
    "x13_array_functions",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)) + 1e-9, 6) AS sum_squares,
       round(embedding[3]::DOUBLE + 1e-9, 6) AS third, list_has_any([label], [1, 3, 5]) AS odd FROM embeddings""",
)
def x13(spark, sf):
    vector = F.col("vector")
    return adapters.vectors(spark, sf).select(
        F.col("author_id").alias("vec_id"),
        steady(vectors.dot(vector, vector), 6).alias("sum_squares"),
        steady(F.element_at(vector, 3).cast("double"), 6).alias("third"),
        F.arrays_overlap(F.array("label"), F.array(F.lit(1), F.lit(3), F.lit(5))).alias("odd"),
    )


@query(
    "x17_pair_features",
    f"""WITH {_NEXT_SQL}, f AS (SELECT vec_id, list_zip(x, y) AS z, x, y FROM pairs)
    SELECT vec_id, round(list_inner_product(x, y) + 1e-9, 6) AS dot, round(list_distance(x, y) + 1e-9, 6) AS distance,
      round(list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) + 1e-9, 6) AS gap, CAST(vec_id % 2 AS DOUBLE) AS flag,
      round(CASE WHEN vec_id % 2 = 1 THEN list_inner_product(x, y) ELSE 0 END + 1e-9, 6) AS emb_dot, CAST(261 AS INT) AS size FROM f""",
)
def x17(spark, sf):
    embedded = _next_pairs(spark, sf).select(
        "vec_id", "x", "y", F.when(F.col("vec_id") % 2 == 1, F.col("x")).alias("ex"), F.col("y").alias("ey")
    )
    out = embedded.withColumn("f", vectors.pair_features(64, 64)("x", "y", "ex", "ey"))
    gap = F.aggregate(F.slice("f", 3, 64), F.lit(0.0), lambda s, v: s + v)
    return out.select(
        "vec_id",
        steady(F.col("f")[0], 6).alias("dot"),
        steady(F.col("f")[1], 6).alias("distance"),
        steady(gap, 6).alias("gap"),
        F.col("f")[130].alias("flag"),
        steady(F.col("f")[131], 6).alias("emb_dot"),
        F.size("f").alias("size"),
    )


@query(
    "a17_mean_pool",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2)
    SELECT label AS author_id, CAST(i AS INT) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)) + 1e-9, 6) AS v FROM m""",
)
def a17(spark, sf):
    pooled = aggregates.mean_pool(
        adapters.vectors(spark, sf).select(F.col("label").alias("author_id"), "vector"), "author_id"
    )
    return pooled.select("author_id", F.posexplode("vector").alias("i", "v")).select(
        "author_id", (F.col("i") + 1).alias("i"), steady("v", 6).alias("v")
    )


@query(
    "a27_vector_coverage",
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders)
    SELECT count(*) AS n_authors, count(*) FILTER (e.vec_id IS NOT NULL AND e.label <> 3) AS n_with_vector,
           count(*) FILTER (e.vec_id IS NOT NULL AND e.label = 3) AS n_zero_vectors
    FROM a LEFT JOIN embeddings e ON e.vec_id = a.id""",
)
def a27(spark, sf):
    authors = adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("author_id"))
    zeroed = adapters.vectors(spark, sf).withColumn(
        "vector",
        F.when(F.col("label") == 3, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).otherwise(
            F.col("vector")
        ),
    )
    return aggregates.vector_coverage(authors, zeroed)


_KNN = neighbours.NEIGHBOURS


@query(
    "j14_knn_pairs",
    f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS s
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    k AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {_KNN})
    SELECT DISTINCT least(a, b) AS author_a, greatest(a, b) AS author_b FROM k""",
)
def j14(spark, sf):
    return neighbours.knn_pairs(adapters.vectors(spark, sf), _KNN)


@query(
    "m5_search_knn",
    """WITH q AS (SELECT list_transform(generate_series(1, 64), lambda i: sin(i)) AS v)
    SELECT vec_id AS author_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) + 1e-9, 6) AS distance
    FROM embeddings, q ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), vec_id LIMIT 20""",
)
def m5(spark, sf):
    probe = [float(np.sin(i)) for i in range(1, 65)]
    found = matching.search_knn(adapters.vectors(spark, sf), "author_id", "vector", probe)
    return found.withColumn("distance", steady("distance", 6))


# ---- profiles ----------------------------------------------------------------------------------
_PROFILES_SQL = f"""{sql.LINKS}, {sql.TOPICS},
dims AS (
  SELECT l.author_id, unnest([concat('topic::', topic_id), concat('subfield::', subfield_id), concat('field::', field_id), concat('domain::', domain_id)]) AS dim,
         unnest([topic_display_name, subfield_display_name, field_display_name, domain_display_name]) AS label, score
  FROM links l JOIN topics t ON t.work_id = l.work_id),
tf AS (SELECT author_id, dim, sum(score) AS tf, max(label) AS label FROM dims GROUP BY 1, 2),
df AS (SELECT dim, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT author_id, tf.dim, label, tf * ln((SELECT count(DISTINCT author_id) FROM tf) / (df + 1) + 1) AS weight FROM tf JOIN df ON df.dim = tf.dim),
profiles AS (SELECT author_id, dim, label, weight / sqrt(sum(weight * weight) OVER (PARTITION BY author_id)) AS weight FROM w)"""


def _dims(spark, sf):
    return citation.profile_dimensions(adapters.authorships(spark, sf), adapters.topics(spark, sf))


def _profiles(spark, sf):
    return matching.tfidf_profiles(_dims(spark, sf))


def _stored_profiles(spark, sf):
    """Profiles written once for the queries that use them several times."""
    return materialize(_profiles(spark, sf), "profiles")


@query(
    "a15_tfidf",
    f"WITH {_PROFILES_SQL} SELECT author_id AS researcher_id, dim, label, round(weight + 1e-9, 5) AS weight FROM w",
)
def a15(spark, sf):
    return aggregates.tfidf(_dims(spark, sf)).withColumn("weight", steady("weight", 5))


@query(
    "a16_l2_normalize",
    f"""WITH {sql.LINKS}, {sql.TOPICS}, p AS (SELECT author_id, subfield_id, sum(score) AS weight FROM links l JOIN topics t ON t.work_id = l.work_id GROUP BY 1, 2)
    SELECT author_id, subfield_id, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY author_id)) + 1e-9, 6) AS weight FROM p""",
)
def a16(spark, sf):
    profiles = aggregates.author_profiles(
        adapters.authorships(spark, sf), adapters.topics(spark, sf), adapters.works(spark, sf)
    ).select("author_id", "subfield_id", "weight")
    return aggregates.l2_normalize(profiles, "author_id").withColumn("weight", steady("weight", 6))


@query(
    "m1_tfidf_profiles",
    f"WITH {_PROFILES_SQL} SELECT author_id AS researcher_id, dim, label, round(weight + 1e-9, 6) AS weight FROM profiles",
)
def m1(spark, sf):
    return _profiles(spark, sf).withColumn("weight", steady("weight", 6))


@query(
    "w7_top_labels",
    f"""WITH {_PROFILES_SQL} SELECT author_id AS researcher_id, dim, label FROM profiles WHERE starts_with(dim, 'topic::')
    QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY round(weight, 9) DESC, dim) <= 5""",
)
def w7(spark, sf):
    rounded = _profiles(spark, sf).withColumn("weight", F.round("weight", 9))
    return windows.top_labels(rounded, "topic").select("researcher_id", "dim", "label")


#: Partners of a researcher.
_PARTNERS = 20
_SCORES_SQL = f"""{_PROFILES_SQL},
people AS (SELECT DISTINCT author_id FROM profiles),
shared AS (SELECT x.author_id AS a, y.author_id AS b, x.dim, x.weight * y.weight AS p
  FROM profiles x JOIN profiles y ON x.dim = y.dim AND x.author_id <> y.author_id),
norms AS (SELECT author_id, split_part(dim, '::', 1) AS level, sqrt(sum(weight * weight)) AS n FROM profiles GROUP BY 1, 2),
sims AS (SELECT a, b, sum(p) AS tfidf_sim FROM shared GROUP BY 1, 2),
levels AS (SELECT s.a, s.b, s.level, s.p / (na.n * nb.n) AS sim FROM (
    SELECT a, b, split_part(dim, '::', 1) AS level, sum(p) AS p FROM shared GROUP BY 1, 2, 3) s
  JOIN norms na ON na.author_id = s.a AND na.level = s.level JOIN norms nb ON nb.author_id = s.b AND nb.level = s.level),
wide AS (SELECT a, b, coalesce(max(sim) FILTER (level = 'domain'), 0) AS d, coalesce(max(sim) FILTER (level = 'field'), 0) AS f,
    coalesce(max(sim) FILTER (level = 'subfield'), 0) AS sf, coalesce(max(sim) FILTER (level = 'topic'), 0) AS t FROM levels GROUP BY 1, 2),
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
matches AS (SELECT p.author_id AS researcher_a, q.author_id AS researcher_b, coalesce(tfidf_sim, 0) AS tfidf_sim,
    coalesce(list_inner_product(x.v, y.v), 0) AS embedding_sim,
    0.5 * coalesce(tfidf_sim, 0) + 0.5 * coalesce(list_inner_product(x.v, y.v), 0) AS similarity,
    coalesce((0.2 * d + 0.3 * f + 0.5 * sf) * (1 - t), 0) AS complementarity
  FROM people p JOIN people q ON p.author_id <> q.author_id
  LEFT JOIN sims s ON s.a = p.author_id AND s.b = q.author_id LEFT JOIN wide w ON w.a = p.author_id AND w.b = q.author_id
  LEFT JOIN emb x ON x.vec_id = p.author_id LEFT JOIN emb y ON y.vec_id = q.author_id)"""


def _best_sql(by: str) -> str:
    return f"""WITH {_SCORES_SQL} SELECT researcher_a, researcher_b, round(tfidf_sim + 1e-9, 6) AS tfidf_sim, round(embedding_sim + 1e-9, 6) AS embedding_sim,
    round(similarity + 1e-9, 6) AS similarity, round(complementarity + 1e-9, 6) AS complementarity FROM matches
    QUALIFY row_number() OVER (PARTITION BY researcher_a ORDER BY round({by}, 9) DESC, researcher_b) <= {_PARTNERS}"""


def _matches(spark, sf, by, profiles=None):
    embedded = adapters.vectors(spark, sf).select(
        F.col("author_id").alias("researcher_id"), F.col("vector").cast("array<double>").alias("vector")
    )
    return matching.best_matches(_profiles(spark, sf) if profiles is None else profiles, embedded, _PARTNERS, by)


def _scores(matches):
    return matches.select(
        "researcher_a", "researcher_b", *[steady(n, 6).alias(n) for n in matching.MATCH_SCORES]
    )


@query("j13_similar_profiles", _best_sql("tfidf_sim"))
def j13(spark, sf):
    return _scores(_matches(spark, sf, "tfidf_sim"))


@query("m2_match_researchers", _best_sql("similarity"))
def m2(spark, sf):
    return _scores(_matches(spark, sf, "similarity"))


@query("m2_complementary_researchers", _best_sql("complementarity"))
def m2_complementary(spark, sf):
    return _scores(_matches(spark, sf, "complementarity"))


_TOP_SQL = f"ORDER BY round(complementarity, 9) DESC, researcher_a, researcher_b LIMIT {_PARTNERS}"


@query(
    "o2_top_matches",
    f"""WITH {_SCORES_SQL} SELECT researcher_a, researcher_b, round(complementarity + 1e-9, 6) AS complementarity FROM matches
    WHERE researcher_a < researcher_b {_TOP_SQL}""",
)
def o2(spark, sf):
    top = matching.top_overall(_matches(spark, sf, "complementarity"), _PARTNERS)
    return top.select("researcher_a", "researcher_b", steady("complementarity", 6).alias("complementarity"))


@query(
    "m3_explain",
    f"""WITH {_SCORES_SQL},
    top AS (SELECT researcher_a AS a, researcher_b AS b FROM matches WHERE researcher_a < researcher_b {_TOP_SQL}),
    r AS (SELECT t.a, t.b, split_part(p.dim, '::', 1) AS level, p.dim, p.label,
            row_number() OVER (PARTITION BY t.a, t.b, split_part(p.dim, '::', 1) ORDER BY round(p.weight, 9) DESC, p.dim) AS rn
          FROM top t JOIN profiles p ON p.author_id = t.b JOIN profiles q ON q.author_id = t.a AND q.dim = p.dim)
    SELECT a AS researcher_a, b AS researcher_b,
      string_agg(label, '|' ORDER BY rn) FILTER (level = 'subfield' AND rn <= 5) AS shared_subfields,
      string_agg(label, '|' ORDER BY rn) FILTER (level = 'domain' AND rn <= 5) AS shared_domains FROM r GROUP BY 1, 2""",
)
def m3(spark, sf):
    stored = _stored_profiles(spark, sf)
    profiles = stored.withColumn("weight", F.round("weight", 9))
    found = _matches(spark, sf, "complementarity", stored)
    top = materialize(matching.top_overall(found, _PARTNERS), "top")
    return matching.explain(top, profiles).select(
        "researcher_a",
        "researcher_b",
        F.array_join("shared_subfields", "|").alias("shared_subfields"),
        F.array_join("shared_domains", "|").alias("shared_domains"),
    )


# ---- text search ---------------------------------------------------------------------------------
@query(
    "m4_search_text",
    """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
    s AS (SELECT tf.doc_id, sum(CASE WHEN term IN ('the', 'and', 'hean') THEN 1 + ln(tf) END) AS score,
      bool_or(term = 'the') AS a1, bool_or(term = 'and') AS a2, bool_or(term = 'der') AS bad FROM tf WHERE term IN ('the', 'and', 'hean', 'der') GROUP BY 1)
    SELECT s.doc_id, round(score / (1 + ln(n)) + 1e-9, 6) AS rank FROM s JOIN n ON n.doc_id = s.doc_id WHERE a1 AND a2 AND NOT bad
    ORDER BY round(score / (1 + ln(n)), 9) DESC, s.doc_id LIMIT 20""",
)
def m4(spark, sf):
    path = scratch_path(spark, "text-index")
    matching.add_to_index(matching.text_index(adapters.table(spark, sf, "documents"), "doc_id"), path, "first", "doc_id")
    found = matching.search_index(
        matching.stored_index(spark, path), "doc_id", all_of=["the", "and"], any_of=["the", "hean"], none_of=["der"]
    )
    return found.withColumn("rank", steady("rank", 6))


def measure_texts(texts) -> np.ndarray:
    """A plain encoder SQL can state: length, commas and words of a text."""
    return np.array([[len(t), t.count(","), t.count(" ") + 1] for t in texts], dtype=float)


@query(
    "m9_researcher_vectors",
    f"""WITH {sql.LINKS}, {sql.TOPICS}, {sql.KEYWORDS},
    r AS (SELECT work_id, 0 AS part, topic_display_name AS label, score, topic_id AS label_id FROM topics WHERE score >= 0.3
          UNION ALL SELECT work_id, 1, keyword_display_name, score, keyword_id FROM keywords),
    t AS (SELECT work_id, string_agg(label, ', ' ORDER BY part, score DESC, label_id) AS text FROM r GROUP BY 1),
    v AS (SELECT author_id, avg(length(text)) AS x, avg(length(text) - length(replace(text, ',', ''))) AS y,
                 avg(length(text) - length(replace(text, ' ', '')) + 1) AS z FROM links l JOIN t ON t.work_id = l.work_id GROUP BY 1)
    SELECT author_id, round(x / sqrt(x * x + y * y + z * z) + 1e-9, 6) AS x, round(y / sqrt(x * x + y * y + z * z) + 1e-9, 6) AS y,
      round(z / sqrt(x * x + y * y + z * z) + 1e-9, 6) AS z FROM v""",
)
def m9(spark, sf):
    texts = reshape.work_text(adapters.topics(spark, sf), adapters.keywords(spark, sf))
    found = matching.researcher_vectors(texts, adapters.authorships(spark, sf), measure_texts)
    return found.select(
        "author_id", *[steady(F.col("vector")[i], 6).alias(n) for i, n in enumerate("xyz")]
    )
