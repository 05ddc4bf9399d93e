"""Common table expressions that state ``plans.adapters`` in SQL."""

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

WORKS = """works AS (
  SELECT o_orderkey AS work_id, CAST(year(o_orderdate) AS INT) AS publication_year,
         CAST(o_orderdate AS DATE) AS publication_date,
         concat(o_orderpriority, ' ', o_orderkey) AS title,
         CASE o_orderstatus WHEN 'F' THEN 'article' WHEN 'O' THEN 'book' ELSE 'review' END AS type,
         o_totalprice / 1e5 AS fwci, o_custkey AS cited_by_count,
         CAST(o_orderdate AS DATE) AS updated_date,
         concat('10.1234/ABC', o_orderkey % 200) AS doi
  FROM orders)"""

AUTHORSHIPS = """authorships AS (
  SELECT l_orderkey AS work_id, l_suppkey AS author_id,
         CAST(l_linenumber AS VARCHAR) AS author_position, l_linenumber = 1 AS is_corresponding
  FROM lineitem)"""

LINKS = AUTHORSHIPS + """, links AS (SELECT DISTINCT work_id, author_id FROM authorships)"""

TOPICS = """topics AS (
  SELECT l_orderkey AS work_id, p_brand AS topic_id, concat('Topic ', p_brand) AS topic_display_name,
         round(1 - l_discount * 8, 4) + 0.0::DOUBLE AS score,
         p_type AS subfield_id, concat('Subfield ', p_type) AS subfield_display_name,
         concat('F', p_size // 10) AS field_id, concat('Field ', p_size // 10) AS field_display_name,
         concat('D', p_size % 3) AS domain_id, concat('Domain ', p_size % 3) AS domain_display_name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

KEYWORDS = """keywords AS (
  SELECT work_id, keyword_id, concat('Keyword ', keyword_id) AS keyword_display_name, score
  FROM (SELECT l_orderkey AS work_id, unnest(string_split(p_name, ' ')) AS keyword_id,
               round(l_tax * 10, 4) + 0.0::DOUBLE AS score
        FROM lineitem JOIN part ON l_partkey = p_partkey))"""

#: Authorship lines with the institution of the author, as exploded from nested works.
AFFILIATIONS = """affiliations AS (
  SELECT l_orderkey AS work_id, l_suppkey AS author_id, s_nationkey AS nation, s_name AS author_name,
         l_linenumber AS line
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_orderkey IN (SELECT o_orderkey FROM orders))"""

# ---- activity ------------------------------------------------------------------------
def _logs(source: str, user: str, k: str, ts: str, position: str) -> str:
    """Log entries made from the rows of a table."""
    return f"""logs0 AS (
  SELECT CAST({user} % 7 AS INT) AS project_id,
         CAST(date_trunc('milliseconds', {ts}) AS TIMESTAMP) AS ts, {position} AS position,
         CASE {user} % 5 WHEN 0 THEN md5(CAST({user} AS VARCHAR))
              WHEN 1 THEN '[survey respondent]' ELSE concat('user_', {user}) END AS username,
         {k} AS k, {user} AS user_id
  FROM {source}),
logs1 AS (
  SELECT *, CASE k % 10
      WHEN 0 THEN 'Login depuis la page' WHEN 1 THEN 'API export record'
      WHEN 2 THEN 'Modifier utilisateur: rôle' WHEN 3 THEN 'Paramètres du Projet'
      WHEN 4 THEN concat('Réponse créée R-', user_id) WHEN 5 THEN 'Téléchargement du fichier'
      WHEN 6 THEN concat('Enregistrement ', k, ' mise à jour') WHEN 7 THEN concat('Enreg. ', k)
      WHEN 8 THEN 'Mise à jour' ELSE 'Page view' END AS action,
    CASE WHEN user_id % 5 <= 1 THEN 'enquêté' ELSE 'loggé' END AS user_type
  FROM logs0),
logs AS (
  SELECT *, CASE k % 10
      WHEN 0 THEN 'Authentification' WHEN 1 THEN 'API' WHEN 2 THEN 'Utilisateurs' WHEN 3 THEN 'Projet'
      WHEN 4 THEN 'Questionnaires' WHEN 5 THEN 'Fichiers' WHEN 6 THEN 'Enregistrements'
      WHEN 8 THEN 'Enregistrements' ELSE 'Autre' END AS action_category,
    CASE k % 10 WHEN 4 THEN concat('r-', user_id) WHEN 6 THEN CAST(k AS VARCHAR)
      WHEN 7 THEN CAST(k AS VARCHAR) ELSE concat('user:', username) END AS respondent
  FROM logs1)"""


LOGS = _logs("events", "user_id", K, "ts", "event_id")
ORDER_LOGS = _logs(
    "orders", "o_custkey", "CAST(o_orderkey % 97 AS INT)",
    "CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 4 * 6 AS INT))", "o_orderkey",
)

REVIEW = f"""review AS (
  SELECT concat('A', {K} % 20) AS "from", concat('O', user_id % 50) AS id,
         CASE WHEN {K} % 5 <= 1 THEN 'author' WHEN {K} % 5 = 2 THEN 'work' ELSE 'institution' END AS entity,
         CASE {K} % 5 WHEN 0 THEN 'affiliation' WHEN 2 THEN 'id' WHEN 4 THEN 'publication_date'
              ELSE 'display_name_alternatives' END AS field,
         CASE WHEN {K} % 5 = 4 THEN CAST({K} % 10 + 2010 AS VARCHAR) ELSE concat('V', user_id % 7) END AS value,
         CASE WHEN {K} % 5 = 4 AND {K} % 3 <> 0 THEN concat('Lab ', user_id % 4) END AS label,
         CASE WHEN (user_id % 50 + {K} % 20) % 7 = 0 THEN 'rejected' WHEN event_type IN ('click', 'purchase') THEN 'accepted'
              WHEN event_type IN ('view', 'signup') THEN 'pending' ELSE 'rejected' END AS status,
         CASE WHEN value > 100 THEN strftime(ts, '%Y-%m-%d') ELSE 'never' END AS extended,
         event_id AS position
  FROM events)"""

COMMITS = """commits AS (
  SELECT l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS ts, concat('dev', l_suppkey % 10) AS author,
         CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions,
         l_partkey % 5 + 1 AS files_changed
  FROM lineitem)"""

# ---- news and views --------------------------------------------------------------------
#: One row per document and distinct organisation.
MENTIONS = f"""docs AS (
  SELECT CAST(event_id AS VARCHAR) AS record_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CAST(ts AS DATE) AS day,
         concat(event_type, '.example') AS source_name, concat('http://example.org/', event_id) AS url,
         event_type = 'signup' AS translated, user_id, {K} AS k
  FROM events WHERE {K} % 11 <> 0),
mentions AS (
  SELECT record_id, stamp, day, source_name, url, translated, concat('University of Nation ', user_id % 25) AS org,
         concat('university of nation ', user_id % 25) AS org_key FROM docs
  UNION ALL
  SELECT record_id, stamp, day, source_name, url, translated, concat('Acme, Corp ', k % 5),
         concat('acme corp ', k % 5) FROM docs
  UNION ALL
  SELECT record_id, stamp, day, source_name, url, translated, concat('Université Nationale ', k % 10, ', Campus'),
         concat('universite nationale ', k % 10, ' campus') FROM docs WHERE k % 4 = 0)"""

REFERENTIAL = """referential AS (
  SELECT concat('U', n_nationkey) AS university_id, concat('University of Nation ', n_nationkey) AS university_name,
         r_name AS country, concat('university of nation ', n_nationkey) AS org_key
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

VIEWS = f"""raw_views AS (
  SELECT concat('U', user_id % 25) AS university_id, CAST(ts AS DATE) AS view_date,
         concat('Page ', event_type) AS page_title, event_id,
         CASE WHEN {K} % 17 = 0 THEN NULL WHEN {K} % 19 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS views
  FROM events),
views AS (
  SELECT university_id, view_date, page_title, coalesce(views, 0) AS views FROM (
    SELECT *, row_number() OVER (PARTITION BY university_id, view_date, page_title ORDER BY event_id DESC) AS rn
    FROM raw_views WHERE coalesce(views, 0) >= 0) WHERE rn = 1)"""

# ---- series ----------------------------------------------------------------------------
DAILY = """points AS (
  SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2),
spine AS (
  SELECT key, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT key, min(d) AS lo, max(d) AS hi FROM points GROUP BY key)),
dense AS (
  SELECT s.key, s.d, coalesce(p.n, 0) AS n,
         row_number() OVER (PARTITION BY s.key ORDER BY s.d) - 1 AS t
  FROM spine s LEFT JOIN points p ON p.key = s.key AND p.d = s.d)"""

MONTHLY = """points AS (
  SELECT c_nationkey AS key, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
spine AS (
  SELECT key, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS d
  FROM (SELECT key, min(d) AS lo, max(d) AS hi FROM points GROUP BY key)),
dense AS (
  SELECT s.key, s.d, coalesce(p.n, 0) AS n,
         row_number() OVER (PARTITION BY s.key ORDER BY s.d) - 1 AS t
  FROM spine s LEFT JOIN points p ON p.key = s.key AND p.d = s.d)"""

FILES = """files AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS dt, concat('r', o_custkey % 40) AS run, o_orderdate AS modified
  FROM orders WHERE o_orderkey % 13 <> 0),
runs AS (SELECT dt, run, max(modified) AS modified FROM files GROUP BY dt, run)"""

STRINGS = """strings AS (
  SELECT p_partkey AS position,
         CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-')
              ELSE concat(p_name, 's') END AS value
  FROM part)"""
