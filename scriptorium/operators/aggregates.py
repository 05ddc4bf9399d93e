"""Aggregations.  Rows shrink in partial aggregates before every shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scriptorium.functions import calendar, text, vectors
from scriptorium.operators import reshape
from scriptorium.operators.joins import author_subfields, copublications, gathered_pairs, prior_solo
from scriptorium.session import materialize

# ---- fixed values --------------------------------------------------------------------
MIN_COPUBLICATIONS = 2
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 90}
YEARS_LOOKBACK = 5
#: Counter column of each activity class.
COUNTER_OF_CATEGORY = {
    "Enregistrements": "actions_records",
    "Questionnaires": "actions_surveys",
    "Fichiers": "actions_files",
    "Projet": "actions_project",
    "Utilisateurs": "actions_users",
    "API": "actions_api",
    "Authentification": "actions_auth",
    "Autre": "actions_other",
}
# -------------------------------------------------------------------------------------


# ---- citation ------------------------------------------------------------------------
def collab_pairs(authorships: DataFrame) -> DataFrame:
    """Number of works two authors share.  Pairs are distinct per work, so a count does."""
    return (
        gathered_pairs(authorships)
        .groupBy("author_a", "author_b")
        .agg(F.count(F.lit(1)).alias("co_publications"))
    )


def researcher_labels(
    authorships: DataFrame,
    topics: DataFrame,
    keywords: DataFrame,
    opposed: DataFrame | str | None = None,
    topic_min: float = reshape.SCORE_MINIMUM["topic"],
    keyword_min: float = reshape.SCORE_MINIMUM["keyword"],
) -> DataFrame:
    """Weighted label bag per (author, kind, label): sum of scores, number of works.

    Topic and keyword rows are filtered and united first, so the authorships are joined
    once, not once per kind.
    """

    def rows(df: DataFrame, kind: str, minimum: float) -> DataFrame:
        return reshape.threshold(df, kind, minimum).select(
            "work_id",
            F.lit(kind).alias("kind"),
            F.col(f"{kind}_id").cast("string").alias("label_id"),
            F.col(f"{kind}_display_name").cast("string").alias("label"),
            "score",
        )

    labels = rows(topics, "topic", topic_min).unionByName(rows(keywords, "keyword", keyword_min))
    links = authorships.select("work_id", "author_id").distinct()
    if opposed is not None:
        links = reshape.purge(links, opposed)
    # A label counts once per work, so after this sum a plain count is the distinct count.
    per_work = labels.groupBy("work_id", "kind", "label_id").agg(F.sum("score").alias("score"))
    weights = (
        per_work.join(links, "work_id")
        .groupBy("author_id", "kind", "label_id")
        .agg(F.sum("score").alias("weight"), F.count(F.lit(1)).alias("freq"))
    )
    return weights.join(names_of(labels, ["kind", "label_id"], "label"), ["kind", "label_id"]).select(
        "author_id", "kind", "label_id", "label", "weight", "freq"
    )


def names_of(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One label per key.

    Kept out of the big aggregations: a string minimum would force them to sort.
    """
    return df.select(*keys, label).distinct().groupBy(*keys).agg(F.min(label).alias(label))


def author_profiles(
    authorships: DataFrame, topics: DataFrame, scope: DataFrame, opposed: DataFrame | None = None
) -> DataFrame:
    """Subfield profile of an author: sum of topic scores and number of works."""
    links = authorships.select("work_id", "author_id").distinct()
    known = topics.where(F.col("subfield_id").isNotNull())
    per_work = known.groupBy("work_id", "subfield_id").agg(F.sum("score").alias("score"))
    names = names_of(
        known.withColumnRenamed("subfield_display_name", "subfield"), ["subfield_id"], "subfield"
    )
    return (
        author_subfields(links, per_work, scope, opposed)
        .groupBy("author_id", "subfield_id")
        .agg(F.sum("score").alias("weight"), F.count(F.lit(1)).alias("freq"))
        .join(names, "subfield_id")
        .select("author_id", "subfield_id", "subfield", "weight", "freq")
    )


def uplift_labels(
    works: DataFrame, authorships: DataFrame, minimum: int = MIN_COPUBLICATIONS
) -> DataFrame:
    """Mean uplift of each pair over its co-publications with a baseline on both sides.

    Every co-publication of a pair in one year has the same baseline, so the pair is
    summed per year first: uplift = (sum of impacts - sum of n * baseline) / sum of n.
    """
    solo = prior_solo(copublications(works, authorships))
    gain = F.sum(F.col("total") - F.col("n") * (F.col("solo_a") + F.col("solo_b")) / 2)
    return (
        solo.groupBy("author_a", "author_b")
        .agg((gain / F.sum("n")).alias("uplift"), F.sum("n").alias("n_copubs"))
        .where(F.col("n_copubs") >= minimum)
    )


def researcher_documents(labels: DataFrame) -> DataFrame:
    """One text per author: each label ``freq`` times, by weight desc, kind and id.

    The label is repeated inside its row; an author's list holds one entry per distinct
    label, not one per occurrence.
    """
    entry = F.struct(
        (-F.col("weight")).alias("rank"),
        "kind",
        "label_id",
        F.array_join(
            F.array_repeat(F.col("label"), F.col("freq").cast("int")), " "
        ).alias("words"),
    )
    return labels.groupBy("author_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["words"]), " "
        ).alias("doc_text")
    )


def affiliation_years(events: DataFrame, researcher: Column | str | None = None) -> DataFrame:
    """Accepted publication years of institutions: count per (label, year)."""
    kept = events.where(
        (F.col("entity") == "institution")
        & (F.col("field") == "publication_date")
        & (F.col("status") == reshape.ACCEPTED)
    )
    if researcher is not None:
        kept = kept.where(F.col("id") == researcher)
    return kept.groupBy(
        "id",
        F.coalesce("label", F.lit("unknown")).alias("affiliation"),
        F.col("value").alias("year"),
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- news and views ------------------------------------------------------------------
def university_timeline(mentions: DataFrame) -> DataFrame:
    """Distinct articles and mentions of a university per day."""
    return mentions.groupBy("university_id", "university_name", "event_date").agg(
        F.countDistinct("record_id").alias("n_articles"), F.count(F.lit(1)).alias("n_mentions")
    )


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Mentions of each candidate name, most mentioned first."""
    return (
        candidates.groupBy("org_name", "org_key")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            F.bool_or("translated").alias("seen_translated"),
        )
        .orderBy(F.desc("mention_count"), "org_name")
    )


def monthly_views(daily: DataFrame) -> DataFrame:
    """Views per university and month with the number of days seen."""
    return daily.groupBy(
        "university_id", calendar.bucket_date(F.col("view_date"), "month").alias("view_month")
    ).agg(
        F.sum("views").cast("bigint").alias("views"),
        F.countDistinct("view_date").alias("n_days"),
    )


def views_timeline(monthly: DataFrame) -> DataFrame:
    """The served projection of the monthly views."""
    return monthly.select("university_id", F.col("view_month").alias("month"), "views")


def ref_summary(referential: DataFrame) -> DataFrame:
    """Institutions, titled rows and languages with a title, in one row."""
    return referential.agg(
        F.countDistinct("university_id").alias("n_institutions"),
        F.count_if("has_wp").alias("n_titles"),
        F.countDistinct(F.when(F.col("has_wp"), F.col("lang"))).alias("n_langs"),
    )


# ---- activity ------------------------------------------------------------------------
def activity_counters() -> list[Column]:
    """The counters of a calendar point that add up over days."""
    category = F.col("action_category")
    return [
        F.count(F.lit(1)).alias("actions_total"),
        F.count_if(F.col("user_type") == text.RESPONDENT).alias("actions_surveyed_user"),
        *[
            F.count_if(category == label).alias(name)
            for label, name in COUNTER_OF_CATEGORY.items()
        ],
    ]


def activity_identities() -> dict[str, Column]:
    """What a point counts distinctly: logged users, respondents, projects."""
    logged = F.col("user_type") == text.LOGGED
    return {
        "users_logged": F.when(logged, F.col("username")),
        "users_surveyed": F.when(~logged, text.respondent_id(F.col("action"), F.col("username"))),
        "projects_active": F.col("project_id").cast("string"),
    }


POINT_COLUMNS = (
    "date",
    "users_total",
    "users_logged",
    "users_surveyed",
    "projects_active",
    "actions_total",
    "actions_surveyed_user",
    *COUNTER_OF_CATEGORY.values(),
)


def calendar_kpis(logs: DataFrame, grain: str = "month", rollup: bool = False) -> DataFrame:
    """Activity per day, ISO week, month or quarter.

    ``logs`` are cleaned log entries.  Identities are made distinct per bucket before
    they are counted, so no map task ships a user twice and no bucket's identities meet
    in one task unaggregated.  ``rollup`` adds a grand-total row with a null date.
    """
    bucket = calendar.bucket_date(F.col("timestamp"), grain).alias("date")
    identities = activity_identities()
    seen = (
        logs.select(
            bucket,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("what"), value.alias("who"))
                        for name, value in identities.items()
                    ]
                )
            ).alias("i"),
        )
        .select("date", "i.what", "i.who")
        .where(F.col("who").isNotNull())
    )

    def distinct_counts(df: DataFrame) -> DataFrame:
        return df.select(
            "date", *[F.when(F.col("what") == n, F.lit(1)).alias(n) for n in identities]
        ).groupBy("date").agg(*[F.count(n).alias(n) for n in identities])

    people = distinct_counts(seen.distinct())
    actions = logs.select(bucket, "user_type", "action_category").groupBy("date").agg(
        *activity_counters()
    )
    points = actions.join(people, "date", "left")
    if rollup:
        everyone = distinct_counts(
            seen.select(F.lit(None).cast("date").alias("date"), "what", "who").distinct()
        )
        total = actions.agg(
            F.lit(None).cast("date").alias("date"),
            *[F.sum(c).alias(c) for c in actions.columns if c != "date"],
        )
        points = points.unionByName(
            total.join(everyone, total["date"].eqNullSafe(everyone["date"])).drop(everyone["date"])
        )
    return points.withColumn(
        "users_total", F.col("users_logged") + F.col("users_surveyed")
    ).select(*POINT_COLUMNS)


# ---- review events -------------------------------------------------------------------
STATUSES = (reshape.ACCEPTED, reshape.PENDING, reshape.REJECTED)


def status_counts(
    events: DataFrame, by: Sequence[str] = ("id", "entity", "field"), distinct_values: bool = False
) -> DataFrame:
    """Events (or distinct values) per status and group."""
    def count(status: str) -> Column:
        hit = F.col("status") == status
        if distinct_values:
            return F.countDistinct(F.when(hit, F.col("value")))
        return F.count_if(hit)

    return events.groupBy(*by).agg(*[count(s).alias(s) for s in STATUSES])


def id_verdict(events: DataFrame) -> DataFrame:
    """Overall status of each catalogue id of a researcher.

    Accepted when affiliation, name and work were all accepted at least once; otherwise
    pending when anything is accepted or pending; otherwise rejected.
    """
    is_author, is_work = F.col("entity") == "author", F.col("entity") == "work"
    aspects = {
        "affiliation": is_author & (F.col("field") == "affiliation"),
        "name": is_author & (F.col("field") == "display_name_alternatives"),
        "work": is_work & (F.col("field") == "id"),
    }
    relevant = events.where(aspects["affiliation"] | aspects["name"] | aspects["work"])
    flags = relevant.groupBy("id", "from").agg(
        *[
            F.bool_or(test & (F.col("status") == reshape.ACCEPTED)).alias(name)
            for name, test in aspects.items()
        ],
        F.bool_or(F.col("status").isin(reshape.ACCEPTED, reshape.PENDING)).alias("alive"),
    )
    return flags.select(
        "id",
        "from",
        F.when(F.col("affiliation") & F.col("name") & F.col("work"), reshape.ACCEPTED)
        .when(F.col("alive"), reshape.PENDING)
        .otherwise(reshape.REJECTED)
        .alias("verdict"),
    )


# ---- profiles and vectors ------------------------------------------------------------
def tfidf(dims: DataFrame, key: str = "researcher_id") -> DataFrame:
    """Term weight times smoothed inverse document frequency ``ln(N / (df + 1) + 1)``.

    ``dims`` is computed once, into a table that frequencies, labels and the number of keys read.
    """
    stored = materialize(dims.select(key, "dim", "label", "score"), "dims")
    tf = stored.groupBy(key, "dim").agg(F.sum("score").alias("tf"))
    df = names_of(stored, ["dim"], "label").join(tf.groupBy("dim").agg(F.count(F.lit(1)).alias("df")), "dim")
    n = stored.agg(F.countDistinct(key).alias("n")).scalar()
    idf = F.log(n / (F.col("df") + 1) + 1)
    return tf.join(df, "dim").select(key, "dim", "label", (F.col("tf") * idf).alias("weight"))


def l2_normalize(df: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """Weights of each key divided by their Euclidean norm; an all-zero key is unchanged."""
    size = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(key)))
    return df.withColumn("_norm", size).withColumn(
        weight,
        F.when(F.col("_norm") == 0, F.col(weight)).otherwise(F.col(weight) / F.col("_norm")),
    ).drop("_norm")


def mean_pool(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Unit mean vector per key.

    The mean is an aggregate with map-side partial sums; vectors are never exploded into
    elements nor collected per key.  A zero mean stays zero.
    """
    pooled = (
        df.where(F.col(vector).isNotNull())
        .select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
        .groupBy(key)
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(vector))
    )
    return pooled.select(key, vectors.normalize(F.col(vector)).alias(vector))


def vector_coverage(authors: DataFrame, vecs: DataFrame, vector: str = "vector") -> DataFrame:
    """Authors, authors with a usable vector, and zero vectors, in one row."""
    usable = vectors.norm(F.col(vector)) > vectors.ZERO_NORM
    marked = authors.select("author_id").distinct().join(
        vecs.select("author_id", F.coalesce(usable, F.lit(False)).alias("usable")),
        "author_id",
        "left",
    )
    return marked.agg(
        F.count(F.lit(1)).alias("n_authors"),
        F.count_if("usable").alias("n_with_vector"),
        F.count_if(~F.col("usable")).alias("n_zero_vectors"),
    )


def regression_metrics(
    df: DataFrame,
    observed: str = "y",
    predicted: str = "prediction",
    baseline: str = "baseline",
    by: Sequence[str] = (),
) -> DataFrame:
    """R2 (0 when the observations do not vary), MAE and MAE of a baseline column."""
    y = F.col(observed)
    residual = F.sum(F.pow(y - F.col(predicted), 2))
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.when(total > 0, 1 - residual / total).otherwise(F.lit(0.0)).alias("r2"),
        F.avg(F.abs(y - F.col(predicted))).alias("mae"),
        F.avg(F.abs(y - F.col(baseline))).alias("baseline_mae"),
        F.count(F.lit(1)).alias("n_obs"),
    )


# ---- packages and commits ------------------------------------------------------------
def package_stats(
    releases: DataFrame,
    packages: DataFrame,
    downloads: DataFrame,
    today: Column,
    periods: Sequence[str] = tuple(PERIOD_DAYS),
) -> tuple[DataFrame, DataFrame]:
    """(KPIs, a row per period; per-package rows of each period) over trailing days ending today.

    ``releases``: tag_name, published_at.  ``packages``: name, version, date.
    ``downloads``: name, day, downloads.  A package's row has ``daily_downloads``, its points by day,
    at most one a day of the period.  Downloads are read once: the points of the longest period
    are summed by day, and each period keeps its part of them.
    """
    starts = F.array(
        *[F.struct(F.lit(p).alias("period"), F.date_sub(today, PERIOD_DAYS[p] - 1).alias("start")) for p in periods]
    )
    first = F.date_sub(today, max(PERIOD_DAYS[p] for p in periods) - 1)
    points = (
        downloads.where(F.col("day") >= first)
        .groupBy("name", "day")
        .agg(F.sum("downloads").alias("downloads"))
        .groupBy("name")
        .agg(F.sort_array(F.collect_list(F.struct("day", "downloads"))).alias("points"))
    )
    kept = F.filter("points", lambda p: p["day"] >= F.col("start"))
    rows = (
        packages.join(points, "name", "left")
        .select("*", F.inline(starts))
        .withColumn("daily_downloads", F.coalesce(kept, F.expr("array()")))
        .select(
            "period",
            "name",
            "version",
            F.col("date").alias("last_published_at"),
            "daily_downloads",
            F.aggregate("daily_downloads", F.lit(0).cast("bigint"), lambda sum_, p: sum_ + p["downloads"]).alias("total_downloads"),
            (F.col("date") >= F.col("start")).alias("active"),
        )
    )
    kpi = rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("packages_total"),
        F.count_if("active").alias("packages_active"),
        F.sum("total_downloads").alias("downloads_total"),
    )
    spans = releases.sparkSession.range(1).select(F.inline(starts))
    published = (
        releases.where(F.col("published_at") >= first)
        .select("published_at", F.inline(starts))
        .where(F.col("published_at") >= F.col("start"))
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("releases"))
    )
    nothing = [F.coalesce(c, F.lit(0)).alias(c) for c in ("packages_total", "packages_active", "downloads_total", "releases")]
    return (
        spans.join(kpi, "period", "left").join(published, "period", "left").select("period", *nothing),
        rows.drop("active").orderBy("period", F.desc("total_downloads"), "name"),
    )


def release_counts(releases: DataFrame, names: DataFrame, scope: str = "@scope/") -> DataFrame:
    """Releases per known package, from ``name@version`` tags.

    The name is what precedes the last ``@``; a bare name also matches inside ``scope``,
    and a scoped name whose ``@`` was dropped matches with it.
    """
    bare = scope.removeprefix("@")
    tag = releases.select(F.trim(F.regexp_extract("tag_name", "^(.+)@", 1)).alias("tag")).where(
        F.col("tag") != ""
    )
    counts = tag.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    guesses = counts.select(
        "n",
        "tag",
        F.posexplode(
            F.array_compact(
                F.array(
                    F.col("tag"),
                    F.when(~F.col("tag").startswith("@"), F.concat(F.lit(scope), F.col("tag"))),
                    F.when(F.col("tag").startswith(bare), F.concat(F.lit("@"), F.col("tag"))),
                )
            )
        ).alias("rank", "name"),
    )
    known = guesses.join(names.select("name").distinct(), "name", "left_semi")
    chosen = known.groupBy("tag", "n").agg(F.min_by("name", "rank").alias("name"))
    return chosen.groupBy("name").agg(F.sum("n").alias("releases"))


def commits_by_hour(commits: DataFrame) -> DataFrame:
    """Commits, changed lines, files and the authors of each hour."""
    return commits.groupBy(
        F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd'T'HH").alias("period")
    ).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.sum("files_changed").alias("files_changed"),
        F.sort_array(F.collect_set("author")).alias("authors"),
    )


def commit_totals(commits: DataFrame) -> DataFrame:
    """Changed lines and files, first and last commit."""
    return commits.agg(
        F.sum("additions").alias("total_additions"),
        F.sum("deletions").alias("total_deletions"),
        F.sum("files_changed").alias("total_files_changed"),
        F.min("timestamp").alias("first_commit"),
        F.max("timestamp").alias("last_commit"),
    )


# ---- institution scoreboards -----------------------------------------------------------
def articles_by_year(works: DataFrame, current_year: int, back: int = YEARS_LOOKBACK) -> DataFrame:
    """Articles per year of the window, zero filled, plus a ``before`` bucket.

    Years after ``current_year`` do not count.
    """
    oldest = current_year - back
    year = F.col("publication_year")
    counted = (
        works.where((F.col("type") == "article") & (year <= current_year))
        .groupBy(
            F.when(year < oldest, F.lit("before")).otherwise(year.cast("string")).alias("year")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    labels = ["before", *[str(y) for y in range(oldest, current_year + 1)]]
    spine = works.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in labels])).alias("year")
    )
    return spine.join(counted, "year", "left").select(
        "year", F.coalesce("n", F.lit(0)).alias("n")
    )


def institution_stats(
    works: DataFrame, ids: Sequence[str], current_year: int, back: int = YEARS_LOOKBACK, field: str = "ror"
) -> DataFrame:
    """Works and articles of the window and distinct affiliated authors, in one row."""
    oldest = current_year - back
    in_scope = reshape.filter_scope(works, ids, field=field)
    window = F.col("publication_year").between(oldest, current_year)
    counts = in_scope.agg(
        F.count_if(window).alias("works_count"),
        F.count_if(window & (F.col("type") == "article")).alias("articles_count"),
    )
    authors = reshape.affiliated_authors(works, ids, field).agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("authors_count", authors)


def works_count(works: DataFrame, ids: Sequence[str], since: Column, field: str = "ror") -> DataFrame:
    """Articles of any of the institutions published since a date."""
    kept = reshape.filter_scope(
        works.where((F.col("publication_date") >= since) & (F.col("type") == "article")),
        ids,
        field=field,
    )
    return kept.agg(F.count(F.lit(1)).alias("works_count"))
