"""Projections, filters and row reshaping.  None of these shuffles unless it says so."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.functions import calendar, text

# ---- fixed values: thresholds, bands, labels -----------------------------------------
SCORE_MINIMUM = {"topic": 0.5, "keyword": 0.2, "text": 0.3}
WORKS_BANDS = ((1_000, "xs"), (5_000, "s"), (20_000, "m"), (100_000, "l"))
WORKS_BAND_REST = "xl"
EDUCATION = "education"
DISPLAY_NAME_TYPE = "ror_display"
ACTION_COUNTERS = (
    "actions_records",
    "actions_surveys",
    "actions_files",
    "actions_project",
    "actions_users",
    "actions_api",
    "actions_auth",
    "actions_other",
)
PENDING, ACCEPTED, REJECTED = "pending", "accepted", "rejected"
#: Occurrences counted in source and in test files.
SOURCE_PATTERNS = {
    "constants": r"export\s+const\s+\w+\s*[=:]",
    "functions": r"export\s+(?:const\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"
    r"|function\s+\w+)",
    "types": r"export\s+(?:type|interface)\s+\w+",
}
TEST_PATTERNS = {
    "describes": "describe\\s*\\(\\s*['\"`]",
    "tests": "(?:it|test)\\s*\\(\\s*['\"`]",
}
# -------------------------------------------------------------------------------------



# ---- nested works --------------------------------------------------------------------
def explode_authorships(works: DataFrame) -> DataFrame:
    """(work, author, position, corresponding); authorships without author id dropped."""
    return (
        works.select("work_id", F.explode("authorships").alias("a"))
        .where(F.col("a.author.id").isNotNull())
        .select(
            "work_id",
            F.col("a.author.id").alias("author_id"),
            F.col("a.author_position").alias("author_position"),
            F.coalesce("a.is_corresponding", F.lit(False)).alias("is_corresponding"),
        )
    )


def explode_topics(works: DataFrame) -> DataFrame:
    """One row per topic of a work with its subfield, field and domain."""
    levels = [
        column
        for level in ("subfield", "field", "domain")
        for column in (
            F.col(f"t.{level}.id").alias(f"{level}_id"),
            F.col(f"t.{level}.display_name").alias(f"{level}_display_name"),
        )
    ]
    return (
        works.select("work_id", F.explode("topics").alias("t"))
        .where(F.col("t.id").isNotNull())
        .select(
            "work_id",
            F.col("t.id").alias("topic_id"),
            F.col("t.display_name").alias("topic_display_name"),
            F.col("t.score").cast("double").alias("score"),
            *levels,
        )
    )


def explode_keywords(works: DataFrame) -> DataFrame:
    """One row per keyword of a work."""
    return (
        works.select("work_id", F.explode("keywords").alias("k"))
        .where(F.col("k.id").isNotNull())
        .select(
            "work_id",
            F.col("k.id").alias("keyword_id"),
            F.col("k.display_name").alias("keyword_display_name"),
            F.col("k.score").cast("double").alias("score"),
        )
    )


def stage_works(works: DataFrame) -> DataFrame:
    """Typed scalar columns of the works; blank titles become null."""
    return works.select(
        "work_id",
        F.col("publication_year").cast("int").alias("publication_year"),
        text.blank_to_null(F.col("title")).alias("title"),
        F.col("cited_by_count").cast("bigint").alias("cited_by_count"),
        F.col("fwci").cast("double").alias("fwci"),
    )


def _ids_table(works: DataFrame, ids: Sequence | DataFrame, name: str) -> DataFrame:
    """Distinct ids as a one-column table, from a list or from the first column of a table."""
    if isinstance(ids, DataFrame):
        table = ids.select(F.col(ids.columns[0]).cast("string").alias(name))
    else:
        table = works.sparkSession.createDataFrame([(i,) for i in ids], f"{name} string")
    return table.where(F.col(name).isNotNull()).distinct()


def filter_scope(
    works: DataFrame, ids: Sequence | DataFrame, min_year: int | None = None, field: str = "ror"
) -> DataFrame:
    """Works with any institution in ``ids`` (a list or a table of any length) since ``min_year``.

    The year reaches the Parquet scan.  Only work and institution ids meet the scope; a work
    matches once, however many of its institutions are in scope.
    """
    kept = works if min_year is None else works.where(F.col("publication_year") >= min_year)
    links = kept.select("work_id", F.explode("authorships").alias("a")).select(
        "work_id", F.explode(F.col("a.institutions")[field]).alias("_scope")
    )
    found = links.join(_ids_table(works, ids, "_scope"), "_scope", "left_semi").select("work_id").distinct()
    return kept.join(found, "work_id", "left_semi")


def affiliated_authors(works: DataFrame, ids: Sequence | DataFrame, field: str = "ror") -> DataFrame:
    """Distinct authors with an affiliation in ``ids`` (a list or a table of any length)."""
    links = (
        works.select(F.explode("authorships").alias("a"))
        .select(F.col("a.author.id").alias("author_id"), F.explode(F.col("a.institutions")[field]).alias("_scope"))
        .where(F.col("author_id").isNotNull())
    )
    return links.join(_ids_table(works, ids, "_scope"), "_scope", "left_semi").select("author_id").distinct()


def prefilter(works: DataFrame, min_year: int = 2016, kind: str = "article") -> DataFrame:
    """Works of one type since a year; both predicates reach the scan."""
    return works.where((F.col("publication_year") >= min_year) & (F.col("type") == kind))


def normalized_works(works: DataFrame, minimum: float = SCORE_MINIMUM["text"]) -> DataFrame:
    """Works with their topics of sufficient score and all keywords, still nested."""
    return works.select(
        "work_id",
        F.transform(
            F.filter("topics", lambda t: t["score"] >= minimum),
            lambda t: F.struct(
                t["id"].alias("topic_id"),
                t["display_name"].alias("topic_label"),
                t["subfield"]["id"].alias("subfield_id"),
                t["subfield"]["display_name"].alias("subfield_label"),
                t["field"]["id"].alias("field_id"),
                t["field"]["display_name"].alias("field_label"),
                t["domain"]["id"].alias("domain_id"),
                t["domain"]["display_name"].alias("domain_label"),
                t["score"].alias("score"),
            ),
        ).alias("topics"),
        F.transform(
            F.coalesce("keywords", F.array().cast(works.schema["keywords"].dataType)),
            lambda k: F.struct(
                k["id"].alias("keyword_id"),
                k["display_name"].alias("keyword_label"),
                k["score"].alias("score"),
            ),
        ).alias("keywords"),
    )


def profile_dims(
    topics: DataFrame, keywords: DataFrame | None = None, key: str = "researcher_id"
) -> DataFrame:
    """Exploded topics (and keywords) of researchers to prefixed profile dimensions.

    Each topic row yields one row per level, ``topic::``, ``subfield::``, ``field::`` and
    ``domain::``; each keyword row yields ``keyword::``.
    """

    def entry(level: str, identifier: Column, label: Column) -> Column:
        return F.struct(
            F.concat(F.lit(f"{level}::"), identifier.cast("string")).alias("dim"),
            label.cast("string").alias("label"),
        )

    levels = F.array(
        *[
            entry(level, F.col(f"{level}_id"), F.col(f"{level}_display_name"))
            for level in ("topic", "subfield", "field", "domain")
        ]
    )
    dims = topics.select(key, "score", F.explode(levels).alias("d")).select(
        key, "d.dim", "d.label", "score"
    )
    if keywords is None:
        return dims
    return dims.unionByName(
        keywords.select(
            key,
            entry("keyword", F.col("keyword_id"), F.col("keyword_display_name")).alias("d"),
            "score",
        ).select(key, "d.dim", "d.label", "score")
    )


def work_text(
    topics: DataFrame, keywords: DataFrame, minimum: float = SCORE_MINIMUM["text"]
) -> DataFrame:
    """(work, text): topic labels then keyword labels, each by score desc and id.

    Works with labels only; a work has few labels, so its ordered list is small.  One
    union and one aggregation instead of two aggregations and an outer join.
    """
    rows = (
        topics.where(F.col("score") >= minimum)
        .select(
            "work_id",
            F.lit(0).alias("part"),
            F.col("topic_display_name").cast("string").alias("label"),
            "score",
            F.col("topic_id").cast("string").alias("label_id"),
        )
        .unionByName(
            keywords.select(
                "work_id",
                F.lit(1).alias("part"),
                F.col("keyword_display_name").cast("string").alias("label"),
                "score",
                F.col("keyword_id").cast("string").alias("label_id"),
            )
        )
    )
    entry = F.struct("part", (-F.col("score")).alias("rank"), "label_id", "label")
    return rows.groupBy("work_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["label"]), ", "
        ).alias("text")
    )


def threshold(df: DataFrame, kind: str, minimum: float | None = None) -> DataFrame:
    """Keep scores at or above the minimum of a kind; applied before aggregation."""
    return df.where(F.col("score") >= (SCORE_MINIMUM[kind] if minimum is None else minimum))


def purge(links: DataFrame, opposed: DataFrame | str) -> DataFrame:
    """Drop the (author, work) pairs somebody opposed; an empty list changes nothing.

    ``opposed`` is a table of pairs, or their JSON array.  A literal list is broadcast
    only while its text is small.
    """
    if isinstance(opposed, str):
        parsed = links.sparkSession.range(1).select(
            F.explode(F.from_json(F.lit(opposed), schemas.OPPOSITION)).alias("p")
        )
        pairs = parsed.select(
            F.col("p.author_id").cast(links.schema["author_id"].dataType).alias("author_id"),
            F.col("p.work_id").cast(links.schema["work_id"].dataType).alias("work_id"),
        )
    else:
        pairs = opposed.select("author_id", "work_id")
    return links.join(pairs, ["author_id", "work_id"], "left_anti")


def format_reference(
    title: Column,
    year: Column,
    authors: Column | None = None,
    doi: Column | None = None,
    work_id: Column | None = None,
) -> Column:
    """``year - title``; with authors, DOI and id the full citation."""
    if authors is None:
        return F.concat(year.cast("string"), F.lit(" - "), title)
    return F.concat(
        F.array_join(authors, ", "),
        F.lit(" ("),
        year.cast("string"),
        F.lit("). "),
        title,
        F.lit(". DOI: "),
        doi,
        F.lit(". OpenAlex ID: "),
        work_id,
    )


# ---- news ----------------------------------------------------------------------------
def mentions(native: DataFrame) -> DataFrame:
    """Native news rows to one row per organisation of a document."""
    return (
        native.where((F.trim("gkg_record_id") != "") & (F.trim("v21_date") != ""))
        .select(
            F.trim("gkg_record_id").alias("record_id"),
            F.trim("v21_date").alias("date"),
            F.explode(text.split_orgs(F.col("v2_enhanced_organizations"))).alias("organization"),
            F.trim("v2_source_common_name").alias("source_common_name"),
            F.trim("v2_document_identifier").alias("document_identifier"),
            (F.trim("v21_translation_info") != "").alias("translated"),
        )
    )


def stage_mentions(raw: DataFrame) -> DataFrame:
    """Typed mentions with the event date and the matching key of the organisation."""
    return raw.where(text.blank_to_null(F.col("organization")).isNotNull()).select(
        "record_id",
        F.col("date").alias("gkg_timestamp"),
        calendar.stamp_to_date(F.col("date")).alias("event_date"),
        text.blank_to_null(F.col("organization")).alias("org_name"),
        text.match_key(F.col("organization")).alias("org_key"),
        text.blank_to_null(F.col("source_common_name")).alias("source_name"),
        text.blank_to_null(F.col("document_identifier")).alias("document_url"),
        F.coalesce("translated", F.lit(False)).alias("translated"),
    )


# ---- referential ---------------------------------------------------------------------
def project_universities(registry: DataFrame) -> DataFrame:
    """Registry records of type education to (university_id, name, country).

    The name is the flagged display name, else the first non-blank one; the country is
    that of the first location.  Records without id or name, or with a malformed type,
    drop out.
    """
    spoken = F.filter(
        F.transform(
            "names", lambda n: F.struct(F.trim(n["value"]).alias("value"), n["types"].alias("types"))
        ),
        lambda n: n["value"] != "",
    )
    flagged = F.filter(spoken, lambda n: F.array_contains(n["types"], DISPLAY_NAME_TYPE))
    name = F.coalesce(F.get(flagged, 0)["value"], F.get(spoken, 0)["value"])
    country = F.get(F.col("locations"), 0)["geonames_details"]["country_code"]
    return (
        registry.where(F.array_contains("types", EDUCATION))
        .select(
            F.trim("id").alias("university_id"),
            name.alias("name"),
            F.coalesce(F.trim(country), F.lit("")).alias("country"),
        )
        .where((F.col("university_id") != "") & F.col("name").isNotNull())
    )


def works_band(count: Column) -> Column:
    """Volume band of a publication count; negative counts fall in the first band."""
    out = F.lit(WORKS_BAND_REST)
    for upper, label in reversed(WORKS_BANDS):
        out = F.when(count < upper, F.lit(label)).otherwise(out)
    return out


# ---- activity logs -------------------------------------------------------------------
def clean_logs(raw: DataFrame) -> DataFrame:
    """Entries with a readable timestamp (to the millisecond), clean user, and classes."""
    stamp = (
        F.try_to_timestamp("timestamp")
        if dict(raw.dtypes)["timestamp"] == "string"
        else F.col("timestamp").cast("timestamp")
    )
    return (
        raw.withColumn("timestamp", F.date_trunc("millisecond", stamp))
        .where(F.col("timestamp").isNotNull())
        .withColumn("username", F.trim(F.lower("username")))
        .withColumn("user_type", text.user_type(F.col("username")))
        .withColumn("action_category", text.action_category(F.col("action")))
    )


def unpivot_actions(points: DataFrame, by: str = "date") -> DataFrame:
    """The eight action counters of a point to (date, category, value) rows."""
    return points.unpivot([by], list(ACTION_COUNTERS), "category", "value")


# ---- review events -------------------------------------------------------------------
def filter_by(df: DataFrame, attributes: Mapping[str, object]) -> DataFrame:
    """Rows equal on every given attribute; none given keeps all."""
    for name, value in attributes.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def decide(
    events: DataFrame,
    accepted: Iterable[str] | DataFrame,
    attributes: Mapping[str, object] | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Pending events (of the attributes) become accepted when their value is, else rejected.

    ``accepted``: a list or a one-column table of values, of any length.
    """
    values = _ids_table(events, accepted if isinstance(accepted, DataFrame) else list(accepted), "_value")
    pending = filter_by(events, {**(attributes or {}), "status": PENDING}).join(
        values, F.col("value") == F.col("_value"), "left"
    )
    member = F.col("_value").isNotNull()
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return pending.withColumn(
        "status", F.when(member, F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))
    ).withColumn("updatedAt", stamp if now is None else now).drop("_value")


def _pending_event(df: DataFrame, entity: str, field: str, value: Column, label: Column) -> DataFrame:
    return df.select(
        "from",
        "id",
        F.lit(entity).alias("entity"),
        F.lit(field).alias("field"),
        value.alias("value"),
        label.alias("label"),
        F.lit(PENDING).alias("status"),
    )


def author_events(authors: DataFrame) -> DataFrame:
    """Author records to pending events: one per alternative name and per affiliation.

    ``authors``: from (catalogue id), id (researcher), display_name_alternatives
    array<string>, affiliations array<struct<id, display_name>>.
    """
    names = authors.select("from", "id", F.explode("display_name_alternatives").alias("v"))
    places = authors.select("from", "id", F.explode("affiliations").alias("v"))
    return _pending_event(
        names, "author", "display_name_alternatives", F.col("v"), F.lit(None).cast("string")
    ).unionByName(
        _pending_event(places, "author", "affiliation", F.col("v.id"), F.col("v.display_name"))
    )


def work_events(works: DataFrame) -> DataFrame:
    """Works of a catalogue author to pending events.

    ``works``: from, id, work_id, reference, raw_author_name, author_name,
    affiliations array<struct<raw_affiliation_string, institutions
    array<struct<id, display_name>>>>.  Yields the printed name, each institution, each
    printed affiliation and the work itself.
    """
    lines = works.select("from", "id", F.explode("affiliations").alias("a"))
    institutions = lines.select("from", "id", F.explode("a.institutions").alias("i"))
    return (
        _pending_event(
            works,
            "author",
            "display_name_alternatives",
            F.col("raw_author_name"),
            F.col("author_name"),
        )
        .unionByName(
            _pending_event(
                institutions,
                "author",
                "affiliation",
                F.col("i.id"),
                F.coalesce("i.display_name", "i.id"),
            )
        )
        .unionByName(
            _pending_event(
                lines,
                "institution",
                "display_name_alternatives",
                F.col("a.raw_affiliation_string"),
                F.lit(None).cast("string"),
            )
        )
        .unionByName(_pending_event(works, "work", "id", F.col("work_id"), F.col("reference")))
    )


# ---- code and commits ----------------------------------------------------------------
def file_kind(path: Column) -> Column:
    """``source``, ``test`` or ``other`` by file name."""
    test = path.endswith(".test.ts") | path.endswith(".spec.ts")
    source = path.endswith(".ts") & ~test & ~path.endswith(".d.ts")
    return F.when(source, "source").when(test, "test").otherwise("other")


def code_counts(files: DataFrame) -> DataFrame:
    """(path, content) to the file kind and the counts of exports and test blocks."""
    kind = file_kind(F.col("path"))

    def counted(pattern: str, of: str) -> Column:
        return F.when(kind == of, F.regexp_count("content", F.lit(pattern))).otherwise(0)

    return files.select(
        "path",
        kind.alias("kind"),
        *[counted(p, "source").alias(name) for name, p in SOURCE_PATTERNS.items()],
        *[counted(p, "test").alias(name) for name, p in TEST_PATTERNS.items()],
    )


def parse_numstat(lines: DataFrame, column: str = "value") -> DataFrame:
    """``additions<TAB>deletions<TAB>path`` lines; ``-`` counts 0, malformed lines drop."""
    parts = F.split(column, "\t")

    def number(i: int) -> Column:
        return F.when(parts[i] == "-", F.lit(0)).otherwise(parts[i].try_cast("int"))

    counts = (
        lines.where(F.size(parts) == 3)
        .select(parts[2].alias("path"), number(0).alias("additions"), number(1).alias("deletions"))
        .where((F.col("path") != "") & F.col("additions").isNotNull() & F.col("deletions").isNotNull())
    )
    grows, shrinks = F.col("additions") > 0, F.col("deletions") > 0
    return counts.withColumn(
        "status",
        F.when(grows & ~shrinks, "added").when(shrinks & ~grows, "deleted").otherwise("modified"),
    )
