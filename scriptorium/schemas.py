"""Schemas of the domain tables; production reads never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_string = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LABELLED = _struct(id=_string, display_name=_string)
INSTITUTION = _struct(
    id=_string, ror=_string, display_name=_string, country_code=_string, type=_string
)
AUTHORSHIP = _struct(
    author=_struct(id=_string, display_name=_string, orcid=_string),
    author_position=_string,
    is_corresponding=T.BooleanType(),
    institutions=T.ArrayType(INSTITUTION),
)
TOPIC = _struct(
    id=_string,
    display_name=_string,
    score=T.DoubleType(),
    subfield=LABELLED,
    field=LABELLED,
    domain=LABELLED,
)
KEYWORD = _struct(id=_string, display_name=_string, score=T.DoubleType())

WORKS = _struct(
    work_id=_string,
    publication_year=T.IntegerType(),
    title=_string,
    type=_string,
    fwci=T.DoubleType(),
    cited_by_count=T.LongType(),
    updated_date=T.DateType(),
    authorships=T.ArrayType(AUTHORSHIP),
    topics=T.ArrayType(TOPIC),
    keywords=T.ArrayType(KEYWORD),
)

# ---- fixed values: field order of the native news layer ------------------------------
NEWS_COLUMNS = (
    "gkg_record_id",
    "v21_date",
    "v2_source_collection_identifier",
    "v2_source_common_name",
    "v2_document_identifier",
    "v1_counts",
    "v21_counts",
    "v1_themes",
    "v2_enhanced_themes",
    "v1_locations",
    "v2_enhanced_locations",
    "v1_persons",
    "v2_enhanced_persons",
    "v1_organizations",
    "v2_enhanced_organizations",
    "v15_tone",
    "v21_enhanced_dates",
    "v2_gcam",
    "v21_sharing_image",
    "v21_related_images",
    "v21_social_image_embeds",
    "v21_social_video_embeds",
    "v21_quotations",
    "v21_all_names",
    "v21_amounts",
    "v21_translation_info",
    "v2_extras_xml",
)
# -------------------------------------------------------------------------------------

NEWS_NATIVE = _struct(**{name: _string for name in NEWS_COLUMNS})

RAW_LOG = _struct(project_id=T.IntegerType(), timestamp=_string, username=_string, action=_string)

REVIEW_EVENT = _struct(
    **{"from": _string},
    id=_string,
    entity=_string,
    field=_string,
    value=_string,
    label=_string,
    status=_string,
    createdAt=_string,
    updatedAt=_string,
    hasBeenExtendedAt=_string,
    dataIntegrity=_string,
)

RESEARCHERS_REQUIRED = ("userid", "last_name", "middle_name", "first_name", "orcid")
RESEARCHERS_OPTIONAL = ("oa_imported_at", "oa_locked_at", "openalex_complete")

#: Landed registry dump: one object per organisation.
REGISTRY = _struct(
    id=_string,
    types=T.ArrayType(_string),
    names=T.ArrayType(_struct(value=_string, types=T.ArrayType(_string))),
    locations=T.ArrayType(_struct(geonames_details=_struct(country_code=_string))),
)
#: Landed catalogue page.
CATALOGUE_PAGE = _struct(
    results=T.ArrayType(
        _struct(
            id=_string,
            ror=_string,
            ids=_struct(ror=_string),
            country_code=_string,
            geo=_struct(country_code=_string),
            works_count=T.LongType(),
        )
    )
)
MONTHLY_VIEWS_PAGE = _struct(
    items=T.ArrayType(_struct(timestamp=_string, views=T.DoubleType()))
)
_BINDING_VALUE = _struct(value=_string)
BINDINGS_PAGE = _struct(
    results=_struct(
        bindings=T.ArrayType(
            _struct(
                ror=_BINDING_VALUE,
                item=_BINDING_VALUE,
                lang=_BINDING_VALUE,
                title=_BINDING_VALUE,
            )
        )
    )
)
REDIRECTS_PAGE = _struct(
    query=_struct(
        pages=T.MapType(
            _string, _struct(redirects=T.ArrayType(_struct(title=_string)))
        )
    )
)
OPPOSITION = T.ArrayType(_struct(author_id=_string, work_id=_string))
