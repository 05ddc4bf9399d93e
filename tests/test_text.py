"""Column functions, their SQL twins, news parsing and activity classes."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import register_functions, text, vectors
from scriptorium.operators import dedup, reshape
from scriptorium.sources import scans


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_match_key(spark):
    assert one(spark, text.match_key(F.lit("Université de Forêt,  Ñandú-X"))) == "universite de foret nandu x"


def test_fold_keeps_letters_without_decomposition(spark):
    assert one(spark, text.fold_accents(F.lit("ßœæøł éàü é"))) == "ßœæøł eau e"


def test_similarities(spark):
    assert one(spark, text.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.edit_similarity(F.lit("abcd"), F.lit("abce"))) == 0.75
    assert one(spark, text.jaccard(text.ngrams(F.lit("a"), 2), text.ngrams(F.lit("b"), 2))) == 1.0


@pytest.mark.parametrize(
    ("action", "category"),
    [
        ("Déconnexion", "Authentification"),
        ("API Export", "API"),
        ("Rôle modifié", "Utilisateurs"),
        ("Paramètres", "Projet"),
        ("Enquête envoyée", "Questionnaires"),
        ("File repository", "Fichiers"),
        ("Mise à jour", "Enregistrements"),
        ("Page", "Autre"),
    ],
)
def test_action_category(spark, action, category):
    assert one(spark, text.action_category(F.lit(action))) == category


def test_user_type(spark):
    values = {"survey": True, "[survey respondent]": True, "": True, "A" * 32: True, "jane": False}
    for name, respondent in values.items():
        assert (one(spark, text.user_type(F.lit(name))) == text.RESPONDENT) is respondent


def test_respondent_priority(spark):
    both = "Enregistrement 5 Réponse créée R-9"
    assert one(spark, text.respondent_id(F.lit(both), F.lit("u"))) == "r-9"
    assert one(spark, text.respondent_id(F.lit("Vue"), F.lit("u"))) == "user:u"


def test_dois(spark):
    found = one(spark, text.extract_dois(F.lit("x 10.1234/AbC). y 10.1234/abc, 10.12/no")))
    assert found == ["10.1234/abc"]


def test_sql_functions_equal_columns(spark):
    register_functions(spark)
    samples = spark.createDataFrame(
        [("Université X,12;A, b,3;Université X,9", "Réponse créée R-1", "jane"), ("", "Login", "survey")],
        "s string, a string, u string",
    )
    samples.createOrReplaceTempView("samples")
    by_sql = spark.sql(
        "SELECT match_key(s) k, fold_accents(s) f, normalize_string(s) n, split_orgs(s) o, looks_university(s) l,"
        " action_category(a) c, respondent_id(a, u) r, user_type(u) t, edit_similarity(s, a) e, ngram_similarity(s, a) g FROM samples"
    ).collect()
    s, a, u = F.col("s"), F.col("a"), F.col("u")
    by_column = samples.select(
        text.match_key(s), text.fold_accents(s), text.normalize_string(s), text.split_orgs(s), text.looks_university(s),
        text.action_category(a), text.respondent_id(a, u), text.user_type(u), text.edit_similarity(s, a), text.ngram_similarity(s, a),
    ).collect()
    assert [tuple(r) for r in by_sql] == [tuple(r) for r in by_column]


def test_sql_vector_functions_equal_columns(spark):
    register_functions(spark)
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows.createOrReplaceTempView("vectors_in")
    by_sql = spark.sql(
        "SELECT cosine_similarity(a, b) c, complementarity(a[0], a[1], b[0], b[1]) m, ensemble(a[0], b[0]) e FROM vectors_in"
    ).collect()
    a, b = F.col("a"), F.col("b")
    levels = {"domain": a[0], "field": a[1], "subfield": b[0], "topic": b[1]}
    by_column = rows.select(vectors.cosine(a, b), vectors.complementarity(levels), vectors.ensemble(a[0], b[0])).collect()
    for one_row, other in zip(by_sql, by_column, strict=True):
        assert all(abs(x - y) < 1e-12 for x, y in zip(one_row, other, strict=True))


def test_event_id_keeps_missing_fields(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    events = spark.createDataFrame([("e", "f", "a", "i", None)], "entity string, field string, from string, id string, value string")
    text_ = '{"entity":"e","field":"f","from":"a","id":"i","value":null}'
    assert events.select(dedup.event_id(space)).first()[0] == str(uuid.uuid5(uuid.UUID(space), text_))


def test_segments_table_function(spark):
    register_functions(spark)
    content = "abcdefghi " * 60 + "\nshort\n a line of more than twenty characters "
    expected = one(spark, text.segments(F.lit(content)))
    found = [r.segment for r in spark.sql(f"SELECT * FROM segments('{content}') ORDER BY position").collect()]
    assert found == expected and len(found) == 7 and max(map(len, found)) == 200


def news_line(record, orgs, info=""):
    fields = [""] * 27
    fields[0], fields[1], fields[3], fields[4] = record, "20260101120000", "example.com", f"http://example.com/{record}"
    fields[14], fields[25] = orgs, info
    return "\t".join(fields)


def test_news_mentions(spark):
    lines = [
        news_line("1", "Harvard University,120;Acme Corporation,300;Harvard University,540"),
        news_line("2", "Universite de Lyon,80", "srclc:fra;eng:Moses"),
        news_line("3", "University of California, Berkeley,42") + "\textra",
        news_line("4", ""),
        "too\tshort",
        "   ",
    ]
    native = scans.parse_native_news(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert native.count() == 4 and len(native.columns) == 27
    found = {(r.record_id, r.organization, r.translated) for r in reshape.mentions(native).collect()}
    assert found == {
        ("1", "Harvard University", False),
        ("1", "Acme Corporation", False),
        ("2", "Universite de Lyon", True),
        ("3", "University of California, Berkeley", False),
    }


def test_quotes_stay_literal(spark):
    native = scans.parse_native_news(spark.createDataFrame([(news_line('"1', 'Say "U"', ""),)], "value string"))
    assert native.first().gkg_record_id == '"1'
