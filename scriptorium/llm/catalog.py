"""Registered queries of the training-data operators, and SQL where it states their rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from scriptorium.llm import (
    common,
    fill_middle,
    html_text,
    language,
    line_dedup,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sentencepiece_bpe,
    syncmers,
    token_planes,
    whitening,
)
from scriptorium.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where given, the SQL of its rows."""

    def put(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return put


@query("op1_sentencepiece")
def op1(spark, sf):
    return sentencepiece_bpe.digest_documents(
        common.documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model")
    )


@query("op4_token_planes")
def op4(spark, sf):
    path = scratch_path(spark, "token_planes")
    token_planes.write_token_files(
        common.documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    return token_planes.read_token_digests(spark, path)


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "sequence_length",
    )


@query("op9_packing")
def op9(spark, sf):
    return packed_digest(
        packing.pack_documents(
            common.documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), end_id=2
        )
    )


@query("op5_syncmers")
def op5(spark, sf):
    return syncmers.edited_documents(common.documents(spark, sf))


def held_out(doc_id):
    """The fold that language models never learn from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from all documents outside the held-out fold."""
    return language.train(docs.where(~held_out(F.col("doc_id"))))


@query("op6_language")
def op6(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text", "lang")
    return language.identify(docs, language_dictionaries(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query("op2_secrets")
def op2(spark, sf):
    return secrets.scan_documents(common.documents(spark, sf))


@query("op10_ngram_join")
def op10(spark, sf):
    return ngram_join.jaccard_components(common.documents(spark, sf))


@query("op7_line_dedup")
def op7(spark, sf):
    return line_dedup.line_report(common.documents(spark, sf))


@query("op3_quality_rules")
def op3(spark, sf):
    return quality_rules.judge(common.documents(spark, sf)).drop("failed")


@query("op8_quality_classifier")
def op8(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return quality_classifier.classify(common.documents(spark, sf), labels)


@query(
    "op11_fill_middle",
    r"""
    WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), numbered AS (
        SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
            CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
        FROM hashed
    ), cut AS (
        SELECT doc_id, text, units, len(units) AS n,
            least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
            greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM numbered
    ), parts AS (
        SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p,
            coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
            coalesce(array_to_string(units[b + 1:n], ''), '') AS s
        FROM cut
    )
    SELECT doc_id, n, form,
        CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars,
        CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts
    """,
)
def op11(spark, sf):
    return fill_middle.digests(fill_middle.transform(common.documents(spark, sf)))


@query("op12_html_text")
def op12(spark, sf):
    return html_text.extract(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op13_whitening")
def op13(spark, sf):
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))
