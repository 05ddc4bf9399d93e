"""A training-data pipeline over ``documents``: stages that each call one operator.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame;
all but the last return the columns of ``documents``, with ``n_chars`` the characters of the
text as it is then.  ``run`` writes every stage's rows as Parquet below ``spark.checkpoint.dir``
and the next stage reads them.

Nulls: a null text is in no language and goes in the first stage; a null ``doc_id`` takes part
in no duplicate search and stays.  Rows with equal ids count as one document.  An empty table
passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import catalog, common, language, line_dedup, ngram_join, packing, secrets

#: Shingle size and similarity of near-duplicate documents.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression identifies; the dictionaries are made from the
    labelled documents of the table outside the held-out fold."""
    return language.keep_identified(docs, catalog.language_dictionaries(docs.select("doc_id", "text", "lang")))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of every component of near-duplicate lines; those left without a
    line go."""
    return _measured(line_dedup.drop_duplicate_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every component of near-duplicate documents."""
    found = ngram_join.jaccard_components(docs, words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced."""
    return _measured(secrets.redact_documents(docs))


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences for training."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return catalog.packed_digest(packing.pack_documents(docs, path, end_id=2))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", fuzzy_lines),
    ("ngram_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", lexical_packing),
]

#: The stages' rows are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read by the next."""
    docs = common.documents(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        common.drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
