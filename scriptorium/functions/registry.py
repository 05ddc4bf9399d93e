"""SQL names for the column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text, vectors
from scriptorium.functions.text import (
    SEGMENT_LONG_LINE,
    SEGMENT_MIN_CHARS,
    SEGMENT_STEP,
    SEGMENT_WINDOW,
)


@F.pandas_udf(T.StringType())
def fold_accents_nfd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Full canonical decomposition, for scripts the letter table leaves alone."""
    for batch in batches:
        decomposed = batch.str.normalize("NFD")
        yield decomposed.map(
            lambda s: None
            if s is None
            else "".join(c for c in s if not unicodedata.category(c).startswith("M"))
        )


@F.udtf(returnType="position: int, segment: string")
class SegmentsUDTF:
    """``SELECT * FROM segments(text)``: the candidate reference lines of one text."""

    def eval(self, content: str):
        if content is None:
            return
        lines = (line.strip(" ") for line in content.replace("\r\n", "\n").split("\n"))
        position = 0
        for line in lines:
            if len(line) <= SEGMENT_MIN_CHARS:
                continue
            starts = [0]
            width = len(line)
            if width > SEGMENT_LONG_LINE:
                width = SEGMENT_WINDOW
                room = len(line) - width
                starts = [*range(0, room, SEGMENT_STEP), room]
            for start in starts:
                yield position, line[start : start + width]
                position += 1


def _quoted(pattern: str) -> str:
    """A raw SQL string literal."""
    return "r\"" + pattern + "\"" if "'" in pattern else f"r'{pattern}'"


def _function_bodies() -> dict[str, tuple[str, str, str]]:
    """SQL name -> (arguments, return type, body); the twins of ``functions.text``."""
    accented, plain = text.accent_table()
    fold = f"regexp_replace(translate(txt, '{accented}', '{plain}'), r'\\p{{Mn}}+', '')"
    classes = " ".join(
        f"WHEN folded_text(action) RLIKE {_quoted(p)} THEN '{label}'"
        for label, p in text.ACTION_PATTERNS
    )
    respondents = ", ".join(
        f"nullif(regexp_extract(folded_text(action), {_quoted(p)}, 1), '')"
        for p in text.RESPONDENT_PATTERNS
    )
    anonymous = ", ".join(f"'{name}'" for name in text.ANONYMOUS_USERS)
    gram = (
        "CASE WHEN length(txt) >= n THEN array_distinct(transform(sequence(1, length(txt) - n + 1),"
        " i -> lower(substr(txt, i, n)))) ELSE CAST(array() AS array<string>) END"
    )
    return {
        "fold_accents": ("txt string", "string", fold),
        "folded_text": ("txt string", "string", "fold_accents(lower(txt))"),
        "match_key": (
            "name string",
            "string",
            "trim(regexp_replace(lower(fold_accents(name)), '[^a-z0-9]+', ' '))",
        ),
        "normalize_string": (
            "txt string",
            "string",
            r"lower(trim(regexp_replace(regexp_replace(fold_accents(txt),"
            r" r'(?U)[^\p{L}\p{N}\s_-]', ''), r'(?U)\s+', ' ')))",
        ),
        "edit_similarity": (
            "a string, b string",
            "double",
            "CASE WHEN a = b THEN 1D"
            " ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END",
        ),
        "char_ngrams": ("txt string, n int", "array<string>", gram),
        "jaccard_index": (
            "a array<string>, b array<string>",
            "double",
            "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 1D)",
        ),
        "ngram_similarity": (
            "a string, b string",
            "double",
            "CASE WHEN a = b THEN 1D ELSE"
            " (jaccard_index(char_ngrams(a, 2), char_ngrams(b, 2))"
            " + jaccard_index(char_ngrams(a, 3), char_ngrams(b, 3))) / 2 END",
        ),
        "split_orgs": (
            "field string",
            "array<string>",
            "array_distinct(filter(transform(split(field, ';'),"
            r" e -> trim(regexp_replace(trim(e), r',\d+$', ''))), e -> e <> ''))",
        ),
        "looks_university": (
            "name string",
            "boolean",
            f"name RLIKE {_quoted(text.UNIVERSITY_REGEX)}",
        ),
        "user_type": (
            "username string",
            "string",
            f"CASE WHEN lower(username) IN ({anonymous})"
            f" OR username RLIKE {_quoted(text.HEX32_REGEX)}"
            f" THEN '{text.RESPONDENT}' ELSE '{text.LOGGED}' END",
        ),
        "action_category": (
            "action string",
            "string",
            f"CASE {classes} ELSE '{text.ACTION_OTHER}' END",
        ),
        "respondent_id": (
            "action string, username string",
            "string",
            f"coalesce({respondents}, concat('user:', username))",
        ),
        "cosine_similarity": (
            "a array<double>, b array<double>",
            "double",
            f"CASE WHEN {size('a')} * {size('b')} = 0 THEN 0.0D ELSE {inner('a', 'b')} / ({size('a')} * {size('b')}) END",
        ),
        "complementarity": (
            ", ".join(f"{level} double" for level in vectors.COMPLEMENTARITY_WEIGHTS) + ", topic double",
            "double",
            "("
            + " + ".join(f"{level} * {weight}D" for level, weight in vectors.COMPLEMENTARITY_WEIGHTS.items())
            + ") * (1 - topic)",
        ),
        "ensemble": (
            "tfidf double, embedding double",
            "double",
            " + ".join(f"{name} * {weight}D" for name, weight in vectors.ENSEMBLE_WEIGHTS.items()),
        ),
        "extract_dois": (
            "txt string",
            "array<string>",
            f"array_distinct(transform(regexp_extract_all(txt, {_quoted_doi()}, 0),"
            r" d -> regexp_replace(lower(d), r'[.)]+$', '')))",
        ),
    }


def inner(a: str, b: str) -> str:
    """SQL of the inner product of two arrays, summed in index order."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0.0D, (total, x) -> total + x)"


def size(a: str) -> str:
    """SQL of the length of a vector."""
    return f"sqrt({inner(a, a)})"


def _quoted_doi() -> str:
    return "'" + text.DOI_REGEX.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> list[str]:
    """Make the column functions callable from SQL and return their names.

    They are SQL functions, which Catalyst inlines: no Python worker takes part.  Only
    the full decomposition (an Arrow function) and the ``segments`` table function run
    in Python.
    """
    bodies = _function_bodies()
    for name, (arguments, returns, body) in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}"
        )
    spark.udf.register("fold_accents_nfd", fold_accents_nfd)
    spark.udtf.register("segments", SegmentsUDTF)
    return [*bodies, "fold_accents_nfd", "segments"]
