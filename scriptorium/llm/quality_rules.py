"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are runs without ASCII white space.  Everything is an expression over one row: the
repeated three-word windows of a text are found by sorting their hashes together with their
places (one array of longs), and only windows whose hash recurs are compared as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Common words of the languages the rules know.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this not or from at an",
    "fr": "le la les de des et un une en que qui est pour dans par sur pas au avec du ne se",
    "de": "der die das und in von den ist im mit zu auf für nicht ein eine sich auch als dem es",
    "es": "el la los las de que y en un una por con para se del al no es su lo como",
}

#: measure, least and most value allowed (None: no limit), least number of words for the rule.
RULES: list[tuple[str, float | None, float | None, int]] = [
    ("n_words", 50, None, 0),
    ("repeat_word_ratio", None, 0.5, 0),
    ("mean_word_length", 2.0, 14.0, 50),
    ("symbol_ratio", None, 0.25, 50),
    ("stop_word_ratio", 0.04, None, 50),
    ("duplicate_line_ratio", None, 0.5, 50),
    ("upper_ratio", None, 0.7, 50),
    ("letter_ratio", 0.6, None, 50),
]
#: The first rules; failing one of these is ``base_failed``.
BASE = 2

_PLACE = 31  # bits of a window's place in the long that carries its hash


def words_of(text: Column) -> Column:
    """The words of a text."""
    return F.array_remove(F.split(text, BLANK), "")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measures of every whole text; a null text has no word.

    The projections follow each other because arrays that several measures read are computed
    once each; there is no shuffle.
    """
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    words = rows.withColumn("w", words_of(F.col("text")))
    # One long per three-word window: the upper bits of its hash, the place in the lower ones.
    windows = words.withColumn(
        "packed",
        F.when(
            F.size("w") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(1), F.size("w") - 2),
                    lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1))
                    .bitwiseAND(-(1 << _PLACE))
                    .bitwiseOR(i.cast("long")),
                )
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    head = lambda x: F.shiftright(x, _PLACE)
    alike = windows.withColumn(
        "alike",
        F.filter(
            "packed",
            lambda x, i: (head(x) == head(F.get("packed", i - 1))) | (head(x) == head(F.get("packed", i + 1))),
        ),
    )
    # Hashes are candidates; the windows themselves decide.
    exact = alike.withColumn(
        "sorted",
        F.array_sort(
            F.transform(
                "alike",
                lambda x: F.struct(
                    F.array_join(F.slice("w", x.bitwiseAND((1 << _PLACE) - 1).cast("int"), 3), " ").alias("s"),
                    x.bitwiseAND((1 << _PLACE) - 1).cast("int").alias("at"),
                ),
            )
        ),
    )
    places = exact.withColumn(
        "at",
        F.array_sort(
            F.transform(
                F.filter(
                    "sorted",
                    lambda x, i: (x["s"] == F.get("sorted", i - 1)["s"]) | (x["s"] == F.get("sorted", i + 1)["s"]),
                ),
                lambda x: x["at"],
            )
        ),
    )
    # Words covered by repeated windows: three each, less what the next window covers as well.
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = [w for words in STOP_WORDS.values() for w in words.split()]
    stops = sorted({*stops, *(w.capitalize() for w in stops)})
    counted = places.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: x.isin(stops))).alias("stops"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("n_repeat_words") / n).alias("repeat_word_ratio"),
        (F.col("word_chars") / n).alias("mean_word_length"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("stops") / n).alias("stop_word_ratio"),
        ((F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1))).alias("duplicate_line_ratio"),
        (F.col("upper") / F.greatest(F.col("letters"), F.lit(1))).alias("upper_ratio"),
        (F.col("letters") / F.greatest(F.col("word_chars"), F.lit(1))).alias("letter_ratio"),
    )


def compiled(rules: list[tuple[str, float | None, float | None, int]]) -> list[Column]:
    """One condition per rule of the table: does a text fail it?  Measures that share words with
    the counts are compared in whole numbers where the limits are."""
    out = []
    for measure, least, most, words in rules:
        value = F.col(measure)
        parts = [value < F.lit(least)] if least is not None else []
        parts += [value > F.lit(most)] if most is not None else []
        failed = parts[0] if len(parts) == 1 else parts[0] | parts[1]
        out.append(failed & (F.col("n_words") >= words))
    return out


def judge(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None, base: int = BASE
) -> DataFrame:
    """``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept`` and ``failed`` (the measures whose rules fail), one row a row.

    Null, empty and blank texts have no word and fail the word count; null ids are kept.
    """
    rules = RULES if rules is None else rules
    found = measured(df, id_col, text_col)
    fails = compiled(rules)
    names = [F.when(f, F.lit(r[0])) for r, f in zip(rules, fails, strict=True)]
    first = fails[0]
    for f in fails[1:base]:
        first = first | f
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        first.alias("base_failed"),
        F.array_compact(F.array(*names)).alias("failed"),
    ).select("*", (F.size("failed") == 0).alias("kept"))
