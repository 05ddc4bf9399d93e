"""Language identification by compression.

One zstandard raw-content dictionary per language is made of excerpts of labelled documents.
Letters alone count, in lower case.  A text is cut into blocks, each block is compressed
with every dictionary, and the language with the smallest total wins; short texts count
once from each of their words on, because one size in bytes hardly tells them apart; its margin over the second is the score.  A narrow margin of a
text that is not short is a rejection: another language compresses it about as well.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import blocks, end_caches, over_batches

UNKNOWN = "und"
#: The sample a dictionary is fitted on: at most this many excerpts of a language, of this length.
EXCERPTS, EXCERPT_CHARS = 256, 400
#: Bytes compressed at once: a dictionary helps little in a block much longer than itself.
BLOCK_BYTES = 4096
#: Level, and the shortest match: shorter than the library takes at this level, for word endings.
LEVEL, MIN_MATCH = 5, 4
#: Below so many bytes a text counts from each of its words on.
SHORT_BYTES = 300
#: Margin below which a prediction is rejected.
MIN_MARGIN = 0.01


_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters; all else between them is one space."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    excerpts: int = EXCERPTS,
    excerpt_chars: int = EXCERPT_CHARS,
) -> dict[str, bytes]:
    """Language to dictionary content, from a bounded sample of the labelled rows.

    Rows without text, letters or label teach nothing.  Rows are drawn by a hash of their id,
    at a rate that gives about twice ``excerpts`` per language, and the least hashes stay; an
    excerpt begins at a place drawn by the hash.  The driver gets ``excerpts`` excerpts a
    language.
    """
    rows = labelled.select(
        labelled[lang_col].cast("string").alias("lang"),
        labelled[text_col].cast("string").alias("text"),
        F.xxhash64(labelled[id_col], F.lit(7)).alias("draw"),
    ).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(2.0 * excerpts) / F.col("n")
    drawn = rows.join(F.broadcast(counts), "lang").where(  # one row a language
        (F.col("draw").cast("double") / 2.0**64 + 0.5 < share) & F.col("text").rlike(r"\p{L}")
    )
    begin = F.pmod(F.col("draw"), F.greatest(F.lit(1), F.length("text") - excerpt_chars + 1)) + 1
    piece = F.substring(F.col("text"), begin.cast("int"), F.lit(excerpt_chars))
    found = (
        drawn.groupBy("lang")
        .agg(F.array_sort(F.collect_set(F.struct("draw", piece.alias("piece")))).alias("all"))
        .select("lang", F.slice(F.transform("all", lambda x: x["piece"]), 1, excerpts).alias("pieces"))
    )
    return {
        r["lang"]: b"\n".join(dict.fromkeys(map(letters, r["pieces"])))
        for r in found.orderBy("lang").collect()
    }


def identify(
    df: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """``keep`` (default: the id) with ``lang_pred``, ``score`` and ``rejected`` for every whole text.

    ``score`` is 1 - smallest / second smallest size (1 with one language).  A text that is
    null, empty or without a letter, and any text when nothing was learned, is ``und`` with
    score 0 and rejected.  Equal sizes go to the dictionary that has the text's words more
    often (then to the first by name) with score 0.  A margin under ``min_margin`` rejects a
    text of ``SHORT_BYTES`` or more; a shorter one has too little to tell a mixture from a
    small sample, and stays.
    """
    kept = [id_col] if keep is None else keep
    fields = {f"k{i}": df.schema[c] for i, c in enumerate(kept)}
    columns = {k: df[f.name] for k, f in fields.items()}
    # A kept text goes to Python once.
    text = f"k{kept.index(text_col)}" if text_col in kept and df.schema[text_col].dataType.typeName() == "string" else "text"
    columns.setdefault(text, df[text_col].cast("string"))
    rows = df.select(*[c.alias(k) for k, c in columns.items()])
    names = sorted(dictionaries)

    def begin():
        import zstandard

        end_caches()
        packers = []
        for name in names:
            content = zstandard.ZstdCompressionDict(
                dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL,
                source_size=BLOCK_BYTES,
                dict_size=len(dictionaries[name]),
                min_match=MIN_MATCH,
                write_content_size=False,
                write_checksum=False,
            )
            content.precompute_compress(compression_params=how)
            packers.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content).compress)

        def judged(content: str | None) -> tuple[str, float, bool]:
            data = letters(content) if packers and content else b""
            if not data or not any(map(str.isalpha, content)):
                return UNKNOWN, 0.0, True
            if len(data) < SHORT_BYTES:
                cut = [data, *(data[m.end() :] for m in re.finditer(b" ", data))]
            else:
                cut = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
            sizes = [sum(len(pack(c)) for c in cut) for pack in packers]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            tied = [i for i, size in enumerate(sizes) if size == sizes[best]]
            if len(tied) > 1:
                words = set(data.split())
                best = max(tied, key=lambda i: sum(dictionaries[names[i]].count(b" %b " % w) for w in words))
            if len(sizes) == 1:
                return names[best], 1.0, False
            second = min(s for i, s in enumerate(sizes) if i != best)
            score = 1.0 - sizes[best] / second
            return names[best], score, score < min_margin and len(data) >= SHORT_BYTES

        def each(batch):
            for block in blocks(batch, text):
                found = [judged(t) for t in block.column(text).to_pylist()]
                yield {k: block.column(k) for k in fields} | {
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "rejected": [lang == UNKNOWN or narrow for lang, _, narrow in found],
                }

        return each

    schema = ", ".join([*(f"{k} {f.dataType.simpleString()}" for k, f in fields.items()),
                        "lang_pred string, score double, rejected boolean"])
    out = over_batches(rows, begin, schema)
    return out.select(
        *[F.col(k).alias(f.name) for k, f in fields.items()], "lang_pred", "score", "rejected"
    )


def keep_identified(
    df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """The rows of ``df`` whose language :func:`identify` does not reject, with all their columns."""
    short = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text = f"c{df.columns.index(text_col)}"
    found = identify(short, dictionaries, text_col=text, keep=short.columns, min_margin=min_margin)
    return found.where("not rejected").select(short.columns).toDF(*df.columns)
