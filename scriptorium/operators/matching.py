"""Researcher matching, text and vector search, string grouping, reference matching."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from scriptorium.functions import text, vectors
from scriptorium.operators import aggregates, neighbours, reshape, windows
from scriptorium.operators.grouping import group_by_leader, group_ngram, group_scores, group_similar
from scriptorium.operators.matches import MATCH_SCORES, SEARCH_LIMIT, best_matches, top_overall
from scriptorium.session import materialize

# ---- fixed values --------------------------------------------------------------------
REFERENCE_THRESHOLD = 0.2
REFERENCE_MIN_CHARS = 10
REFERENCE_GRAM = 3
# -------------------------------------------------------------------------------------

#: Segments of an owner that are looked through at once, and how many such parts there are at most:
#: beyond that the parts grow.
HOT_POSTINGS, HOT_LISTS = 50_000, 10_000
#: Titles that look through a part at once.
TITLE_BLOCK = 20_000
#: Dimension of the default hashing embedder.
HASHING_DIM = 64


# ---- researcher profiles -------------------------------------------------------------
def tfidf_profiles(dims: DataFrame, key: str = "researcher_id") -> DataFrame:
    """Unit TF-IDF profile of each researcher over prefixed dimensions, as long rows."""
    return aggregates.l2_normalize(aggregates.tfidf(dims, key), key)


#: Explanation column -> (level, whose weights rank it, which labels qualify).
_EXPLANATIONS = {
    "shared_domains": ("domain", "b", "shared"),
    "shared_fields": ("field", "b", "shared"),
    "shared_subfields": ("subfield", "b", "shared"),
    "shared_keywords": ("keyword", "b", "shared"),
    "distinct_topics_a": ("topic", "a", "own"),
    "distinct_topics_b": ("topic", "b", "own"),
}


def explain(
    matches: DataFrame, profiles: DataFrame, n: int = windows.TOP_LABELS, key: str = "researcher_id"
) -> DataFrame:
    """Top labels two matched researchers share, and the topics only one of them has.

    Meant for the matches a report keeps.  Shared labels are ranked by the second
    researcher's weight.
    """
    pairs = matches.select("researcher_a", "researcher_b")

    def side(name: str) -> DataFrame:
        return pairs.join(
            profiles.select(F.col(key).alias(f"researcher_{name}"), "dim", "label", "weight"),
            f"researcher_{name}",
        ).select(
            "researcher_a",
            "researcher_b",
            "dim",
            F.struct(F.lit(name).alias("side"), "label", "weight").alias("e"),
        )

    grain = ["researcher_a", "researcher_b", "dim"]
    merged = side("a").unionAll(side("b")).groupBy(*grain).agg(
        F.max(F.when(F.col("e.side") == "a", F.col("e.weight"))).alias("wa"),
        F.max(F.when(F.col("e.side") == "b", F.col("e.weight"))).alias("wb"),
        F.max("e.label").alias("label"),
    )
    choices = []
    for name, (level, ranker, kind) in _EXPLANATIONS.items():
        other = "wa" if ranker == "b" else "wb"
        qualifies = (
            F.col("dim").startswith(f"{level}::")
            & F.col(f"w{ranker}").isNotNull()
            & (F.col(other).isNotNull() if kind == "shared" else F.col(other).isNull())
        )
        choices.append(
            F.when(
                qualifies, F.struct(F.lit(name).alias("what"), F.col(f"w{ranker}").alias("weight"))
            )
        )
    ranked = windows.top_per_group(
        merged.select(
            "researcher_a",
            "researcher_b",
            "dim",
            "label",
            F.explode(F.array_compact(F.array(*choices))).alias("c"),
        ).select("researcher_a", "researcher_b", "dim", "label", "c.what", "c.weight"),
        ["researcher_a", "researcher_b", "what"],
        [F.desc("weight"), F.asc("dim")],
        n,
    )
    ordered = ranked.groupBy("researcher_a", "researcher_b").agg(
        *[
            F.transform(
                F.sort_array(
                    F.collect_list(F.when(F.col("what") == name, F.struct("rank", "label")))
                ),
                lambda e: e["label"],
            ).alias(name)
            for name in _EXPLANATIONS
        ]
    )
    return matches.join(ordered, ["researcher_a", "researcher_b"], "left")


# ---- embeddings ----------------------------------------------------------------------
def hashing_embed(texts: Iterable[str], dim: int = HASHING_DIM) -> np.ndarray:
    """Deterministic stand-in for a neural encoder: signed hashed word counts."""
    import hashlib
    import re

    rows = []
    for content in texts:
        row = np.zeros(dim)
        for word in re.findall(r"\w+", (content or "").lower()):
            digest = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            row[digest % dim] += 1.0 if (digest >> 32) & 1 else -1.0
        rows.append(row)
    return np.array(rows).reshape(len(rows), dim)


def embed_texts(
    texts: DataFrame,
    embed: Callable[[Iterable[str]], np.ndarray] = hashing_embed,
    key: str = "work_id",
    column: str = "text",
) -> DataFrame:
    """(key, vector) of each text; Arrow batches stream through the injected encoder.

    An empty text embeds to whatever the encoder makes of it, zeros by default.
    """
    schema = T.StructType(
        [texts.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {key: batch[key], "vector": list(np.asarray(embed(batch[column]), dtype=float))}
            )

    return texts.select(key, column).mapInPandas(run, schema)


def researcher_vectors(
    texts: DataFrame,
    authorships: DataFrame,
    embed: Callable[[Iterable[str]], np.ndarray] = hashing_embed,
    opposed: DataFrame | str | None = None,
) -> DataFrame:
    """Unit mean of the work vectors of each author.

    Works are embedded once each, then joined to their authors; opposed pairs are
    removed before averaging.
    """
    links = authorships.select("author_id", "work_id").distinct()
    if opposed is not None:
        links = reshape.purge(links, opposed)
    return aggregates.mean_pool(links.join(embed_texts(texts, embed), "work_id"), "author_id")


# ---- search --------------------------------------------------------------------------
def text_index(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Inverted index (term, key, tf, n_words): whole texts, one row per word and document.

    :func:`add_to_index` stores it, so that searches read neither texts nor other terms.
    """
    tokens = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return (
        documents.select(key, tokens.alias("w"))
        .select(key, F.size("w").alias("n_words"), F.explode("w").alias("term"))
        .groupBy("term", key, "n_words")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


#: Rows of a row group of a stored index, about: what a search for a rare term reads of a run.
INDEX_ROWS = 100_000


def add_to_index(index: DataFrame, path: str, run: str, key: str) -> None:
    """Store the index rows of new documents as a run of the index at ``path``.

    Each file has its rows in order of term, and key within a term, in small row groups whose
    statistics let a search skip all others: it reads a group or so of a file for a rare term.  The
    files are those that counting the words made, so a term in every document is in all of them and
    the index is shuffled once.  A run written again replaces itself; other runs stay as they are.
    """
    (
        index.sortWithinPartitions("term", key)
        .withColumn("run", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.row.count.limit", str(INDEX_ROWS))
        .partitionBy("run")
        .parquet(path)
    )


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all runs; the terms of a search are looked up in the files' statistics."""
    return spark.read.parquet(path).drop("run")


def search_index(
    index: DataFrame,
    key: str,
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    n: int = SEARCH_LIMIT,
) -> DataFrame:
    """Best documents holding all, any and none of the given terms.

    Rank is the sum over matched terms of ``1 + ln(tf)``, divided by ``1 + ln(words)``.
    Only the rows of the query's terms leave the scan.
    """
    wanted = [w.lower() for w in (*all_of, *any_of)]
    if not wanted:
        raise ValueError("a search needs at least one term to find")
    banned = [w.lower() for w in none_of]

    def has(word: str) -> Column:
        return F.bool_or(F.col("term") == word)

    hits = index.where(F.col("term").isin(*wanted, *banned)).groupBy(key).agg(
        F.sum(F.when(F.col("term").isin(*wanted), 1 + F.log("tf"))).alias("_score"),
        F.max("n_words").alias("_words"),
        *[has(w).alias(f"_all{i}") for i, w in enumerate(w.lower() for w in all_of)],
        (
            F.bool_or(F.col("term").isin(*[w.lower() for w in any_of]))
            if any_of
            else F.lit(True)
        ).alias("_any"),
        (F.bool_or(F.col("term").isin(*banned)) if banned else F.lit(False)).alias("_none"),
    )
    kept = hits.where("_any AND NOT _none")
    for i in range(len(all_of)):
        kept = kept.where(F.col(f"_all{i}"))
    return windows.top_matches(
        kept.select(key, (F.col("_score") / (1 + F.log("_words"))).alias("rank")), "rank", n, [key]
    )


def search_knn(
    df: DataFrame, key: str, vector: str, query: Sequence[float], n: int = SEARCH_LIMIT
) -> DataFrame:
    """Nearest vectors to a query by cosine distance; a wrong dimension is an error.

    The query travels as a literal; each task keeps n rows.
    """
    size = F.size(vector)
    checked = F.when(size == len(query), F.col(vector)).otherwise(
        F.raise_error(
            F.concat(F.lit(f"expected dimension {len(query)}, found "), size.cast("string"))
        )
    )
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = df.where(F.col(vector).isNotNull()).select(
        key, (1 - vectors.cosine(checked, literal)).alias("distance")
    )
    return scored.orderBy("distance", key).limit(n)


# ---- reference matching --------------------------------------------------------------
def match_references(
    works: DataFrame,
    segments: DataFrame,
    limit: float = REFERENCE_THRESHOLD,
    owner: Sequence[str] = (),
) -> DataFrame:
    """Best text segment of each title: (owner, work_id, segment_id, score), in score order.

    ``works``: owner, work_id, title.  ``segments``: owner, segment_id, segment; ids are in text
    order, so of equally good segments the first counts.  The score is the share of the title's
    distinct character trigrams, of its matching key, absent from the segment; 0 means all present.
    Titles shorter than 10 characters match nothing.

    Segments are dealt into parts and titles into blocks; a task holds the trigrams of one part and
    looks for one block of titles, so hits are counted where the segment is and no row per trigram or
    per title and segment leaves it.  Exact filter: a title of n trigrams within the limit misses at
    most ``m = floor(limit * n)`` of them, so of any ``m + c`` trigrams at least c are in the segment.
    Those rarest in the part are counted first, with c a quarter of n, and only segments they hit c
    times are counted whole.
    """
    owner = list(owner)

    def of_owner(df: DataFrame) -> DataFrame:
        return df.dropna(subset=owner) if owner else df

    def dealt(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    titles = (
        of_owner(works)
        .select(*owner, "work_id", text.match_key(F.col("title")).alias("_title"))
        .where(F.length("_title") >= REFERENCE_MIN_CHARS)
    )
    blocks = max(1, -(-titles.count() // TITLE_BLOCK))
    lines = of_owner(segments)
    n = lines.count()
    parts = max(1, -(-n // max(HOT_POSTINGS, n // HOT_LISTS)))
    left = titles.withColumn("_block", dealt("work_id", blocks)).withColumn("_part", every(parts))
    right = (
        lines.select(*owner, "segment_id", text.match_key(F.col("segment")).alias("_key"))
        .withColumn("_part", dealt("segment_id", parts))
        .withColumn("_block", every(blocks))
    )
    schema = T.StructType(
        [*[titles.schema[c] for c in owner], titles.schema["work_id"], lines.schema["segment_id"]]
    ).add("score", "double")

    def best_in_part(wanted: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = [] if wanted.empty or found.empty else _best_segments(wanted["_title"], found["_key"], limit)
        best = pd.DataFrame({c: wanted[c].iloc[[r[0] for r in rows]].to_numpy() for c in (*owner, "work_id")})
        ids = found["segment_id"].tolist()
        best["segment_id"] = pd.Series([min((ids[i] for i in r[1]), key=_ordered) for r in rows], dtype=object)
        best["score"] = [r[2] for r in rows]
        return best

    where = [*owner, "_block", "_part"]
    found = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(best_in_part, schema)
    best = found.groupBy(*owner, "work_id").agg(F.min(F.struct("score", "segment_id")).alias("b"))
    return best.select(*owner, "work_id", "b.segment_id", "b.score").orderBy(*owner, "score", "work_id")


def _ordered(value):
    """A segment id as Spark orders it: a struct by its fields."""
    return tuple(map(_ordered, value.values())) if isinstance(value, dict) else value


def _trigrams(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (place of the key, trigram) of all keys, in order of trigram and place.

    Keys hold digits, letters and blanks, so a trigram is three bytes of one number.
    """
    lengths = keys.str.len().to_numpy(dtype=np.int64)
    data = np.frombuffer("".join(keys).encode("ascii"), dtype=np.uint8).astype(np.int64)
    if len(data) < REFERENCE_GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(keys)), lengths)
    inside = row[2:] == row[:-2]
    gram = ((data[:-2] << 16) | (data[1:-1] << 8) | data[2:])[inside]
    both = np.sort((gram << 32) | row[2:][inside])
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both & 0xFFFFFFFF, both >> 32


def _best_segments(titles: pd.Series, keys: pd.Series, limit: float) -> list[tuple[int, np.ndarray, float]]:
    """(place of the title, places of its best segments, score) where a segment is within the limit."""
    keys = keys.fillna("")
    place, gram = _trigrams(keys)
    title, wanted = _trigrams(titles)
    by_title = np.argsort(title, kind="stable")
    title, wanted = title[by_title], wanted[by_title]
    first, last = np.searchsorted(gram, wanted), np.searchsorted(gram, wanted, side="right")
    starts = np.searchsorted(title, np.arange(len(titles) + 1))
    out = []
    for t, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        n = int(b - a)
        missing = int(np.floor(limit * n + 1e-9))
        hits = max(min(-(-n // 4), n - missing), 1)
        order = a + np.argsort((last - first)[a:b], kind="stable")
        lists = [place[first[i] : last[i]] for i in order]
        rare, rest = lists[: missing + hits], lists[missing + hits :]
        counts = np.bincount(np.concatenate(rare), minlength=len(keys))
        near = np.flatnonzero(counts >= hits)
        if not len(near):
            continue
        total = counts[near]
        for held in rest:
            at = np.minimum(np.searchsorted(held, near), max(len(held) - 1, 0))
            total = total + (held[at] == near if len(held) else 0)
        score = float(n - total.max()) / n
        if score <= limit:
            out.append((t, near[total == total.max()], score))
    return out
