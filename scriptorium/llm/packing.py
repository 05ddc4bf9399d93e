"""Packing of documents into windows by lexical retrieval.

Documents become token ids, in shards of a bounded number of tokens.  Shards follow the
order of a lexical key (the least hash among a document's tokens) and then of the id, so
documents with common words meet, while a key that many documents have is still spread
over shards.  Each shard holds a BM25 inverted index of its documents; document frequencies
and the mean length are those of the whole table.  The first unused document seeds a window,
the index returns its unused neighbours by score over all words of the seed, and they fill the window; a document that
does not fit is cut and its rest seeds the next window.  The last, partial window of a shard
is cut into lengths that are powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import blocks, over_batches, over_streams, stored
from scriptorium.llm.tokens import token_arrays

WINDOW = 4096
#: Tokens of a shard, about; what a task holds is a small multiple of it (or one document).
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian uint32, ``end_id`` last), ``n_tokens`` and
    ``near`` (the lexical key).  A null text counts as empty."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))

    def begin():
        encode = token_arrays(tokenizer_path, drops_space=True)
        end = np.array([end_id], "<u4")

        def each(batch):
            for block in blocks(batch, "text"):
                found = [np.append(a, end) for a in encode([t or "" for t in block.column("text").to_pylist()])]
                yield {
                    "doc_id": block.column("doc_id"),
                    "ids": [a.tobytes() for a in found],
                    "n_tokens": [len(a) for a in found],
                    "near": [int(_mixed(a[:-1]).min()) if len(a) > 1 else 0 for a in found],
                }

        return each

    return over_batches(rows, begin, "doc_id long, ids binary, n_tokens long, near long")


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of ids in 31 bits."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(33)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """``ids`` in 16 bits if they fit, which numpy sorts by counting."""
    return ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids


def _distinct(ids: np.ndarray) -> np.ndarray:
    found = np.sort(_narrow(ids), kind="stable")
    keep = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found[keep]


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """``token`` and ``docs``, over all documents; at most as many rows as the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                seen = _distinct(np.frombuffer(data.as_buffer(), "<u4"))
                if len(seen) and seen[-1] >= len(total):
                    total = np.pad(total, (0, int(seen[-1]) + 1 - len(total)))
                total[seen] += 1
        there = np.flatnonzero(total)
        yield {"token": there, "docs": total[there]}

    return over_streams(tokens.select("ids"), run, "token long, docs long").groupBy("token").agg(
        F.sum("docs").alias("docs")
    )


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    query_terms: int | None = None,
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` tokens.

    Returns ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids``
    (binary uint32), ``doc_tokens``, ``sequence_id``, ``offset`` and ``sequence_length``
    (``window`` or a smaller power of two).  Every id is in one piece; offsets have no gaps.
    A seed asks with all its words, or the ``query_terms`` most telling.
    A null text counts as empty (the end id alone), a null id is kept, equal rows are packed
    each, an empty table gives no piece.  The driver gets the frequencies of the vocabulary.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    tokens = stored(tokenize(df, tokenizer_path, end_id, id_col, text_col), "tokens")
    size = tokens.agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).first()
    n_docs, n_tokens = size["docs"], size["tokens"] or 0
    frequency = document_frequencies(tokens).toPandas()  # one row a vocabulary entry at most
    idf = np.zeros(int(frequency["token"].max()) + 1 if len(frequency) else 1, np.float32)
    docs = frequency["docs"].to_numpy(np.float64)
    idf[frequency["token"].to_numpy(np.int64)] = np.log1p((n_docs - docs + 0.5) / (docs + 0.5))
    mean = n_tokens / max(n_docs, 1)
    shared = df.sparkSession.sparkContext.broadcast(idf)
    parts = max(1, -(-n_tokens // shard_tokens))

    def run(batches):
        ids, arrays = [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            arrays += [np.frombuffer(x.as_buffer(), "<u4").copy() for x in batch.column("ids")]
        if not ids:
            return
        shard = TaskContext.get().partitionId() << 32
        pieces = pack_shard(arrays, shared.value, mean, window, query_terms)
        for at in range(0, len(pieces), 4096):
            now = pieces[at : at + 4096]
            yield {
                "doc_id": [ids[p[0]] for p in now],
                "start": [p[1] for p in now],
                "length": [p[2] for p in now],
                "ids": [arrays[p[0]][p[1] : p[1] + p[2]].tobytes() for p in now],
                "doc_tokens": [len(arrays[p[0]]) for p in now],
                "sequence_id": [shard + p[3] for p in now],
                "offset": [p[4] for p in now],
                "sequence_length": [p[5] for p in now],
            }

    dealt = tokens.repartitionByRange(parts, "near", "doc_id").sortWithinPartitions("near", "doc_id", "ids")
    return over_streams(dealt.select("doc_id", "ids"), run, PIECES)


class ShardIndex:
    """The BM25 inverted index of a shard's documents."""

    def __init__(self, arrays: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(a) for a in arrays])
        owner = np.repeat(np.arange(len(arrays), dtype=np.int64), sizes)
        terms = _narrow(np.concatenate(arrays))
        order = np.argsort(terms, kind="stable")  # by term, then by document
        terms, owner = terms[order], owner[order]
        begin = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])])
        tf = np.diff(np.r_[begin, len(terms)])
        self.docs = owner[begin]
        norm = K1 * (1 - B + B * sizes[self.docs] / mean)
        self.weights = idf[terms[begin]] * tf * (K1 + 1) / (tf + norm)
        self.begin = np.searchsorted(terms[begin].astype(np.int64), np.arange(len(idf) + 1))
        self.idf, self.n_docs = idf, len(arrays)

    def forget(self, used: np.ndarray) -> None:
        """Drop the postings of ``used`` documents."""
        keep = ~used[self.docs]
        self.begin = np.r_[0, np.cumsum(keep)][self.begin]
        self.docs, self.weights = self.docs[keep], self.weights[keep]

    def neighbours(self, ids: np.ndarray, terms: int | None = None) -> np.ndarray:
        """Documents by falling score for all ``ids``, or the most telling of them, ties by place."""
        asked = _distinct(ids)
        if terms is not None:
            asked = asked[np.argsort(-self.idf[asked], kind="stable")[:terms]]
        lists = [slice(self.begin[t], self.begin[t + 1]) for t in asked]
        docs = np.concatenate([self.docs[s] for s in lists])
        score = np.bincount(docs, np.concatenate([self.weights[s] for s in lists]), self.n_docs)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(
    arrays: list[np.ndarray], idf: np.ndarray, mean: float, window: int, terms: int | None = None
) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start, length, sequence, offset, sequence length) of every piece of a shard."""
    index = ShardIndex(arrays, idf, mean)
    done = [0] * len(arrays)  # ids of each document already placed
    used = np.zeros(len(arrays), bool)
    pieces: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0
    for d, ids in enumerate(arrays):
        while len(ids) - done[d] >= window:  # full windows of a long document stay its own
            pieces.append((d, done[d], window, sequence, 0, window))
            done[d] += window
            sequence += 1
        used[d] = done[d] == len(ids)
    live = len(arrays)  # documents of the index
    filled, held = 0, []  # of the window in work
    rest, seed = None, 0
    while True:
        while seed < len(arrays) and used[seed]:
            seed += 1
        if rest is None and seed == len(arrays):
            break
        start = seed if rest is None else rest
        rest = None
        if 2 * (left := len(arrays) - np.count_nonzero(used)) < live:  # these would be skipped
            index.forget(used)
            live = left
        found = index.neighbours(arrays[start], terms)
        for d in (start, *found[~used[found]].tolist()):
            if used[d]:
                continue
            size = min(len(arrays[d]) - done[d], window - filled)
            held.append((d, done[d], size))
            done[d] += size
            filled += size
            used[d] = done[d] == len(arrays[d])
            if filled == window:
                at = 0
                for doc, begin, length in held:
                    pieces.append((doc, begin, length, sequence, at, window))
                    at += length
                sequence += 1
                filled, held = 0, []
                rest = None if used[d] else d
                break
    # The partial window, in falling powers of two.
    queue = held[::-1]
    while filled:
        size = 1 << (filled.bit_length() - 1)
        filled -= size
        at = 0
        while at < size:
            doc, begin, length = queue.pop()
            now = min(length, size - at)
            pieces.append((doc, begin, now, sequence, at, size))
            at += now
            if now < length:
                queue.append((doc, begin + now, length - now))
        sequence += 1
    return pieces
