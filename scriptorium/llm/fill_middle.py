"""Fill-in-middle transformation: a text cut into prefix, middle and suffix at line ends.

The cuts are found on whole Arrow buffers: the UTF-8 bytes of many texts are viewed as 64-bit
words, every line feed sets the high bit of its byte by word arithmetic, set bits are counted a
word at a time, and the k-th line end of a text is looked up in the running counts and then by
bytes inside its word.  The same counts on the bytes that begin a code point give the lengths.
No text becomes a Python string.

Units are lines, ``[^\\n]*\\n|[^\\n]+``, n of them.  The hex sha256 of ``seed:doc_id`` gives four
numbers h1 to h4: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the
middle after the larger; h3 % 100 decides whether the text is cut, h4 % 100 in which order the
parts go.

Nulls: a null text is an empty one, a null id is written as no digits.  A text that is empty or
holds a marker stays plain, so that every output can be turned back.  Rows with equal ids are cut
alike.  An empty table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import blocks, over_batches

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")

LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)
FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE, SEVEN = np.uint64(1), np.uint64(7)

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Marks:
    """Marked bytes of a buffer: their number before a byte, and the byte of the k-th.

    ``words`` has the high bit of every marked byte set, the first byte of the buffer lowest.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (ONE << (byte << np.uint64(3))) - ONE
        inside = np.append(self.words, np.uint64(0))[word] & below
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the mark that has ``k`` marks before it."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[word]
        flags = (self.words[word][:, None] >> np.arange(7, 64, 8, dtype=np.uint64)) & ONE
        return word * 8 + (np.cumsum(flags, axis=1) <= left[:, None]).sum(axis=1)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, with zero bytes at the end."""
    out = np.zeros(-(-len(data) // 8), "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def line_feeds(words: np.ndarray) -> Marks:
    """Bytes that end a line: zero after the exclusive or, found without a carry between bytes."""
    x = words ^ FEEDS
    return Marks(~(((x & LOW7) + LOW7) | x | LOW7))


def code_points(words: np.ndarray) -> Marks:
    """Bytes that begin a code point, which are all but 10xxxxxx (the zero bytes at the end too)."""
    return Marks(HIGH & ~(words & ~(words << ONE)))


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units, the byte where the prefix ends and where the middle ends, and the code points of
    prefix and middle, of the texts between ``starts`` and ``ends``."""
    words = words_of(data)
    feeds, points = line_feeds(words), code_points(words)
    first = feeds.rank(starts)
    whole = feeds.rank(ends) - first
    open_end = (ends > starts) & (data[np.maximum(ends, 1) - 1] != 10) if len(data) else ends > starts
    n = whole + open_end
    sides = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    places = []
    for k in sides:
        at = np.where(k == 0, starts, ends)
        inner = (k > 0) & (k <= whole)
        at[inner] = feeds.select((first + k - 1)[inner]) + 1
        places.append(at)
    ranks = [points.rank(at) for at in (starts, *places)]
    return n, places[0], places[1], ranks[1] - ranks[0], ranks[2] - ranks[1]


def _assembled(data: bytes, starts, ends, one, two, form: np.ndarray, markers) -> pa.Array:
    """The outputs as one string array; ``form`` is 0 plain, 1 psm, 2 spm."""
    p, s, m = (x.encode() for x in markers)
    pieces = []
    offsets = np.zeros(len(starts) + 1, np.int64)
    extra = len(p) + len(s) + len(m)
    np.cumsum(ends - starts + extra * (form > 0), out=offsets[1:])
    view = memoryview(data)
    for a, b, c, d, f in zip(starts.tolist(), one.tolist(), two.tolist(), ends.tolist(), form.tolist()):
        if f == 0:
            pieces.append(view[a:d])
        elif f == 1:
            pieces += (p, view[a:b], s, view[c:d], m, view[b:c])
        else:
            pieces += (s, view[c:d], p, view[a:b], m, view[b:c])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(b"".join(pieces))).cast(pa.string())


def transform(
    docs: DataFrame,
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    markers: tuple[str, str, str] = MARKERS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars`` and ``middle_chars``
    (code points, null if plain) and ``output``.

    psm is prefix, suffix, middle and spm suffix, prefix, middle, each after its marker.
    ``percent`` of the texts are cut, ``spm_percent`` of these as spm.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)],
    )
    names = np.array(["plain", "psm", "spm"])

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in blocks(batch, "text", 16 << 20):
            texts = part.column("text")
            offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
            low, offsets = int(offsets[0]), offsets.astype(np.int64) - int(offsets[0])
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low : low + offsets[-1]]
            h = [part.column(f"h{i}").to_numpy() for i in range(4)]
            starts, ends = offsets[:-1], offsets[1:]
            n, one, two, prefix, middle = cuts(data, starts, ends, np.stack(h[:2]))
            marked = np.zeros(len(texts), bool)
            for marker in markers:
                marked |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
            plain = marked | (starts == ends) | (h[2] % 100 >= percent)
            form = np.where(plain, 0, np.where(h[3] % 100 < spm_percent, 2, 1))
            yield {
                "doc_id": part.column("doc_id"),
                "n": pa.array(n, pa.int64()),
                "form": pa.array(names[form].tolist(), pa.string()),
                "prefix_chars": pa.array(prefix, pa.int64(), mask=plain),
                "middle_chars": pa.array(middle, pa.int64(), mask=plain),
                "output": _assembled(data.tobytes(), starts, ends, one, two, form, markers),
            }

    return over_batches(rows, lambda: each, SCHEMA)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that :func:`transform` made ``output`` from.

    A marker occurs once in an output that is not plain: no text that holds one is cut, and none
    arises at a seam, since its first character occurs nowhere else in it.
    """
    p, s, m = markers

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, start, -1), end, 1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Rows of :func:`transform` with checksums of the output and of the text rebuilt from it."""
    back = restored(F.col("output"), F.col("form"), markers)
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
