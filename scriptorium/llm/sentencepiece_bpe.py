"""SentencePiece BPE by backtracking over longest matches.

A segmentation is the one that merging by score yields exactly when every token is
what merging makes of its own string and every adjacent pair of tokens survives
merging of the pair's string: the merges of the whole text, seen on two neighbouring
tokens, are the merges of these two alone.  So the encoder walks from left to right,
takes the longest token at each place, checks the pair with the token before by
merging it again (remembered per pair), falls back to the next shorter token, and
backs out of places from which no continuation exists.  A bitfield holds the places
already known to fail, which bounds the work.

Candidates come from one Aho-Corasick pass.  Text is cut first where no token of the
vocabulary can span, so equal stretches (mostly words) are encoded once per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from scriptorium.llm.common import WordCache, blocks, over_batches

SPACE = "▁"

#: Remembered pairs of tokens; the memory is emptied beyond that.
PAIRS = 400_000


class BpeModel:
    """Encoder and decoder of a BPE model file with byte fallback and identity normalization."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.unk, self.eos = model.unk_id(), model.eos_id()
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(size)]
        special = [
            model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
            for i in range(size)
        ]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [0] * 256
        byte_of = {}
        for i in range(size):
            if model.is_byte(i):
                value = int(self.pieces[i][3:-1], 16)
                self.bytes[value] = i
                byte_of[i] = value
        self._pairs: dict[int, bool] = {}
        # Only tokens that merging of their own string yields can occur in a result.
        self.usable = {
            p: i for p, i in self.ids.items() if len(p) == 1 or self._merged(list(p)) == [p]
        }
        self.finder = ahocorasick.Automaton()
        for p, i in self.usable.items():
            self.finder.add_word(p, (len(p), i))
        self.finder.make_automaton()
        self._cutter = self._cuts([p for p in self.ids if len(p) > 1])
        # Decoding: bytes of every id; control tokens decode to nothing.
        self.plain = [
            b"" if model.is_control(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.plain[self.unk] = " ⁇ ".encode()
        self.spelled = [bytes([byte_of[i]]) if i in byte_of else p for i, p in enumerate(self.plain)]
        self.byte_of = byte_of
        self.control = {i for i in range(size) if model.is_control(i)}
        self.silent = np.array([model.is_control(i) for i in range(size)])
        self.prefix = model.encode("a", out_type=str)[:1] in ([SPACE + "a"], [SPACE])

    @staticmethod
    def _cuts(longer: list[str]) -> re.Pattern:
        """Splits where no token can span: at characters of no longer token, and before a
        space after another character if no token has that inside."""
        inside = set("".join(longer))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            return re.compile(rf"[{alone}]|[^{alone}]+")
        return re.compile(rf"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def _merged(self, parts: list[str]) -> list[str]:
        """Merge neighbours by score, the leftmost of equals first, until none is a token."""
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spelling(self, token: int) -> str:
        """The string of a token; numbers past the vocabulary stand for characters without one."""
        size = len(self.pieces)
        return self.pieces[token] if token < size else chr(token - size)

    def _fits(self, key: int) -> bool:
        """Do the two tokens of ``key`` survive merging of their joined string?  Remembered."""
        left, right = self._spelling(key >> 22), self._spelling(key & 0x3FFFFF)
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        fits = left + right not in self.score and self._merged(list(left + right)) == [left, right]
        self._pairs[key] = fits
        return fits

    def tokens_of(self, text: str) -> list[int]:
        """Tokens of one stretch of normalized text, characters without one as in `_spelling`."""
        whole = self.usable.get(text)
        if whole is not None:
            return [whole]
        n, size, known = len(text), len(self.pieces), self._pairs
        # Matches come by their ends, so those that begin at one place come by length.
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (width, token) in self.finder.iter(text):
            at[end - width + 1].append((end + 1, token))
        if [] in at:
            at = [found or [(i + 1, size + ord(text[i]))] for i, found in enumerate(at)]
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        back: list[tuple[int, int]] = []  # where each token begins, its candidates not yet tried
        pos, left, before = 0, len(at[0]) - 1, -1
        while pos < n:
            here = at[pos]
            while left >= 0:
                after, token = here[left]
                left -= 1
                if failed[after >> 3] >> (after & 7) & 1:
                    continue
                if before >= 0:
                    key = before << 22 | token
                    fits = known.get(key)
                    if not (self._fits(key) if fits is None else fits):
                        continue
                out.append(token)
                back.append((pos, left))
                pos, before = after, token
                left = len(at[pos]) - 1 if pos < n else -1
                break
            else:
                # The fitting tokens so far are the one segmentation of the text before this
                # place, so every path through it fails.
                failed[pos >> 3] |= 1 << (pos & 7)
                out.pop()
                pos, left = back.pop()
                before = out[-1] if out else -1
        return out

    def ids_of(self, text: str) -> list[int]:
        """Ids of one stretch; characters without a token become their UTF-8 bytes."""
        size = len(self.pieces)
        out = self.tokens_of(text)
        if max(out) < size:
            return out
        spread: list[int] = []
        for token in out:
            if token < size:
                spread.append(token)
            else:
                spread.extend(self.bytes[b] for b in chr(token - size).encode())
        return spread

    def stretches(self, text: str) -> list[str]:
        """Normalized ``text`` cut where no token can span (empty for an empty text)."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self._cutter.findall(SPACE + text if self.prefix else text)

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a whole text, as the library gives them, with the end id if asked."""
        out = [i for part in self.stretches(text) for i in self.ids_of(part)]
        return [*out, self.eos] if end else out

    def decode_array(self, ids: np.ndarray) -> str:
        """As :meth:`decode`; joins the bytes at once where all byte runs are whole characters."""
        values = ids.tolist()
        if self.silent[ids[:-1]].any():
            return self.decode(values)
        data = b"".join(map(self.spelled.__getitem__, values))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self.decode(values)
        marked = values and self.prefix and values[0] not in self.byte_of and values[0] != self.unk
        return text.removeprefix(" ") if marked else text

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: spaces for marks, the leading one dropped, byte runs as UTF-8
        with U+FFFD for every byte that is not part of a character."""
        out: list[str] = []
        run = bytearray()
        plain, byte_of = self.plain, self.byte_of
        first = True
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                first = False
                continue
            if run:
                out.append(_utf8(run))
                run.clear()
            if i in self.control:
                continue
            piece = plain[i].decode()
            if first and self.prefix and piece.startswith(" ") and i != self.unk:
                piece = piece[1:]
            first = False
            out.append(piece)
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytes) -> str:
    """A byte run as text; each byte outside a whole character gives one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[i : i + size]).decode())
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, and the text that they decode to.

    Returns ``id_col``, ``ids`` (array of int, the end id last) and ``decoded``.  A null text
    counts as empty (the end id alone); a null id is kept; equal rows give equal rows; an
    empty table gives an empty one.  No shuffle: rows are encoded where they are read.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    out = over_batches(rows, _encoder(path), "id long, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digest_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with digests in place of ids and text: ``n_tokens``,
    ``ids_sha256`` (of the decimal ids joined by a space) and ``decoded_sha256``."""
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return over_batches(rows, _encoder(path, True), schema).withColumnRenamed("id", id_col)


def _encoder(path: str, digest: bool = False):
    def begin():
        model = BpeModel(path)
        cache = WordCache(
            f"pieces {path}", lambda words: [np.array(model.ids_of(w), "<i4").tobytes() for w in words]
        )
        end = np.array([model.eos], "<i4").tobytes()

        def each(batch):
            for rows in blocks(batch, "text"):
                texts = rows.column("text").to_pylist()
                parts = [model.stretches(t or "") for t in texts]
                known = cache.fill(parts)
                ids = [
                    np.frombuffer(b"".join([*map(known.__getitem__, p), end]), "<i4") for p in parts
                ]
                decoded = [model.decode_array(i) for i in ids]
                if digest:
                    yield {
                        "id": rows.column("id"),
                        "n_tokens": [len(i) for i in ids],
                        "ids_sha256": [_hex(" ".join(map(str, i.tolist())).encode()) for i in ids],
                        "decoded_sha256": [_hex(d.encode()) for d in decoded],
                    }
                else:
                    yield {"id": rows.column("id"), "ids": ids, "decoded": decoded}

        return each

    return begin


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
