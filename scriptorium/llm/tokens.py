"""Ids by the tokenizers library, with equal words encoded once per worker.

Both kinds of vocabulary split text before merging and never let a token span a space
that has other characters on both sides, so such spaces are safe places to cut: the ids
of a text are those of its words in a row.  A text where a cut would touch a run of white
space (whose split depends on its length) is given to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np

from scriptorium.llm.common import WordCache

#: What may end a word after its letters without touching their tokens: ASCII but letters, blanks
#: and the apostrophe of contractions.
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha() and chr(c) != "'")
#: Words of letters that the library gets as one text; one call has a cost of its own.
_TOGETHER = 64


def token_arrays(path: str, drops_space: bool) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to arrays of ids (uint32), without special tokens; strings of
    special tokens in a text are ordinary text.

    ``drops_space``: the vocabulary ignores white space, so that cuts need no care.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    names = {i: name for name, i in tokenizer.get_vocab().items()}
    # A word's first token carries the space before it, or its last one the word's end.
    marks = np.zeros(max(names) + 1, bool)
    for i, name in names.items():
        marks[i] = name.endswith("</w>") if drops_space else name.startswith("\u0120")
    before = "" if drops_space else " "

    def ids(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", f.ids).tobytes() for f in found]

    def of_letters(words: list[str]) -> list[bytes]:
        """Ids of words of letters, many in one text, cut where the next word begins."""
        groups = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        out: list[bytes] = []
        for group, data in zip(groups, ids([before + " ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(marks[np.frombuffer(data, "<u4")]) + drops_space
            cuts = [*(4 * at).tolist(), len(data)] if not drops_space else [0, *(4 * at).tolist()]
            if len(cuts) == len(group) + 1 and cuts[0] == 0 and cuts[-1] == len(data):
                out += [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            else:
                out += ids([before + w for w in group])
        return out

    def compute(words: list[str]) -> list[bytes | None]:
        """Ids of new words, with the space before them where the vocabulary keeps spaces; None
        for words that begin or end with white space, or are empty, where the space belongs to
        a run.  A word that is letters with a tail is the ids of both."""
        known = cache.state["new"]
        cores = [w.rstrip(_TAIL) for w in words]
        letters = {c for c in cores if c not in known and c.isalpha()}
        fresh = list(letters)
        known.update(zip(fresh, of_letters(fresh), strict=True))
        plain = [w for w in words if w not in known and not w.rstrip(_TAIL).isalpha() and (drops_space or safe(w))]
        known.update(zip(plain, ids([before + w for w in plain]), strict=True))
        tails = list({w[len(c) :] for w, c in zip(words, cores, strict=True) if c.isalpha() and len(c) < len(w)})
        ends = dict(zip(tails, ids(tails), strict=True))
        return [
            known[c] + ends[w[len(c) :]] if c.isalpha() and len(c) < len(w) else known.get(w)
            for w, c in zip(words, cores, strict=True)
        ]

    def safe(word: str) -> bool:
        return bool(word) and not word[0].isspace() and not word[-1].isspace()

    cache = WordCache(f"words {path}", compute)

    def of_words(texts: list[str]) -> list[bytes]:
        # The vocabulary is of lower case; only the sigma's lower case depends on its place.
        texts = [t if "Σ" in t else t.lower() for t in texts]
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        known = cache.fill(lists)
        return [b"".join(map(known.__getitem__, words)) for words in lists]

    def of_spaced(texts: list[str]) -> list[bytes]:
        heads, rests = [], []
        for t in texts:
            head, _, rest = t.partition(" ")
            heads.append(head)
            rests.append(rest.split(" ") if _ else [])
        known = cache.fill(rests)
        out: list[bytes | None] = []
        for head, rest in zip(heads, rests, strict=True):
            parts = [*map(known.__getitem__, rest)]
            whole = None in parts or (rest and (not head or head[-1].isspace()))
            out.append(None if whole else b"".join(parts))
        begun = ids([t if o is None else h for t, h, o in zip(texts, heads, out, strict=True)])
        return [f if o is None else f + o for f, o in zip(begun, out, strict=True)]

    encode = of_words if drops_space else of_spaced
    return lambda texts: [np.frombuffer(b, "<u4") for b in encode(texts)]
