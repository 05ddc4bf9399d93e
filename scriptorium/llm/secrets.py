"""Secret scans of text by patterns and by assignment-aware lexing.

Three patterns find the plain shapes.  The lexer finds what a pattern cannot: it reads
assignments of source code and configuration (``name = "..."``, ``"name": "..."``,
``name: value``, ``export NAME=value``, ``name: type = "..."``, ``<name>value</name>``) as pairs
of a name and an expression of literals and other names, follows the other names to the
literals that they stand for (by the last assignment before the use), and scores the literals by how sensitive the target's name is
and by how random they look.  Literals that reach a sensitive name add spans of kind ``flow``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from scriptorium.llm.common import blocks, over_batches

KINDS = ("assign", "access", "hex", "flow")

# The patterns of the plain shapes and the least lengths of a finding.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_LENGTH = 16

#: How sensitive a name is by the words in it; the strongest counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "authorization": 0.8,
    "bearer": 0.8, "auth": 0.6, "signing": 0.6, "private": 0.6, "salt": 0.6,
}
#: Pairs of words that are sensitive together.
PAIRS = {
    ("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0,
    ("encryption", "key"): 1.0, ("auth", "key"): 0.9, ("account", "key"): 0.9, ("master", "key"): 0.9,
    ("client", "secret"): 1.0, ("connection", "string"): 0.7,
}
#: Words that make a name describe a secret rather than hold one.
HARMLESS = {
    "public", "example", "name", "url", "uri", "path", "file", "field", "label", "type", "count",
    "length", "limit", "max", "min", "size", "policy", "hint", "header", "prefix", "regex", "id",
}
PLACEHOLDER = re.compile(
    r"(?i)changeme|change_me|example|placeholder|your[_-]|dummy|redacted|^x+$|^\*+$|^<.*>$|^\$\{|^\{\{|^(.)\1*$"
)
MIN_LENGTH, MIN_BITS, MIN_SCORE = 8, 2.5, 0.5

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SET = re.compile(r"(?<![=!<>:+*/%&|^~-])(?::=|=>|[:=])(?![=:/])")
_TARGET = re.compile(r"""(["']?)([A-Za-z_$][\w$.\-]{0,127})\1[ \t]*$""", re.A)
_TYPED = re.compile(r"""([A-Za-z_$][\w$]{0,127})[ \t]*:[ \t]*[A-Za-z_][\w.\[\]<>, |]{0,63}$""", re.A)
_QUOTED = re.compile(r'''[fFrRbBuU]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)''')
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", re.A)
_BARE = re.compile(r"[^\s\"'`,;#(){}\[\]<>]+")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"'$])|(?=[\"'`]))[ \t]*")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]{0,127})>([^<>\n]+)</\1>", re.A)
_HEX_TABLE = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_REACH = 200


class Span(NamedTuple):
    """A finding: ``start`` to ``end`` in code points, and where its secret value begins."""

    start: int
    kind: str
    end: int
    value: int


def _named(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in ASSIGN_WORDS)


def base_spans(text: str) -> list[Span]:
    """Findings of the three patterns, in order of start and kind."""
    found: list[Span] = []
    if ("=" in text or ":" in text) and _named(text):
        found += [
            Span(m.start(), "assign", m.end(), m.start(2))
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH
        ]
    if "AKIA" in text:
        found += [
            Span(m.start(), "access", m.end(), m.start())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LENGTH
        ]
    if b"x" * HEX_LENGTH in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE):
        found += [
            Span(m.start(), "hex", m.end(), m.start())
            for m in HEX.finditer(text)
            if m.end() - m.start() >= HEX_LENGTH
        ]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def name_score(name: str) -> float:
    """How sensitive a target's name is, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    best = max([best, *(PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])
    return best * 0.3 if HARMLESS.intersection(words) else best


def literal_score(value: str) -> float:
    """How random a literal looks, 0 to 1; 0 for short, spaced and placeholder literals."""
    if len(value) < MIN_LENGTH or any(c.isspace() for c in value) or PLACEHOLDER.search(value):
        return 0.0
    total = len(value)
    bits = -sum(n / total * math.log2(n / total) for n in Counter(value).values())
    if bits < MIN_BITS:
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if kinds < 2 and bits < 3.5:
        return 0.3
    return min(1.0, 0.5 + 0.1 * kinds + 0.1 * (bits - MIN_BITS))


def assignments(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(name, terms) of every assignment; a term is (kind, start, end), its kind ``literal`` or
    ``name``."""
    found = []
    if "=" in text or ":" in text:
        for m in _SET.finditer(text):
            before = text[max(0, m.start() - _REACH) : m.start()]
            target = _TYPED.search(before) if m[0] == "=" else None
            name = target[1] if target else (target := _TARGET.search(before)) and target[2]
            if name and (terms := _terms(text, m.end())):
                found.append((name, terms))
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            found.append((m[1], [("literal", m.start(2), m.end(2))]))
    return found


def _terms(text: str, at: int) -> list[tuple[str, int, int]]:
    """The terms of an expression that begins at ``at``, joined by + or . or nothing."""
    while at < len(text) and text[at] in " \t":
        at += 1
    terms: list[tuple[str, int, int]] = []
    while at < len(text):
        if quoted := _QUOTED.match(text, at):
            g = next(g for g in (1, 2, 3) if quoted[g] is not None)
            terms.append(("literal", quoted.start(g), quoted.end(g)))
            at = quoted.end()
        elif (bare := _BARE.match(text, at)) is None:
            break
        else:
            name = _NAME.match(text, at)
            whole = name and (name.end() == bare.end() or text[name.end()] == "+")
            if whole:
                terms.append(("name", at, name.end()))
                at = name.end()
            elif not terms:
                terms.append(("literal", at, bare.end()))
                break
            else:
                break
        joined = _JOIN.match(text, at)
        if not joined:
            break
        at = joined.end()
    return terms


def flow_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, by way of other names where these are assigned."""
    pairs = assignments(text)
    if not any(name_score(name) > 0 for name, _ in pairs):
        return []
    known: dict[str, list[tuple[int, list[tuple[str, int, int]]]]] = {}
    for name, terms in sorted(pairs, key=lambda pair: pair[1][-1][2]):
        known.setdefault(name, []).append((terms[-1][2], terms))

    def value(name: str, at: int) -> tuple[int, list[tuple[str, int, int]]] | None:
        """The last assignment of a name that ends before its use ``at``, else the first after it."""
        every = known[name]
        i = bisect_right(every, at, key=lambda e: e[0])
        if i:
            return every[i - 1]
        return next((e for e in every if e[1][0][1] > at), None)

    def literals(terms: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
        out, stack, seen = [], terms[::-1], set()
        while stack:
            kind, start, end = stack.pop()
            name = text[start:end]
            if kind == "literal":
                out.append((start, end))
            elif name in known:
                set_to = value(name, start)
                if set_to and (name, set_to[0]) not in seen:
                    seen.add((name, set_to[0]))
                    stack.extend(set_to[1][::-1])
            elif len(terms) == 1:
                out.append((start, end))  # a bare word of a configuration file
        return out

    found = set()
    for name, terms in pairs:
        weight = name_score(name)
        if weight <= 0:
            continue
        parts = literals(terms)
        if weight * literal_score("".join(text[a:b] for a, b in parts)) >= MIN_SCORE:
            found.update(Span(a, "flow", b, a) for a, b in parts if b > a)
    return sorted(found)


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """(base findings, all findings): flows inside a base finding are left out."""
    base = base_spans(text)
    flow = [f for f in flow_spans(text) if not any(b.start <= f.start and f.end <= b.end for b in base)]
    return base, sorted(base + flow, key=lambda s: (s.start, KINDS.index(s.kind)))


def written(spans: list[Span]) -> str:
    """``kind:start:end`` of the spans, comma-joined."""
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """``text`` with the secret values of the spans replaced; overlapping values are one."""
    out, at, over = [], 0, -1
    for value, end in sorted((s.value, s.end) for s in spans):
        if value > over:
            out += [text[at : max(at, value)], mark]
        over = max(over, end)
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every whole text, where it is read: ``id_col``, ``n_assign``, ``n_access``,
    ``n_hex``, ``n_flow``, ``base_sha256`` and ``spans``.

    Null and empty texts have no finding; a null id is kept; equal rows give equal rows.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))

    def begin():
        def each(batch):
            for block in blocks(batch, "text"):
                found = [spans_of(t or "") for t in block.column("text").to_pylist()]
                counts = [Counter(s.kind for s in every) for _, every in found]
                yield {"id": block.column("id")} | {f"n_{k}": [c[k] for c in counts] for k in KINDS} | {
                    "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found],
                    "spans": [written(every) for _, every in found],
                }

        return each

    schema = "id long, n_assign long, n_access long, n_hex long, n_flow long, base_sha256 string, spans string"
    return over_batches(rows, begin, schema).withColumnRenamed("id", id_col)


def redact_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the values of all findings in ``text_col`` replaced; a null text stays null.

    All columns are returned, in their order; texts without a finding are unchanged.
    """
    fields = df.columns
    short = df.toDF(*[f"c{i}" for i in range(len(fields))])
    at, names = f"c{fields.index(text_col)}", short.columns

    def begin():
        def clean(text):
            spans = spans_of(text)[1] if text else None
            return redacted(text, spans) if spans else text

        def each(batch):
            for block in blocks(batch, at):
                yield {c: block.column(c) for c in names} | {
                    at: [clean(t) for t in block.column(at).to_pylist()]
                }

        return each

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.schema)
    return over_batches(short, begin, schema).toDF(*fields)
