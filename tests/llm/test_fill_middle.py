"""op11 against a plain version of its contract, and its word arithmetic against plain counts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from scriptorium.llm import catalog, fill_middle
from tests.llm import fixtures as fx

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = LINE.findall(text)
    n = len(units)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fill_middle.MARKERS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts() -> list[tuple[int, str | None]]:
    draw = random.Random(4)
    odd = ["", None, "\n", "\n\n\n", "x", "é\n漢字\r\n😀", "a\n b\x0bc\x85d\n", "<P>", "a <S> b\n", "<M", "<\n<P\n>", "\x00\n\x00",
           "\x8a\nਊ\n", "one\ntwo\n" * 40_000, "long line without an end " * 20_000]
    odd += ["".join(draw.choices("ab\n\n é漢😀<PSM>", k=draw.randrange(1, 60))) for _ in range(400)]
    return list(enumerate(odd, -3))


def test_op11_against_plain_version(spark):
    rows = texts()
    found = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    assert got == {d: plain(d, t) for d, t in rows}
    for r in fill_middle.digests(found).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.output_sha256 == sha(plain(r.doc_id, text)[4]) and r.restored_sha256 == sha(text)


def test_op11_rates(spark):
    rows = [(i, f"{i}\n" * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in fill_middle.transform(df, seed=3, percent=40, spm_percent=10).collect()}
    assert got == {d: plain(d, t, 3, 40, 10) for d, t in rows}
    assert {form for _, form, *_ in got.values()} == {"plain", "psm", "spm"}


def test_marks_against_plain_counts():
    draw = random.Random(8)
    for _ in range(60):
        text = "".join(draw.choices("a\n é漢😀\x00\x0b", k=draw.randrange(0, 90)))
        data = np.frombuffer(text.encode(), np.uint8)
        words = fill_middle.words_of(data)
        feeds, points = fill_middle.line_feeds(words), fill_middle.code_points(words)
        at = np.arange(len(data) + 1)
        assert feeds.rank(at).tolist() == [bytes(data[:i]).count(b"\n") for i in at]
        assert points.rank(at).tolist() == [sum(b & 0xC0 != 0x80 for b in data[:i].tolist()) for i in at]
        ends = np.flatnonzero(data == 10)
        assert feeds.select(np.arange(len(ends))).tolist() == ends.tolist()


def test_op11_whole_table_and_edges(spark):
    docs = {d: t for d, t, _ in fx.documents(spark)}
    rows = catalog.QUERIES["op11_fill_middle"](spark, fx.SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, output = plain(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(docs[r.doc_id] or ""))
    odd = sorted(fill_middle.transform(fx.odd(spark)).collect(), key=str)
    want = sorted([(r[0], *plain(r[0], r[1])) for r in fx.ODD], key=str)
    assert sorted(map(str, map(tuple, odd))) == sorted(map(str, want))
    assert fill_middle.digests(fill_middle.transform(fx.nothing(spark))).count() == 0
