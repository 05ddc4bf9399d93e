"""Secrets, quality, fingerprints and languages."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import catalog, language, quality_classifier, quality_rules, secrets, syncmers
from tests.llm import fixtures as fx


def plain_spans(text: str) -> str:
    out = []
    for rank, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
            ("access", r"AKIA[A-Z0-9]+", 0, 18),
            ("hex", r"[0-9a-f]+", 0, 16),
        )
    ):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_op2_whole_table(spark):
    found = {r.doc_id: r for r in catalog.QUERIES["op2_secrets"](spark, fx.SF).collect()}
    for doc, text, _ in fx.documents(spark):
        want, row = plain_spans(text or ""), found.pop(doc)
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert (row.n_assign, row.n_access, row.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(filter(None, want.split(","))) <= set(row.spans.split(","))
    assert not found


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ('k = "s3cr3t-Zq81Lm"\npassword = k', 'k = "[REDACTED]"\npassword = k'),
        ('a="AKd8"+"x9Qz71pL"; db_secret=a', 'a="[REDACTED]"+"[REDACTED]"; db_secret=a'),
        ('{"client_secret": "Jq81-ZmmQ0pX"}', '{"client_secret": "[REDACTED]"}'),
        ("<api-key>Zq81LmQ0pX77</api-key>", "<api-key>[REDACTED]</api-key>"),
        ("export DB_PASS=hunter2Zq81", "export DB_PASS=[REDACTED]"),
        ('password: str = "Zq81LmQ0pX77"', 'password: str = "[REDACTED]"'),
        ("db:\n  passphrase: Zq81-LmQ0pX77", "db:\n  passphrase: [REDACTED]"),
    ],
)
def test_flows_to_sensitive_names(text, clean):
    assert secrets.redacted(text, secrets.spans_of(text)[1]) == clean


@pytest.mark.parametrize(
    "text",
    ["token: the cat", 'secret_name = "my-secret-name"', "password = ''", 'password = "changeme"', "a = b\nb = a\npassword = a",
     "He said: the secret = love", "x == y", "time: 10:30", "secret\n=\n"],
)
def test_harmless_assignments(text):
    assert secrets.spans_of(text)[1] == []


def test_secret_edges(spark):
    assert secrets.scan_documents(fx.odd(spark)).count() == len(fx.ODD)
    cleaned = secrets.redact_documents(fx.odd(spark))
    assert cleaned.columns == fx.odd(spark).columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[-8] == 'token = "[REDACTED]" and [REDACTED]' and texts[1] is None
    assert secrets.scan_documents(fx.nothing(spark)).count() == 0
    long = "password = '" + "x1Y" * 200_000 + "' " + "name = 'value' " * 20_000
    assert len(secrets.spans_of(long)[0]) == 1


def plain_quality(text: str | None) -> tuple:
    words = fx.WORD.findall(text or "")
    count = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if fx.WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
        len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_op3_whole_table(spark):
    found = {r.doc_id: r for r in catalog.QUERIES["op3_quality_rules"](spark, fx.SF).collect()}
    for doc, text, _ in fx.documents(spark):
        r = found.pop(doc)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(text)
        assert not (r.base_failed and r.kept)
    assert not found


def test_op3_edges(spark):
    rows = quality_rules.judge(fx.odd(spark)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((d, *plain_quality(t)) for d, t, *_ in fx.ODD)
    assert quality_rules.judge(fx.nothing(spark)).count() == 0


def test_op3_runs_no_python(spark):
    plan = quality_rules.judge(spark.read.parquet(f"{fx.SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_rules_keep_good_documents(spark):
    kept = {r.doc_id: r for r in quality_rules.judge(spark.read.parquet(f"{fx.SF}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{fx.SF}/labels.parquet").collect()
    assert all(kept[r.doc_id].kept or kept[r.doc_id].base_failed for r in labels if r.quality == 1)
    assert not any(kept[r.doc_id].kept for r in labels if r.quality == 0)


def test_op5_whole_table(spark):
    found = {r.doc_id: r for r in catalog.QUERIES["op5_syncmers"](spark, fx.SF).collect()}
    docs = fx.documents(spark)
    closer = 0
    for (doc, text, _), (_, following, _) in zip(docs, [*docs[1:], docs[0]], strict=True):
        r, half = found.pop(doc), len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one, two = (syncmers.fingerprint(syncmers.code_points(t)) for t in (text, edited))
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.text_of(one), syncmers.text_of(two))
        assert r.near_edited == syncmers.likeness(one, two)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        closer += r.near_edited > r.near_next
    assert not found and closer > 0.9 * len(docs)


@pytest.mark.parametrize("parts", ["1", "3", "64"])
def test_op5_next_document_over_any_ranges(spark, parts):
    docs = spark.createDataFrame([(7 * d % 31, f"text number {d} " * (d % 5)) for d in range(31)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = {r.doc_id: r for r in syncmers.edited_documents(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = {7 * d % 31: f"text number {d} " * (d % 5) for d in range(31)}
    assert len(rows) == 31
    for d, text in texts.items():
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(d + 1) % 31][:half]
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_op5_edges(spark):
    rows = syncmers.edited_documents(fx.odd(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in fx.ODD)
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert syncmers.edited_documents(fx.nothing(spark)).count() == 0
    assert syncmers.fingerprint_documents(fx.odd(spark)).count() == len(fx.ODD)


def test_anchors_depend_on_their_characters_only():
    text = "the quick brown fox jumps over the lazy dog and runs away from all the others"
    hashes, places = syncmers.anchors(syncmers.code_points(text))
    moved, later = syncmers.anchors(syncmers.code_points("something before it, " + text))
    assert set(hashes.tolist()) <= set(moved.tolist())
    points = syncmers.code_points(text * 50)
    whole = syncmers.anchors(points)
    block, syncmers.BLOCK = syncmers.BLOCK, 97
    try:
        parts = syncmers.anchors(points)
    finally:
        syncmers.BLOCK = block
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = catalog.QUERIES["op6_language"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(langs) and len(rows) == len(langs)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_op6_edges(spark):
    learned = {"en": b"the same words in the same order once and again", "fr": "les mêmes mots dans le même ordre".encode()}
    rows = language.identify(fx.odd(spark), learned).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(fx.ODD)
    assert [by[d].lang_pred for d in (1, 2, 3)] == ["und"] * 3 and by[1].rejected
    assert by[4].lang_pred == by[5].lang_pred == "en"
    assert {r.lang_pred for r in language.identify(fx.odd(spark), {}).collect()} == {"und"}
    assert language.identify(fx.nothing(spark), learned).count() == 0
    assert language.train(fx.nothing(spark)) == {}
    kept = language.keep_identified(fx.odd(spark), learned)
    assert kept.columns == fx.odd(spark).columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3})


def test_op8_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in catalog.QUERIES["op8_quality_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1]
    poor = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.2 * len(poor)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_op8_shrinks_sparse_sites(spark):
    docs = spark.createDataFrame(
        [(d, "plain words " * 30, "p", "good" if d < 40 else "poor" if d < 80 else "new", 1) for d in range(82)], fx.SCHEMA
    )
    labels = spark.createDataFrame([(d, int(d < 40)) for d in range(80)], "doc_id long, quality int")
    rates = {r.doc_id: r.host_rate for r in quality_classifier.classify(docs, labels).collect()}
    assert rates[0] > 0.85 and rates[79] < 0.15 and abs(rates[81] - 0.5) < 0.01


def test_op8_edges(spark):
    labels = spark.createDataFrame([(4, 1), (9, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    rows = quality_classifier.classify(fx.odd(spark), labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in fx.ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.classify(fx.odd(spark), labels.where(F.lit(False))).collect()
    assert {(r.score, r.kept) for r in none} == {(0.5, True)}
    assert quality_classifier.classify(fx.nothing(spark), labels).count() == 0
