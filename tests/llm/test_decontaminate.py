"""Benchmark windows against a plain scan, by broadcast and by join."""

from __future__ import annotations

import hashlib

import brute
import pytest

from docsieve.llm import decontaminate


@pytest.fixture(scope="module")
def items(spark, tricky_rows):
    words = tricky_rows[45][1].split()
    texts = [" ".join(words[:30]), " ".join(words[10:25]).upper(), "one", "漢字テスト", "", None, "no such passage stands anywhere in these texts at all today", "a b c"]
    return spark.createDataFrame([*enumerate(texts), (2, "one"), (None, "b")], "item_id long, text string")


def expected(tricky_rows, items):
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    out = []
    for r in tricky_rows:
        n, hit, found = brute.benchmark_hits(r[1], rows)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((r[0], n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)[:6]) for r in df.collect())


def test_scan(tricky, tricky_rows, items):
    want = expected(tricky_rows, items)
    assert found(decontaminate.scan(tricky, items)) == want
    assert sum("True" in w for w in want) >= 4


def test_many_parts(tricky, tricky_rows, items, monkeypatch):
    """A benchmark above the broadcast bound is scanned in parts; results are the same."""
    cut, kept = (sorted(map(str, f(tricky, items).collect())) for f in (decontaminate.remove_spans, decontaminate.remove_documents))
    monkeypatch.setattr(decontaminate, "PART_BYTES", 3000)
    assert decontaminate._parts(items) >= 3
    assert found(decontaminate.scan(tricky, items)) == expected(tricky_rows, items)
    assert sorted(map(str, decontaminate.remove_spans(tricky, items).collect())) == cut
    assert sorted(map(str, decontaminate.remove_documents(tricky, items).collect())) == kept


def test_removal(tricky, tricky_rows, items):
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    want = [r for r in tricky_rows if not brute.benchmark_hits(r[1], rows)[1]]
    kept = decontaminate.remove_documents(tricky, items)
    assert kept.columns == tricky.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(map(str, want)) and len(want) < len(tricky_rows)
    cut = decontaminate.remove_spans(tricky, items)
    assert cut.columns == tricky.columns and cut.count() == tricky.count()
    assert "".join(decontaminate.without(b"a, B c. d", decontaminate.np.array([False, True, True, False])).decode().split()) == "a,.d"


def test_rows_go_by_their_own_text(spark, items):
    """A contaminated row without an id goes; a clean row that repeats a contaminated row's id stays."""
    bad = next(r["text"] for r in items.collect() if r["item_id"] == 0)
    docs = spark.createDataFrame([(None, "say " + bad), (7, bad), (7, "a clean text"), (None, None), (8, "")], "doc_id long, text string")
    kept = sorted(str(tuple(r)) for r in decontaminate.remove_documents(docs, items).collect())
    assert kept == sorted(["(7, 'a clean text')", "(None, None)", "(8, '')"])
    assert sorted(str(r["text"]) for r in decontaminate.remove_spans(docs, items).collect()) == sorted(["say ", "", "a clean text", "None", ""])


def test_empty(empty, tricky, items):
    assert decontaminate.scan(empty, items).count() == 0
    assert decontaminate.scan(tricky, items.limit(0)).filter("contaminated").count() == 0
