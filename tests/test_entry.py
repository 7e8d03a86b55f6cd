"""The driver contract, and that nothing else needs the corpus operators."""

from __future__ import annotations

import re

from paths import ROOT


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "overall_risk_level", "summary_text", "comment_text"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_does_not_import_the_corpus_operators():
    for path in (ROOT / "docsieve").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from docsieve\.llm", path.read_text()), path
