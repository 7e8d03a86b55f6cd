"""Rules as rows of a table against plain loops and against the compiled rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators import rule_tables
from docsieve.plans import packs, review_plan
from docsieve.schemas import RULES

FACT = "doc_id long, path string, text string, position int"


def test_ten_thousand_keywords(spark):
    """First in the order of the rule's fields, then of its keywords."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg é") for _ in range(rng.randint(2, 9)))
    words = [word() for _ in range(10_000)]
    rules = [(n, rng.choice([["t", "b"], ["b", "t"], ["b"], ["nowhere"], []]), words[n * 20 : n * 20 + 20] + rng.sample(words, 3) + [""]) for n in range(500)]
    facts = [(d, p, " ".join(rng.sample(words, rng.randint(0, 12))), d) for d in range(60) for p in ("t", "b", "other")] + [(70, "t", None, 1), (71, "b", "", 1)]
    want = []
    for d in range(60):
        own = {p: x for k, p, x, _ in facts if k == d}
        for n, fields, keywords in rules:
            first = next(((p, k) for p in fields for k in keywords if k and k in own.get(p, "")), None)
            if first:
                want.append((d, n, *first, own[first[0]], d))
    got = rule_tables.keyword_matches(spark.createDataFrame(facts, FACT), spark.createDataFrame(rules, "rule_id long, fields array<string>, keywords array<string>"), "doc_id")
    assert sorted(map(tuple, got.select("doc_id", "rule_id", "path", "keyword", "text", "position").collect())) == sorted(want) and len(want) > 500


def rows(*rules):
    return [(r.rule_id, r.rule_code, r.rule_name, r.risk_level, r.rule_status, r.match_mode, json.dumps(r.config), r.suggestion, r.rule_version) for r in rules]


def test_many_copies_of_all_modes(spark, monkeypatch):
    """More rules than are broadcast give each document the hits of the compiled rules, once for each copy."""
    monkeypatch.setattr(rule_tables, "BROADCAST_ROWS", 10)
    texts = [(1, "The thing\nLicensed under the Some License version 3.5\nmail a@b.cd"), (2, "Of erthe\nThe stupid"), (3, None), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    from docsieve.operators import extract

    facts = extract.long_facts(review_plan.with_facts(docs), packs.CORPUS, "doc_id")
    copies = [(r[0] + 100 * i, *r[1:]) for i in range(30) for r in rows(*packs.CORPUS_RULES)]
    got = rule_tables.table_hits(facts, spark.createDataFrame(copies, RULES), "doc_id", packs.CORPUS_METRICS, packs.CORPUS_WORDING)
    names = ["doc_id", "rule_code", "risk_level", "evidence_type", "evidence_text", "actual_value", "expected_value", "hit_message", "suggestion"]
    want = review_plan.hit_rows(review_plan.with_hits(docs), "doc_id").select(names).collect()
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want * 30)) and len(want) > 5


@pytest.mark.parametrize("mode,config", [("keyword", "{}"), ("keyword", "no json"), ("no_mode", '{"hit_message": "x"}'), ("numeric_threshold", '{"field": "a", "metric": "m", "operator": "lt", "threshold": 1, "hit_message": "x"}')])
def test_bad_rules_are_errors(spark, mode, config):
    rule = [(1, "BAD", "bad", "low", "active", mode, config, "s", "1.0")]
    with pytest.raises(Exception, match="BAD|MALFORMED|JSON"):
        rule_tables.parsed(spark.createDataFrame(rule, RULES)).select(F.col("c")).collect()
    off = [(*rule[0][:4], "inactive", *rule[0][5:])]
    assert rule_tables.parsed(spark.createDataFrame(off, RULES)).count() == 0
