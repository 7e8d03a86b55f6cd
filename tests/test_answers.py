"""Answers checked as expressions against plain checks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docsieve.functions import answers

GOOD = {"decision": "hit", "reason": "because", "block_start": 3, "block_end": 4}


def envelope(content):
    return json.dumps({"choices": [{"message": {"content": content}}], "usage": {"total_tokens": 3}})


def told(spark, raws, shape=answers.DECISION, f=answers.checked):
    """What is made of each raw answer, in one job."""
    rows = spark.createDataFrame(list(enumerate(raws)), "n int, raw string").coalesce(1).select("n", answers.content(F.col("raw")).alias("v"))
    found = rows.select("n", f(F.col("v"), shape).alias("c")).select("n", "c.*").collect()
    return [{k: v for k, v in r.asDict(recursive=True).items() if k != "n"} for r in sorted(found, key=lambda r: r["n"])]


CHANGES = [
    ({}, None), ({"block_start": "3"}, None), ({"block_start": 3.0}, None), ({"block_start": True}, None), ({"decision": "not_hit", "block_start": None, "block_end": None}, None), ({"reason": "原因 ñ"}, None),
    ({"more": 1, "also": 2}, "EXTRA:also,more"), ({"decision": "maybe"}, "CHOICE:decision"), ({"decision": 1}, "TYPE:decision"), ({"decision": None}, "TYPE:decision"), ({"reason": ""}, "EMPTY:reason"), ({"reason": None}, "TYPE:reason"),
    ({"reason": ["x"]}, "TYPE:reason"), ({"block_start": "x"}, "TYPE:block_start"), ({"block_end": 1.5}, "TYPE:block_end"), ({"block_end": None}, "NEEDS:block_end"), ({"block_end": {}}, "TYPE:block_end"),
]


def test_objects(spark):
    asked = [GOOD | change for change, _ in CHANGES]
    as_text, as_object = told(spark, [envelope(json.dumps(x)) for x in asked]), told(spark, [envelope(x) for x in asked])
    assert as_text == as_object
    for x, (_, error), got in zip(asked, CHANGES, as_text, strict=True):
        assert got["error"] == error and (got["decision"] is None) == (error is not None), x
        if error is None and x["block_start"] is not None:
            assert got["block_start"] == int(x["block_start"])


def test_no_objects(spark):
    cases = [(None, "NOT_JSON"), ("", "NOT_JSON"), ("{", "NOT_JSON"), ("{}", "NOT_JSON"), (envelope("no json"), "NOT_JSON"), (envelope("[1]"), "NOT_AN_OBJECT"), (envelope("3"), "NOT_AN_OBJECT"), (envelope("{}"), "MISSING:decision"), (envelope('{"decision": "hit"}'), "MISSING:reason")]
    assert [x["error"] for x in told(spark, [raw for raw, _ in cases])] == [error for _, error in cases]


def test_lists_of_items(spark):
    item = {"field_name": "a", "value": "x", "extract_status": "found", "block_start": 1, "block_end": 2}
    asked = [{"items": [item, item | {"extract_status": "not_found", "value": None, "block_start": None}]}, {"items": []}, {"items": [item, item | {"value": ""}]}, {"items": [{"field_name": "a"}]}, {}, {"items": 3}, {"items": [], "x": 1}, [1]]
    good, empty, *bad = told(spark, [envelope(json.dumps(x)) for x in asked], answers.CANDIDATE, answers.checked_items)
    assert good["error"] is None and [i["value"] for i in good["items"]] == ["x", None] and empty == {"error": None, "items": []}
    assert [x["error"] for x in bad] == ["ITEM:1:NEEDS:value", "ITEM:0:MISSING:value", "MISSING:items", "TYPE:items", "EXTRA:x", "NOT_AN_OBJECT"]


def test_write_responses(spark):
    good = {"success": True, "external_comment_id": "c", "message": "ok"}
    cases = [(good, True), (good | {"more": 1}, True), (good | {"success": 1}, False), (good | {"success": "true"}, False), (good | {"message": " "}, False), (good | {"external_comment_id": 3}, False), ({"success": True}, False), ([good], False)]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(99, None), (100, "no json")], "n int, raw string").coalesce(1)
    got = dict(rows.select("n", answers.valid_response(F.col("raw"))).collect())
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases] and got[99] is got[100] is False


def test_outcomes_and_dumps(spark):
    rows = spark.createDataFrame([(True, 200, None), (False, 500, None), (False, None, "x"), (False, 200, "TYPE:a"), (False, 200, None)], "t boolean, s int, e string")
    got = [r[0] for r in rows.select(answers.outcome(F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert got == ["LlmProviderTimeoutError", "LlmProviderError", "LlmProviderError", "LlmResponseValidationError", None]
    assert spark.range(1).select(answers.compact_json(F.lit("合同").alias("a"), F.lit(None).cast("int").alias("b"), F.array(F.lit(1)).alias("c"))).first()[0] == '{"a":"合同","b":null,"c":[1]}'
