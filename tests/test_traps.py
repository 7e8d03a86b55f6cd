"""Cases in which a plain reading of the semantics goes wrong."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.operators import extract, history, rules, semantic, state
from docsieve.plans import packs, review_plan
from docsieve.queries import CONTRACT_BLOCKS, contract


def fact(spark, field, *blocks, section="basic_info"):
    return review_plan.with_facts(contract(spark, blocks), packs.CONTRACT).select(f"facts.{section}.{field}.*").first()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ambiguity_is_decided_before_values_are_changed(spark):
    assert fact(spark, "amount", "合同总金额为500,000元", "金额 500000 元")["extract_status"] == "ambiguous"
    assert fact(spark, "effective_date", "生效日期：2026年10月1日", "生效日期：2026-10-01")["extract_status"] == "ambiguous"
    assert fact(spark, "amount", "合同总金额为500,000元")["value"] == "500000"


def test_an_empty_label_takes_the_next_line_of_its_block(spark):
    assert fact(spark, "signing_party", "甲方：\n星河公司")["value"] == "星河公司"


def test_classes_of_unicode_and_the_dot(spark):
    assert fact(spark, "signing_party", "甲方：　星河 公司　")["value"] == "星河 公司"
    assert fact(spark, "contract_number", "合同编号　：　HT-1")["value"] == "HT-1"


def test_digits_of_full_width(spark):
    assert one(spark, tx.iso_date(F.lit("２０２６年１０月１日"))) == "2026-10-01"
    assert one(spark, tx.iso_date(F.lit("2026/2/30"))) is None and one(spark, tx.iso_date(F.lit("2026-10"))) is None
    assert fact(spark, "effective_date", "生效日期：２０２６年１０月１日")["value"] == "2026-10-01"
    assert one(spark, tx.numbers(F.lit("预付款７０%"), packs.CONTRACT_METRICS["prepayment_ratio"])) == [70.0]


def test_numbers_are_written_without_exponents(spark):
    shown = [one(spark, tx.show_number(F.lit(x))) for x in (50.0, 33.5, 12345678.0, 123456789.25, 1e16, 0.1)]
    assert shown == ["50", "33.5", "12345678", "123456789.25", "10000000000000000", "0.1"]


def test_numerals_in_words_are_no_numbers(spark):
    assert one(spark, tx.numbers(F.lit("甲方应在十个工作日内支付"), packs.CONTRACT_METRICS["payment_period_days"])) == []


def test_last_page_by_place_or_by_value(spark):
    blocks = [("第一条 付款条款", 3, 0), ("甲方付款。", 1, 1), ("第二条 交付条款", 2, 2), ("第三条 付款方式", 2, 3), ("乙方收款。", None, 4)]
    df = spark.createDataFrame([(1, blocks)], "doc_id bigint, blocks array<struct<text: string, page_number: int, block_index: int>>")
    facts = extract.facts(df, packs.CONTRACT).select("facts.clauses.*").first()
    both, single = facts["payment_clause"], facts["delivery_clause"]
    assert both["extract_status"] == "ambiguous" and (both["position"]["page_start"], both["position"]["page_end"]) == (2, 2)
    assert (single["position"]["page_start"], single["position"]["page_end"]) == (2, 2)
    alone = spark.createDataFrame([(1, blocks[:2])], df.schema)
    position = extract.facts(alone, packs.CONTRACT).select("facts.clauses.payment_clause.position.*").first()
    assert (position["page_start"], position["page_end"]) == (3, 1)


def test_bad_rules_stop_the_run(spark):
    rule = packs.CONTRACT_RULES[5]
    bad = rules.Rule(**{**rule.__dict__, "config": {**rule.config, "operator": "lt"}})
    run = lambda blocks: review_plan.with_hits(contract(spark, blocks), packs.CONTRACT, (bad,), packs.CONTRACT_METRICS, packs.CONTRACT_WORDING).select(F.size("hits")).first()[0]
    assert run(CONTRACT_BLOCKS) == 0  # no number to compare
    with pytest.raises(Exception, match="gt only"):
        run(("第一条 付款条款", "预付款比例为30%。"))
    with pytest.raises(ValueError):
        review_plan.with_hits(contract(spark), packs.CONTRACT, (rules.Rule(1, "X", "x", "low", "presence", {"fields": ["basic_info.nothing"], "keywords": ["x"], "hit_message": ""}, ""),), {}, packs.CONTRACT_WORDING)
    table = lambda text: spark.createDataFrame([(1, "R", "r", "low", "active", "keyword", text, "s", "1.0")], "rule_id bigint, rule_code string, rule_name string, risk_level string, rule_status string, match_mode string, match_text string, suggestion_text string, rule_version string")
    for text in (json.dumps({"fields": [], "hit_message": ""}), "[]"):
        with pytest.raises(ValueError, match="has no"):
            rules.read_rules(table(text))
    assert rules.read_rules(table(json.dumps({"fields": ["a"], "keywords": ["b"], "hit_message": "c"})))[0].rule_code == "R"


def test_seeding_twice(spark):
    defaults = spark.createDataFrame([(r.rule_code,) for r in packs.CONTRACT_RULES], "rule_code string")
    none = defaults.limit(0)
    first = history.seed_missing(none, defaults, "rule_code")
    assert (first.count(), history.seed_missing(none.unionByName(first), defaults, "rule_code").count()) == (13, 0)


def test_upsert_refuses_conflicts_and_writes_nulls(spark):
    schema = "instance_id string, approval_code string, title string, task_status string, at int"
    state_ = spark.createDataFrame([("i1", "c1", "old", "reviewing")], schema.rsplit(",", 1)[0])
    put = lambda *rows: history.upsert(state_, spark.createDataFrame([(*r[:3], None, n) for n, r in enumerate(rows)], schema), "instance_id", "approval_code", ["title"], "at", {"task_status": F.lit("pending")})
    for clash in ([("i1", "c2", "x")], [("i2", "c1", "x")], [("i3", "c3", "x"), ("i3", "c4", "x")], [("i5", "c5", "x"), ("i6", "c5", "x")]):
        with pytest.raises(history.IdentityConflict):
            put(("i9", "c9", "fine"), *clash)
    rows = {r["instance_id"]: (r["title"], r["task_status"]) for r in put(("i1", "c1", "new"), ("i2", "c2", "t"), ("i1", "c1", None)).collect()}
    assert rows == {"i1": (None, "reviewing"), "i2": ("t", "pending")}


def test_limit_comes_before_the_merge(spark):
    items = spark.createDataFrame([(i, f"i{min(i, 3)}") for i in range(1, 9)], "position int, instance_id string")
    first = history.pending(items, "position", 4)
    events = history.upsert_events(first.limit(0).select("instance_id"), first, "instance_id", "position").groupBy("event").count().collect()
    assert {r["event"]: r["count"] for r in events} == {"created": 3, "updated": 1}
    assert history.pending(items, "position", 0).count() == 0


def test_read_reuse_takes_any_method_and_ocr_its_own(spark):
    rows = [(1, 7, "sha", "1", "pdf_text", "success"), (2, 7, "sha", "1", "ocr", "success"), (3, 7, "sha", "1", "pdf_text", "success"), (4, 7, "sha", "1", "ocr", "failed"), (5, 7, "sha", "2", "ocr", "success")]
    reads = spark.createDataFrame(rows, "document_read_snapshot_id long, attachment_id long, file_sha256 string, reader_version string, read_method string, read_status string")
    assert history.reusable_reads(reads, "1").first()["document_read_snapshot_id"] == 3
    assert history.reusable_reads(reads, "1", "ocr").first()["document_read_snapshot_id"] == 2


def test_fingerprint_without_a_provider(spark):
    import hashlib

    digest = one(spark, semantic.evaluation_fingerprint(F.lit("1.0"), "1.0", None, None))
    assert digest == hashlib.sha256(b"1.0|1.0|not_configured|not_configured").hexdigest()
    assert one(spark, semantic.hybrid_version("2.0", F.lit("abcdef0123456789"))) == "2.0-abcdef012345"


def test_places_that_are_not_there(spark):
    blocks = contract(spark, ("one", "two"))
    found = lambda a, b: blocks.select(semantic.evidence(F.col("blocks"), F.lit(a), F.lit(b)).alias("e")).first()["e"]
    assert found(0, 5) is None and found(1, 0) is None and found(None, 1) is None and found(0, 1)["text"] == "one\ntwo"


def test_failed_facts_and_page_blocks(spark):
    from docsieve.operators.segment import page_blocks

    failed = spark.range(1).select(extract.failed_facts(packs.CONTRACT).alias("facts")).select("facts.basic_info.amount.*").first()
    assert failed["extract_status"] == "failed" and failed["value"] is None
    pages = F.array(F.array(F.lit("a"), F.lit(" ")), F.array(F.lit("b")))
    assert [tuple(b) for b in one(spark, page_blocks(pages))] == [("a", 1, 0), ("b", 2, 1)]
    assert [tuple(b) for b in one(spark, page_blocks(pages, True))] == [("a", 1, 0), ("b", 2, 2)]


def test_write_back_is_resumed_by_its_own_event():
    start, moves = state.workflow_moves()
    now = start
    for event, want in (("start_parsing", "parsing/not_written/"), ("start_reviewing", "reviewing/not_written/"), ("start_write", "reviewing/writing/"), ("fail_write", "blocked/failed/comment_writeback")):
        now = moves[now, event][0]
        assert now == want
    assert (now, "retry") not in moves and (now, "resume_for_ocr") not in moves
    assert moves[now, "resume_writeback"] == ("reviewing/failed/", True)
    assert moves["parsing/not_written/", "resume_for_ocr"] == ("parsing/not_written/", False)
    assert all(s.split("/")[0] != "done" for s, _ in moves)
