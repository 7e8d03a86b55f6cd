"""Mutations of the contract fixture and the traps of text handling."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.operators import extract, state
from docsieve.plans import packs, review_plan
from docsieve.queries import CONTRACT_BLOCKS, contract
from docsieve.schemas import TRANSITIONS


def facts(spark, blocks):
    rows = extract.long_facts(review_plan.with_facts(contract(spark, tuple(blocks)), packs.CONTRACT), packs.CONTRACT, "doc_id")
    return {r["field"]: r for r in rows.collect()}


def hits(spark, blocks):
    done = review_plan.reviewed_contracts(contract(spark, tuple(blocks)))
    return {r["rule_code"]: r for r in review_plan.hit_rows(done, "doc_id").collect()}


def test_missing_number(spark):
    blocks = [b for b in CONTRACT_BLOCKS if "HT-2026" not in b]
    found = facts(spark, blocks)
    assert found["contract_number"]["extract_status"] == "not_found"
    status = review_plan.with_facts(contract(spark, tuple(blocks)), packs.CONTRACT).first()["parse_status"]
    assert status == "partial"


def test_second_number_is_ambiguous(spark):
    found = facts(spark, [*CONTRACT_BLOCKS[:2], "合同编号：HT-2026-0099", *CONTRACT_BLOCKS[2:]])["contract_number"]
    assert found["extract_status"] == "ambiguous" and found["value"] is None
    assert "HT-2026-0098" in found["source_text"] and "HT-2026-0099" in found["source_text"]
    assert (found["position"]["block_start"], found["position"]["block_end"]) == (1, 2)


def test_equal_numbers_are_found_once(spark):
    assert facts(spark, [*CONTRACT_BLOCKS[:2], CONTRACT_BLOCKS[1], *CONTRACT_BLOCKS[2:]])["contract_number"]["extract_status"] == "found"


def test_impossible_date_fails_with_its_source(spark):
    blocks = ["生效日期：2026年99月99日" if b.startswith("生效日期") else b for b in CONTRACT_BLOCKS]
    found = facts(spark, blocks)["effective_date"]
    assert found["extract_status"] == "failed" and found["value"] is None and "99" in found["source_text"]


def test_prepayment_threshold(spark):
    at = CONTRACT_BLOCKS.index("第一条 付款条款") + 1
    for share, hit in ((75, True), (50, False)):
        blocks = [*CONTRACT_BLOCKS[:at], f"预付款比例为{share}%。", *CONTRACT_BLOCKS[at + 1 :]]
        assert ("PREPAYMENT_RATIO_HIGH" in hits(spark, blocks)) == hit


def test_payment_period(spark):
    at = CONTRACT_BLOCKS.index("第一条 付款条款") + 1
    found = hits(spark, [*CONTRACT_BLOCKS[:at], "甲方应在90天内支付。", *CONTRACT_BLOCKS[at + 1 :]])["PAYMENT_PERIOD_LONG"]
    assert found["actual_value"] == "90天" and found["expected_value"] == "不高于 60天"


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "v string").select(use(F.col("v")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "　 a b \n", tx.strip) == "a b"
    assert one(spark, "2026-10-1", tx.iso_date) == "2026-10-01"
    assert one(spark, "2026-2-30", tx.iso_date) is None
    assert one(spark, "../../采购合同:最终?.pdf", lambda c: tx.safe_name(c, "file")) == "采购合同_最终_.pdf"
    assert one(spark, "...", lambda c: tx.safe_name(c, "file")) == "file"
    assert one(spark, "..PDF", tx.file_type) == "pdf"
    assert one(spark, "a.b/c", tx.schema_name) == "a_b_c"
    assert one(spark, "２０ and 3.5", lambda c: tx.numbers(c, r"(\d+(?:\.\d+)?)", 1)) == [20.0, 3.5]
    assert one(spark, None, tx.strip) is None


def test_supported(spark):
    rows = spark.createDataFrame([("HT 1", "No. ht-1."), ("", "x"), (None, "x"), ("z", None)], "v string, e string")
    assert [r["s"] for r in rows.select(tx.supported(F.col("v"), F.col("e")).alias("s")).collect()] == [True, False, False, False]


def test_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "p array<string>")
    assert len({r["f"] for r in rows.select(tx.set_fingerprint(F.col("p")).alias("f")).collect()}) == 1


def test_replay_in_chunks(spark, monkeypatch):
    """A key with a third of all events is cut into chunks, and what they make is put together in order."""
    rng = random.Random(4)
    targets = ["parsing", "reviewing", "blocked", "done", "nowhere", None]
    rows = [(rng.choice([1, 1, 2, 3, None, 5]), rng.randrange(800), i % 500, rng.choice(targets)) for i in range(4000)]
    monkeypatch.setattr(state, "CHUNK_BITS", 3)
    monkeypatch.setattr(state, "LEVELS", (2, 3))
    events = spark.createDataFrame(rows, "k long, ts long, id long, t string")
    cut = state.chunks(events, "k", ["ts", "id"], "t").filter("k = 1").select(F.size("_e").alias("n")).collect()
    assert max(r["n"] for r in cut) <= 8 and len(cut) > 100
    want = {}
    for k, _, _, to in sorted((r for r in rows if r[3]), key=lambda r: (r[1], r[2], r[3])):
        now, *n = want.get(k, ("pending", 0, 0, 0))
        ok = to in TRANSITIONS.get(now, [])
        want[k] = (to if ok else now, n[0] + ok, n[1] + (not ok), n[2] + (ok and now == "blocked"))
    assert {r["k"]: tuple(r)[1:] for r in state.replay(events, "k", ["ts", "id"], "t").collect()} == want
