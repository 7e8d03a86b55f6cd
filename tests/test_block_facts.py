"""Facts by the texts of blocks are the facts that the expressions give, on whatever blocks."""

from __future__ import annotations

import random

import pytest

from docsieve.operators import block_facts, extract
from docsieve.plans import packs, review_plan
from docsieve.queries import CONTRACT_BLOCKS, _contracts
from docsieve.schemas import BLOCKS

ODD = (
    "", " ", None, "　合同编号 ： HT-9　", "合同编号：", "编号:\x1cA1", "甲方： ", "乙方: x\ny", "合同总金额1,200.50元，金额 7", "金额美元 us$ 5", "费用：人民币或美元 30", "价款RMB3", "生效日期：2026-02-30", "有效期自：２０２６年1月1日", "生效日期：2026/2/3", "有效期至：0000-1-1",
    "到期日期：2027年9月30日", "短协议\n", "付款方式", "第二条 关于付款条款的说明", "第　条 验收标准", "违约责任与保密义务", "数据处理", "知识产权\U0001f600", "争议解决 人民法院", "K金额 ＵＳＤ", "İ￥费用", *CONTRACT_BLOCKS,
)


def documents(n: int, seed: int) -> list:
    rng, docs = random.Random(seed), [(0, None), (1, []), (2, [None, ("付款条款", None, None)])]
    for i in range(3, n):
        at = list(range(rng.randint(0, 14)))
        kind = rng.randrange(4)  # in order; in no order; with repeats; with nulls
        if kind == 1:
            rng.shuffle(at)
        elif kind > 1:
            at = [rng.choice([*at, None] if kind == 3 else at) for _ in at]
        page = lambda: rng.choice([1, 2, 3, None]) if i % 3 else 1  # noqa: B023, E731
        docs.append((i, [(rng.choice(ODD), page(), a) for a in at]))
    return docs


@pytest.mark.parametrize("pack", [packs.CONTRACT, packs.CONTRACT.only({"clauses.payment_clause", "basic_info.amount"}), packs.CONTRACT.only({"basic_info.currency"}), packs.CORPUS], ids=["contract", "two", "one", "corpus"])
def test_equal_to_expressions(spark, pack):
    docs = spark.createDataFrame(documents(1500, 5), f"doc_id bigint, blocks {BLOCKS}")
    want = {r["doc_id"]: r["facts"] for r in extract.facts(docs, pack).collect()}
    got = {r["doc_id"]: r["facts"] for r in block_facts.facts(docs, pack).collect()}
    assert [d for d in want if want[d] != got[d]] == [] and len(got) == 1500


def test_contracts_are_read_by_block(spark):
    """Each block is met with each field and keyword by interpreted expressions otherwise, a millisecond a contract."""
    from paths import DATA

    for found in (review_plan.with_facts(_contracts(spark, f"{DATA}/sf0.001"), packs.CONTRACT, by_block=True), review_plan.reviewed_contracts(_contracts(spark, f"{DATA}/sf0.001"), every_fact=False)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "rlike" not in plan.lower()


def test_patterns_that_differ_are_refused():
    with pytest.raises(ValueError, match="not read the same"):
        block_facts.pattern(r"\w+")
    assert block_facts.pattern(r"[^\s]{1,2}\s").search("a\x1c ").group() == "a\x1c "


def test_clauses_of_rules_alone_are_read(spark):
    """No rule of a model asks for amounts and dates."""
    from paths import DATA

    from docsieve.queries import QUERIES

    plan = QUERIES["semantic_evaluation"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "contract_number" not in plan and "payment_clause" not in plan
