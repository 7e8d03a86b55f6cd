"""What must not grow with the tables: rows of one task, broadcasts, timers."""

from __future__ import annotations

import pandas as pd
import pytest
from paths import DATA

from docsieve import queries
from docsieve.operators import results, state
from docsieve.sources import shared, tables
from docsieve.streaming import ordered

SMALL = f"{DATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contracts_are_dealt_out(spark):
    """A table of short rows in one split is work for all cores."""
    assert queries._contracts(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_only_rules_are_broadcast(spark):
    """Contracts are small in their files and large in memory."""
    found = plan(queries.QUERIES["semantic_evaluation"](spark, SMALL))
    assert found.count("BroadcastExchange") == 1


def test_one_timer_for_a_key(spark):
    class Held:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = put = lambda self, x: setattr(self, "held", x)
        clear = lambda self: setattr(self, "held", None)
        appendList = lambda self, x: setattr(self, "held", [*(self.held or []), *x])  # noqa: E731, N815

    class Handle:
        timers = []
        getValueState = getListState = lambda self, *a, **k: Held()  # noqa: E731, N815
        registerTimer = lambda self, at: self.timers.append(at)  # noqa: E731, N815

    class Timers:
        getCurrentWatermarkInMs = lambda self: 50  # noqa: E731, N815

    replay = ordered.OrderedReplay("k", "pending", state.transition_moves(), None)
    replay.init(handle := Handle())
    rows = pd.DataFrame([(1000 * i, i, "parsing") for i in range(100)], columns=["event_micros", "event_place", "event_name"])
    list(replay.handleInputRows(("a",), iter([rows]), None))
    assert handle.timers == [1]
    list(replay.handleExpiredTimer(("a",), Timers(), None))
    assert handle.timers == [1, 51] and len(replay.waiting.held) == 50


@pytest.mark.parametrize("name", ["current_hits", "semantic_incomplete", "review_result", "failed_results", "results_with_hits"])
def test_rows_are_not_dealt_out_by_rule(spark, name):
    """There are few rules: by them all rows would meet in few tasks."""
    assert "hashpartitioning(rule_id" not in plan(queries.QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["llm_merge", "llm_merge_documents"])
def test_documents_are_exchanged_once(spark, name):
    """Facts, answers and blocks of a document meet by its key alone, in parts that grow in number with the table."""
    found = plan(queries.QUERIES[name](spark, SMALL))
    exchanges = [x for x in found.splitlines() if "Exchange" in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x or "Reused" in x for x in exchanges) and "Broadcast" not in found


def test_texts_do_not_meet_by_keyword(spark):
    assert "hashpartitioning(path" not in plan(queries.QUERIES["keyword_rule_table"](spark, SMALL))


@pytest.mark.parametrize("name", ["current_hits", "semantic_incomplete", "review_result", "task_results", "results_with_hits", "current_result_choice"])
def test_parts_of_reviews_do_not_grow(spark, name, monkeypatch):
    """Rows that are sorted on the way are dealt out before, in parts that grow in number with the tables."""
    monkeypatch.setattr(tables, "parts", lambda *rows, part_bytes=0: 97)
    monkeypatch.setattr(results, "parts", lambda *rows, part_bytes=0: 97)
    found = plan(queries.QUERIES[name](spark, SMALL))
    dealt = [x for x in found.splitlines() if "REPARTITION_BY_NUM" in x]
    assert dealt and all(", 97)" in x for x in dealt)


def test_parts_grow_with_the_files(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("id", "uuid() as text").repartition(1)
    rows.write.parquet(str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a"))
    assert tables.parts(rows, rows, part_bytes=100_000) > 1.9 * tables.parts(rows, part_bytes=100_000) > 8
    assert tables.parts(rows.groupBy("id").count(), rows) >= tables.parts(rows)


def test_lines_are_grouped_in_one_stage(spark):
    """The least of texts is found by sorting: no split of the table is sorted before the exchange."""
    found = plan(queries._lines(spark, SMALL))
    assert found.count("Exchange") == 1 and "REPARTITION_BY_NUM" in found
    assert found.index("SortAggregate") < found.index("Exchange") and "SortAggregate" not in found[found.index("Exchange"):]


def test_files_of_reviews_have_few_rows(spark):
    """Rows that compress well are bounded in number for each file, so that a scan's task has few of them."""
    kept = shared.saved(spark.range(1000).repartition(1), 100)
    assert len(kept.inputFiles()) == 10 and kept.count() == 1000


@pytest.mark.parametrize("name", ["current_hits", "semantic_incomplete", "review_result", "task_results", "result_hit_links", "results_with_hits", "failed_results"])
def test_no_exchange_of_reviews_has_fixed_parts(spark, name, monkeypatch):
    """Where joins are too large for a broadcast, each exchange by keys has parts that grow in number with the tables: none
    has ``spark.sql.shuffle.partitions`` of them at any size."""
    monkeypatch.setattr(tables, "parts", lambda *rows, part_bytes=0: 97)
    monkeypatch.setattr(results, "parts", lambda *rows, part_bytes=0: 97)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(queries.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [x for x in found.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and [x.strip()[:150] for x in exchanges if ", 97)" not in x] == []
