"""Choices over bucketed tables need no exchange."""

from __future__ import annotations

import pytest
from paths import DATA
from pyspark.sql import functions as F

from docsieve.operators import history
from docsieve.sources import bucketed


@pytest.fixture
def plain_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_current_result_by_bucket(spark, plain_joins):
    """The result whose fingerprints are current, by parse: the same rows, without an exchange."""
    orders = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet")
    current = orders.select(F.col("o_orderkey").alias("contract_parse_id"), F.lit("set").alias("rule_set_fingerprint"), F.col("o_orderpriority").alias("rule_hit_fingerprint"))
    lines = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").select(F.col("l_orderkey").alias("contract_parse_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_result_id"), F.when(F.col("l_linenumber") % 3 == 0, "failed").otherwise("completed").alias("review_status"), "l_returnflag")
    results = lines.join(current, "contract_parse_id").withColumn("rule_hit_fingerprint", F.when(F.col("l_returnflag") == "R", "old").otherwise(F.col("rule_hit_fingerprint"))).drop("l_returnflag")
    want = history.select_result(results, current)
    assert bucketed.exchanges(want) > 0
    try:
        a, b = bucketed.write(results, "bucketed_results", "contract_parse_id", 4), bucketed.write(current, "bucketed_current", "contract_parse_id", 4)
        with bucketed.by_part_of_the_key(spark):
            got = history.select_result(a, b)
            assert bucketed.exchanges(got) == 0
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        latest = history.latest(a, ["contract_parse_id"], "review_result_id")
        assert bucketed.exchanges(latest) == 0 and latest.count() == results.select("contract_parse_id").distinct().count()
    finally:
        bucketed.drop(spark, "bucketed_results", "bucketed_current")
