"""Tables that lie in buckets of their key, so that joins and groupings by it need no exchange."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def write(rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Save ``rows`` as table ``name`` in the warehouse, dealt into buckets by ``key`` and sorted in them, and read it.

    Tables that are to be joined need the same number of buckets. Rows are brought to their buckets before they are
    written, so that a bucket is one file.
    """
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


@contextmanager
def by_part_of_the_key(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned within may use buckets of some of their keys: the parse alone, say, for one on the parse and
    its fingerprints. By default Spark wants buckets of all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def exchanges(df: DataFrame) -> int:
    """Exchanges of rows in the plan of ``df``, broadcasts left out."""
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|round|single)", df._jdf.queryExecution().executedPlan().toString()))


def drop(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
