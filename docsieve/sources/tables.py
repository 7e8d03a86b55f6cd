"""Tables as Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of files above this size is never dealt out, whatever the number of cores.
SPREAD_BYTES = 1 << 30


def _scanned_bytes(rows: DataFrame) -> int | None:
    """Bytes of the files behind ``rows`` as the planner knows them; None if anything else is behind them."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    if not leaves or any(x.getClass().getSimpleName() != "LogicalRelation" for x in leaves):
        return None
    return sum(int(str(x.stats().sizeInBytes())) for x in leaves)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores where the scan of their files would leave cores idle.

    A scan makes no splits below ``spark.sql.files.openCostInBytes``, so a small table has fewer splits than there are
    cores, and a file can be one row group, which one task must read. Tables that give every core a split, tables above
    ``SPREAD_BYTES`` and rows that come from anything but files are left as they are. No file is listed here.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    size = _scanned_bytes(rows)
    return rows.repartition(cores) if size is not None and size < min(cores * least, SPREAD_BYTES) else rows


#: Bytes of files whose rows one task takes at most where rows are dealt out by key.
DEALT_BYTES = 1 << 20


def parts(*tables: DataFrame, part_bytes: int = DEALT_BYTES) -> int:
    """How many parts the rows of ``tables`` are dealt out to: one for each ``part_bytes`` of their files (if anything but
    files is behind them, ``spark.sql.shuffle.partitions``), and one for each core at least."""
    spark = tables[0].sparkSession
    sizes = [_scanned_bytes(x) for x in tables]
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) if None in sizes else sum(sizes) // part_bytes + 1
    return max(wanted, spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, *keys: str, part_bytes: int = DEALT_BYTES) -> DataFrame:
    """``rows`` of a table dealt out by ``keys``, for rows that are short in their files and long in work.

    However few splits the files have, every core gets a part, and the parts grow in number with the files, not in
    size. Joins by the keys alone need no further exchange.
    """
    return rows.repartition(parts(rows, part_bytes=part_bytes), *keys)
