"""Tables that micro-batches are added to once, whatever is killed and repeated."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and a maker of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, and no more partitions of it than there are cores, for streams that are started within."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def commit(batch: DataFrame, batch_id: int, table: str) -> bool:
    """Add a batch to a table once. Its files are written aside and become visible by one rename of their folder, whose
    name is the ledger's entry: a batch that is there already is not written again (False), one that was killed half
    way leaves only files aside, which no reader sees. Rows keep the batch they came with as ``batch_id``."""
    spark = batch.sparkSession
    fs, at = _files(spark, table)
    target = at(f"{table}/batch_id={batch_id}")
    if fs.exists(target):
        return False
    aside = f"{table}/_aside/{uuid.uuid4().hex}"
    batch.drop("batch_id").write.option("compression", "zstd").parquet(aside)
    fs.mkdirs(at(table))
    won = not fs.exists(target) and fs.rename(at(aside), target)
    if not won:
        fs.delete(at(aside), True)
    return won


def committed(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches that are in the table."""
    fs, at = _files(spark, table)
    if not fs.exists(at(table)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(table))]
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def write_stream(rows: DataFrame, table: str, checkpoint: str, mode: str = "update", wait: bool = True) -> StreamingQuery:
    """Run a stream over what its source has, each micro-batch added to the table once."""
    sink = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = sink.foreachBatch(lambda batch, n: commit(batch, n, table) and None).start()
    if wait:
        query.awaitTermination()
    return query


def last_told(table: DataFrame, *keys: str) -> DataFrame:
    """The row of each key from the latest batch that has one."""
    rest = [c for c in table.columns if c not in (*keys, "batch_id")]
    best = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def attachment_records(attempts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The record of each attachment after its download attempts (sha256, file_name, error; an attempt with an error
    failed): (keys, file_name, sha256, download_status, download_error, attempts).

    A failed attempt leaves the digest of the content that is there; the name is that of the last attempt.
    """
    ok = F.col("error").isNull()
    return attempts.groupBy(*keys).agg(
        F.max_by("file_name", order).alias("file_name"), F.max_by("sha256", F.when(ok, F.col(order))).alias("sha256"),
        F.when(F.max_by("error", order).isNull(), "success").otherwise("failed").alias("download_status"), F.max_by("error", order).alias("download_error"),
        F.count("*").alias("attempts"),
    )


def comment_logs(attempts: DataFrame, marks: DataFrame, order: str) -> DataFrame:
    """Attempts (log_id, ...) with the state that their marks leave them in: (log_id, write_status, external_comment_id,
    error_code, response_text), besides marks of attempts that do not exist, whose status is ``unknown_log``.

    ``marks``: log_id, ``order``, external_comment_id, error_code, response_text; a mark with an error code is a failure. The
    last mark counts; a success clears an earlier error, a failure keeps the comment's id of an earlier success.
    Attempts without a mark are ``writing``.
    """
    good = F.when(F.col("error_code").isNull(), F.col(order))
    last = marks.groupBy("log_id").agg(F.max_by(F.struct("error_code", "response_text"), order).alias("_l"), F.max_by("external_comment_id", good).alias("external_comment_id"))
    met = attempts.select("log_id", F.lit(True).alias("_there")).join(last, "log_id", "full")
    status = F.when(F.col("_there").isNull(), "unknown_log").when(F.col("_l").isNull(), "writing").when(F.col("_l.error_code").isNull(), "success").otherwise("failed")
    return met.select("log_id", status.alias("write_status"), "external_comment_id", F.col("_l.error_code").alias("error_code"), F.col("_l.response_text").alias("response_text"))
