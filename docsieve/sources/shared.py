"""Written intermediates in the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder of each local application for which none is set.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it. Only a local master may do without."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="docsieve-")
    return _OWN[sc.applicationId]


def saved(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    ``file_rows``: rows of one file at most, if not 0. A task reads so many bytes of files, which of rows that compress
    well are millions; as each file counts ``spark.sql.files.openCostInBytes``, small files bound its rows too."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsieve-{uuid.uuid4().hex}.parquet"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of ``saved`` tables that no later step reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
