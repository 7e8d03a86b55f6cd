"""The paged source: limits, lookups and streams."""

from __future__ import annotations

import json

import pytest

from docsieve.sources import paged

SCHEMA = "instance_id long, title string"


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.createDataFrame([(i // 2, f"title {i}") for i in range(100)], SCHEMA)
    paged.export(rows, "instance_id", str(tmp_path / "pages"), 7)
    return str(tmp_path / "pages")


def test_limits(spark, folder):
    read = lambda n: [tuple(r) for r in paged.pending(spark, SCHEMA, n, path=folder, key="instance_id").collect()]
    whole = read(None)
    assert len(whole) == 100 and [r[0] for r in whole] == sorted(r[0] for r in whole)
    for n in (0, -1, 1, 14, 15, 33, 99, 100, 1000):
        assert read(n) == whole[: max(n, 0)]


def test_pages_behind_the_limit_are_not_asked_for(folder):
    from pyspark.sql.types import StructType

    options = {"path": folder, "key": "instance_id", "limit": "20"}
    parts = paged.PagedReader(StructType.fromDDL(SCHEMA), options).partitions()
    sizes = paged.FolderGateway(options).sizes()
    assert sum(sizes) == 100 and len(parts) == next(n for n in range(1, 9) if sum(sizes[:n]) >= 20) < len(sizes)


def test_lookup_is_one_request(spark, folder):
    found = paged.lookup(spark, SCHEMA, 31, path=folder, key="instance_id")
    assert found.rdd.getNumPartitions() == 1 and found.first()["instance_id"] == 31
    with pytest.raises(Exception, match="no approval 99"):
        paged.lookup(spark, SCHEMA, 99, path=folder, key="instance_id").collect()


def test_other_filters_stay(spark, folder):
    rows = paged.pending(spark, SCHEMA, path=folder, key="instance_id").filter("instance_id >= 45 and title like '%9%'").collect()
    assert {r["title"] for r in rows} == {"title 90", "title 91", "title 92", "title 93", "title 94", "title 95", "title 96", "title 97", "title 98", "title 99"}


def test_stream_reads_new_pages(spark, folder, tmp_path):
    paged.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("paged").schema(SCHEMA).options(path=folder, key="instance_id").load()
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 100
    listed = json.loads((tmp_path / "pages" / "sizes.json").read_text())
    (tmp_path / "pages" / "more.json").write_text('{"instance_id": 500, "title": "new"}\n')
    (tmp_path / "pages" / "sizes.json").write_text(json.dumps([*listed, {"name": "more.json", "rows": 1, "first": 500, "last": 500}]))
    assert run() == 101
