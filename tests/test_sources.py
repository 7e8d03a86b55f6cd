"""Reading files, and streams against their batch forms."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from docsieve.operators import state
from docsieve.sources import documents
from docsieve.streaming import tasks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<?xml version='1.0'?><w:document {W}><w:body>{body}</w:body></w:document>")


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_files_are_read_by_type(spark, tmp_path):
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell(' ')}</w:tr><w:tr>{cell('wide', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}</w:tr></w:tbl>"
    docx(tmp_path / "one.DOCX", p(" A title of some length ") + p(" ") + table + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p><w:sectPr/>")
    docx(tmp_path / "short.docx", p("few"))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "scan.png").write_bytes(b"png")
    (tmp_path / "pages.pdf").write_bytes(b"first page of text|| third page")
    (tmp_path / "note.txt").write_bytes(b"text")
    found = documents.files(spark, str(tmp_path)).withColumn("document_id", F.monotonically_increasing_id())
    named = {r["document_id"]: r["path"].rsplit("/", 1)[-1] for r in found.collect()}
    for pdf in (None, lambda content: content.decode().split("|")):
        rows = {named[r["document_id"]]: r for r in documents.read(found, pdf).collect()}
        one = rows["one.DOCX"]
        assert [tuple(b) for b in one["blocks"]] == [("A title of some length", None, 0), ("a\tb\nwide\twide", None, 1), ("x\ty\nz", None, 2)]
        assert one["read_status"] == "success" and one["text"].count("\n\n") == 2 and one["file_type"] == "docx"
        outcome = {k: (r["read_status"], r["error_code"], r["page_count"]) for k, r in rows.items()}
        assert outcome["short.docx"] == ("failed", "DOCUMENT_CONTENT_EMPTY", None) and outcome["broken.docx"][1] == "DOCUMENT_READ_FAILED"
        assert outcome["scan.png"] == ("ocr_required", "OCR_REQUIRED", 1) and outcome["note.txt"][1] == "DOCUMENT_READ_FAILED"
        if pdf is None:
            assert outcome["pages.pdf"] == ("failed", "DOCUMENT_READ_FAILED", None)
        else:
            assert outcome["pages.pdf"] == ("success", None, 3) and [tuple(b)[1:] for b in rows["pages.pdf"]["blocks"]] == [(1, 0), (3, 1)]


def test_text_of_runs(spark, tmp_path):
    """Changes, text boxes and page breaks are no text of a paragraph; links are, and a hyphen that does not break."""
    run = lambda inner: f"<w:r>{inner}</w:r>"
    body = "<w:p>" + run("<w:t>one</w:t><w:noBreakHyphen/><w:t>two</w:t>") + "<w:ins>" + run("<w:t> new</w:t>") + "</w:ins>" + "<w:hyperlink>" + run("<w:t> link</w:t>") + "</w:hyperlink>"
    body += run('<w:br w:type="page"/><w:t> three</w:t><w:br w:type="textWrapping"/><w:cr/><w:t>four</w:t><w:ptab/>') + run(f"<w:pict><w:txbxContent>{p('box')}</w:txbxContent></w:pict><w:t>five</w:t>") + "</w:p>"
    docx(tmp_path / "runs.docx", body)
    assert documents.docx_blocks((tmp_path / "runs.docx").read_bytes()) == ["one-two link three\n\nfour\tfive"]


def test_appended_tables_grow(spark, tmp_path):
    path = str(tmp_path / "logs")
    for i in range(2):
        documents.append(spark.createDataFrame([(i, "task_created")], "task_id long, log_type string"), path)
    assert spark.read.parquet(path).count() == 2


def _stream(spark, rows, schema, path):
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_replays_like_the_batch(spark, tmp_path):
    events = ["parsing", "reviewing", "blocked", "done", None]
    rows = [(i % 7, i, events[i * i % 5]) for i in range(120)]
    schema, path = "k int, at int, target string", str(tmp_path / "events")
    stream = tasks.replay_stream(_stream(spark, rows, schema, path), "k", ["at"], "target")
    last = {}

    def keep(batch, _):
        last.update({r["k"]: tuple(r) for r in batch.collect()})

    stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    want = {r["k"]: tuple(r) for r in state.replay(spark.createDataFrame(rows, schema), "k", ["at"], "target").collect()}
    assert last == want and sum(r[3] for r in want.values()) > 0


def test_stream_writes_comments_once(spark, tmp_path):
    rows = [(i, i % 5, i % 3) for i in range(120)]
    stream = tasks.comments_once(_stream(spark, rows, "attempt_id int, instance_id int, review_id int", str(tmp_path / "a")))
    seen = []
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: seen.extend((r["instance_id"], r["review_id"]) for r in b.collect())).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == len(set(seen)) == 15


def test_spread_goes_by_bytes(spark, tmp_path):
    """A file that gives every core a split is not dealt out, a small one is, however many files there are."""
    from docsieve.sources import tables

    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "small"))
    spark.range(1000).repartition(3 * cores).write.parquet(str(tmp_path / "many"))
    assert tables.spread(spark.read.parquet(str(tmp_path / "small"))).rdd.getNumPartitions() == cores
    assert tables.spread(spark.read.parquet(str(tmp_path / "many"))).rdd.getNumPartitions() == cores
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        whole = spark.read.parquet(str(tmp_path / "small"))
        assert tables.spread(whole).rdd.getNumPartitions() == whole.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    made = spark.range(10).repartition(2)
    assert tables.spread(made).rdd.getNumPartitions() == 2


def test_storage_paths(spark):
    from docsieve.functions.text import storage_path

    rows = spark.createDataFrame([("A-1", "x", "a.pdf"), ("..", "", ".."), ("a/../b", "c:d", "e\\\\f/g?.docx"), (None, None, None)], "code string, att string, name string")
    got = [r[0] for r in rows.select(storage_path(F.lit("/root/"), F.col("code"), F.col("att"), F.col("name"))).collect()]
    assert got == ["/root/A-1/x_a.pdf", "/root/unknown_approval/attachment_contract_file", "/root/b/c_d_g_.docx", "/root/unknown_approval/attachment_contract_file"]
