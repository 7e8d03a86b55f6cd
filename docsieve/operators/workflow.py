"""Outcomes of the workflow's steps for every task, worked out from the tables that they follow from.

The ladders of ``operators.state`` say which rung applies; here their conditions come from tasks, attachments, files, read
snapshots, results and comment logs, by joins on their keys. Each function gives one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import file_type
from docsieve.operators import history, state


def main_attachments(attachments: DataFrame) -> DataFrame:
    """(task_id, attachment_id, file_sha256): of each task the oldest main attachment that was downloaded."""
    own = attachments.filter("is_main_contract and download_status = 'success'")
    least = own.groupBy("task_id").agg(F.min(F.struct("attachment_id", "sha256")).alias("a"))
    return least.select("task_id", F.col("a.attachment_id").alias("attachment_id"), F.col("a.sha256").alias("file_sha256"))


def _reuse(mains: DataFrame, snapshots: DataFrame, version: str, method: str | None = None) -> DataFrame:
    known = history.reusable_reads(snapshots, version, method)
    return mains.join(known, ["attachment_id", "file_sha256"], "left")


def prepared(tasks: DataFrame, offered: DataFrame, known: DataFrame, keywords: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """(task_id, attachment_id, outcome) of preparing each task's main attachment.

    ``offered``: what upstream lists (task_id, attachment_id, file_name, flagged, sha256; no digest: the download
    failed). ``known``: what is stored (attachment_id, sha256, there). The main one is flagged, else named by a keyword.
    """
    counted = offered.groupBy("task_id").agg(F.count("*").alias("n"))
    kind = file_type(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    best = history.choose_by_priority(offered.withColumn("_type", kind), "task_id", history.main_document(F.col("file_name"), F.col("flagged"), keywords), "attachment_id")
    best = best.join(known.select("attachment_id", F.col("sha256").alias("_old"), F.col("there").alias("_there")), "attachment_id", "left")
    event = F.when(F.col("_old").isNull(), "DOWNLOADED").when((F.col("_old") == F.col("sha256")) & F.col("_there"), "REUSED").otherwise("UPDATED")
    met = tasks.select("task_id").join(counted, "task_id", "left").join(best.withColumn("_event", event), "task_id", "left")
    outcome = state.attachment_outcome(F.coalesce("n", F.lit(0)), F.col("_type"), types, F.col("sha256").isNull(), F.col("_event"))
    return met.select("task_id", "attachment_id", outcome.alias("outcome"))


def read(tasks: DataFrame, attachments: DataFrame, files: DataFrame, snapshots: DataFrame, reads: DataFrame, version: str) -> DataFrame:
    """(task_id, attachment_id, outcome, document_read_snapshot_id) of reading each task's main attachment.

    ``files``: what lies in the store (attachment_id, size, readable); ``reads``: what the reader made of a file now
    (attachment_id, error_code, null for a success). The snapshot is the one that is used again.
    """
    mains = _reuse(main_attachments(attachments), snapshots, version)
    met = tasks.select("task_id").join(mains, "task_id", "left").join(files.select("attachment_id", "size", "readable"), "attachment_id", "left").join(reads.select("attachment_id", F.col("error_code").alias("_error")), "attachment_id", "left")
    reused = F.col("document_read_snapshot_id").isNotNull()
    outcome = state.read_outcome(F.col("attachment_id").isNotNull(), reused, F.col("file_sha256"), F.col("size").isNotNull(), F.coalesce("readable", F.lit(False)), F.col("size"), F.col("_error"))
    return met.select("task_id", "attachment_id", outcome.alias("outcome"), "document_read_snapshot_id")


def ocr(tasks: DataFrame, attachments: DataFrame, snapshots: DataFrame, recognised: DataFrame, version: str) -> DataFrame:
    """(task_id, attachment_id, outcome, document_read_snapshot_id) of asking for OCR. ``tasks`` have task_status and
    blocked_stage; ``recognised``: what the recogniser makes of a file now (attachment_id, error_code). What the file's
    latest read by any other method came to decides whether OCR is wanted."""
    mains = _reuse(main_attachments(attachments), snapshots, version, "ocr")
    source = snapshots.filter("read_method <> 'ocr'").groupBy("attachment_id", "file_sha256").agg(F.max_by("read_status", "document_read_snapshot_id").alias("_source"))
    mains = mains.join(source, ["attachment_id", "file_sha256"], "left").join(recognised.select("attachment_id", F.col("error_code").alias("_error")), "attachment_id", "left")
    met = tasks.select("task_id", "task_status", "blocked_stage").join(mains, "task_id", "left")
    outcome = state.ocr_outcome(F.col("task_status"), F.col("blocked_stage"), F.col("attachment_id").isNotNull(), F.col("file_sha256"), F.col("document_read_snapshot_id").isNotNull(), F.col("_source"), F.col("_error"))
    return met.select("task_id", "attachment_id", outcome.alias("outcome"), "document_read_snapshot_id")


def written_back(tasks: DataFrame, choice: DataFrame, results: DataFrame, logs: DataFrame, responses: DataFrame) -> DataFrame:
    """(task_id, review_result_id, outcome) of writing each task's current result back.

    ``choice``: (task_id, review_result_id) as ``history.select_result`` finds it; ``results``: their comment_text;
    ``logs``: earlier attempts (review_result_id, write_status); ``responses``: what upstream answers now (task_id, sent,
    valid). A task that is not reviewing may only use a comment again that is written already.
    """
    done = logs.filter("write_status = 'success'").select("review_result_id").distinct().withColumn("_written", F.lit(True))
    met = tasks.select("task_id", "task_status").join(choice, "task_id", "left").join(results.select("review_result_id", "comment_text"), "review_result_id", "left").join(done, "review_result_id", "left").join(responses, "task_id", "left")
    has, written = F.col("review_result_id").isNotNull(), F.coalesce("_written", F.lit(False))
    answer = F.when(F.coalesce("valid", F.lit(False)), "id")
    ladder = state.comment_outcome(has, written, F.col("comment_text"), F.coalesce("sent", F.lit(False)), answer)
    outcome = F.when(has & ~written & (F.col("task_status") != "reviewing"), "INVALID_TASK_STATE").otherwise(ladder)
    return met.select("task_id", "review_result_id", outcome.alias("outcome"))
