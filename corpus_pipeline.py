"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents, extra ones
included whatever their names. Empty tables give empty tables, and texts of any length are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import decontaminate, line_dedup, near_dedup, packing, quality
from docsieve.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the rules and the boosted trees keep.

    Null and empty texts go. Rows are judged one by one: repeated rows stay or go together. Documents without labels,
    or an empty table, leave the rules alone.
    """
    return quality.keep_good(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut cross-site boilerplate lines; a document goes only if nothing but white space is left of it.

    A text that was null, empty or blank before stays as it is. n_chars follows a text that was cut. Repeated rows
    are cut alike.
    """
    done = line_dedup.dedup_lines(docs)
    empty = (F.col("_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    left = done.filter(~F.coalesce(empty, F.lit(False)))
    return left.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    Rows go by their own texts, also where a doc_id repeats; nulls, empty texts and rows without an id stay.
    """
    return near_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go, each row by its own text, with an id or without."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces with their sequences and places; a null or empty text is one end token."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_spread),
    ("near_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: SQL cannot express the trees and the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
