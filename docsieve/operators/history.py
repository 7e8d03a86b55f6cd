"""Versioned history on append-only tables: latest rows, reuse, seeding, upserts, change events, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.scan import last_before, ordered_scan, position


class IdentityConflict(ValueError):
    """A batch names a known task by another code, or a known code with another task."""


def pending(items: DataFrame, position: str, limit: int) -> DataFrame:
    """The first ``limit`` items by position, as they come: repeats among them are merged later. None below one."""
    return items.orderBy(position).limit(max(limit, 0))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key; aggregated before the exchange, so hot keys are cheap."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def choose_by_priority(rows: DataFrame, key: str, priority: Column, position: str) -> DataFrame:
    """Of each key the row with the least priority, then position; rows without a priority are no choice."""
    rest = [c for c in rows.columns if c != key]
    ranked = rows.withColumn("_p", priority).filter("_p is not null")
    best = ranked.groupBy(key).agg(F.min(F.struct("_p", position, *[c for c in rest if c != position])).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def main_document(name: Column, flagged: Column, keywords: tuple[str, ...]) -> Column:
    """Priority of an attachment: 1 if flagged, 2 if its name has a keyword, else null."""
    has = F.lit(False)
    for k in keywords:
        has = has | F.lower(name).contains(k.lower())
    return F.when(flagged, 1).when(has, 2)


def split_reuse(new: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` plus ``outcome``: reused if history has its key (content and algorithm version), else created."""
    known = history.select(*keys).distinct().withColumn("_known", F.lit(True))
    return new.join(known, keys, "left").select(*[new[c] for c in new.columns], F.when(F.col("_known"), "reused").otherwise("created").alias("outcome"))


def reusable_reads(snapshots: DataFrame, version: str, method: str | None = None) -> DataFrame:
    """(attachment_id, file_sha256, document_read_snapshot_id): the latest successful read of each file by a reader
    version. Reads by any method count, unless one is named, as for OCR."""
    own = snapshots.filter((F.col("read_status") == "success") & (F.col("reader_version") == version))
    own = own if method is None else own.filter(F.col("read_method") == method)
    return own.groupBy("attachment_id", "file_sha256").agg(F.max("document_read_snapshot_id").alias("document_read_snapshot_id"))


def seed_missing(existing: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """The defaults that are not there yet; existing rows are never changed."""
    return defaults.join(existing.select(key), key, "left_anti")


def upsert(state: DataFrame, incoming: DataFrame, key: str, other_key: str, update: list[str], position: str, initial: dict[str, Column]) -> DataFrame:
    """``state`` after a batch: unseen keys enter with ``initial`` values, known ones get ``update`` from the last
    row of the batch, nulls included. The other columns of a known row stay.

    If the batch disagrees with the state, or with itself, about which key goes with which ``other_key``, all of it
    is refused: this looks for one such pair before it returns, and raises ``IdentityConflict``.
    """
    named = state.select(key, other_key).unionByName(incoming.select(key, other_key)).distinct()
    clash = conflicts(named, key, other_key).take(1)
    if clash:
        raise IdentityConflict(f"{clash[0]['side']} {clash[0]['value']} stands with {clash[0]['others']} others")
    last = latest(incoming, [key], position).withColumn("_in", F.lit(True))
    both = state.withColumn("_was", F.lit(True)).alias("s").join(last.alias("n"), key, "full")
    columns = []
    for c in state.columns:
        if c == key:
            columns.append(F.col(key))
        elif c in update:
            columns.append(F.when(F.col("n._in"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        elif c in initial:
            columns.append(F.when(F.col("s._was").isNull(), initial[c]).otherwise(F.col(f"s.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("s._was"), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return both.select(*columns)


def upsert_events(state: DataFrame, incoming: DataFrame, key: str, place: str) -> DataFrame:
    """``incoming`` plus ``event``: created for the first row of an unseen key, else updated. A key may have any number
    of rows; ``incoming`` is counted before."""
    known = state.select(key).distinct().withColumn("_known", F.lit(True))
    marked = ordered_scan(incoming, [key], [place], {"_nth": position()}).join(known, key, "left")
    return marked.select(*[F.col(c) for c in incoming.columns], F.when((F.col("_nth") == 1) & F.col("_known").isNull(), "created").otherwise("updated").alias("event"))


def conflicts(rows: DataFrame, key: str, other: str) -> DataFrame:
    """Values of either key that stand with more than one value of the other: (side, value, others)."""
    side = lambda a, b: rows.filter(F.col(a).isNotNull()).groupBy(F.col(a).cast("string").alias("value")).agg(F.count_distinct(b).alias("others")).filter("others > 1").select(F.lit(a).alias("side"), "value", "others")
    return side(key, other).unionByName(side(other, key))


def content_events(rows: DataFrame, keys: list[str], order: list[str], digest: str, exists: Column | None = None) -> DataFrame:
    """``rows`` plus ``event`` by the digest that the key has so far: DOWNLOADED without one, REUSED if it is equal and the
    file is still there, else UPDATED. A row without a digest is a FAILED download: the key keeps the digest it
    has, so the same content after it is reused. A key may have any number of rows; ``rows`` is counted before."""
    same = (F.col(digest) == F.col("_before")) & (F.lit(True) if exists is None else exists)
    event = F.when(F.col(digest).isNull(), "FAILED").when(F.col("_before").isNull(), "DOWNLOADED").when(same, "REUSED").otherwise("UPDATED")
    return ordered_scan(rows, keys, order, {"_before": last_before(F.col(digest), order)}).withColumn("event", event).drop("_before")


def listed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` plus ``place``, their number from 1 in the list of their key. A list may have any number of rows."""
    return ordered_scan(rows, keys, order, {"place": position()})


def lineage(parses: DataFrame, snapshots: DataFrame, attachments: DataFrame) -> DataFrame:
    """Parses with the task they belong to: parse to snapshot to attachment."""
    return parses.join(snapshots, "document_read_snapshot_id").join(attachments, "attachment_id")


def select_source(attachments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per task: the oldest main attachment that is there, and its latest successful read of its current content."""
    mains = attachments.filter("is_main_contract and download_status = 'success'")
    oldest = mains.groupBy("task_id").agg(F.min(F.struct("attachment_id", "sha256")).alias("a")).select("task_id", F.col("a.attachment_id").alias("attachment_id"), F.col("a.sha256").alias("file_sha256"))
    reads = snapshots.filter("read_status = 'success'").join(oldest, ["attachment_id", "file_sha256"])
    return reads.groupBy("task_id").agg(F.max("document_read_snapshot_id").alias("document_read_snapshot_id"))


def select_parse(attachments: DataFrame, snapshots: DataFrame, parses: DataFrame) -> DataFrame:
    """Per task: the latest success or partial parse of the selected snapshot."""
    usable = parses.filter(F.col("parse_status").isin("success", "partial"))
    return usable.join(select_source(attachments, snapshots), "document_read_snapshot_id").groupBy("task_id").agg(F.max("contract_parse_id").alias("contract_parse_id"))


def select_result(results: DataFrame, current: DataFrame) -> DataFrame:
    """Per parse: the latest completed or partial result whose two fingerprints are the current ones (its version is
    not compared)."""
    keys = ["contract_parse_id", "rule_set_fingerprint", "rule_hit_fingerprint"]
    return results.filter(F.col("review_status").isin("completed", "partial")).join(current.select(*keys), keys).groupBy("contract_parse_id").agg(F.max("review_result_id").alias("review_result_id"))


def write_comments(attempts: DataFrame, earlier: DataFrame | None = None, order: str = "attempt_id") -> DataFrame:
    """One comment per (instance_id, review_id), the first by ``order``: repeats and what was written before are
    left out."""
    keys = ["instance_id", "review_id"]
    rest = [c for c in attempts.columns if c not in (*keys, order)]
    first = attempts.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r"))
    once = first.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in attempts.columns])
    return once if earlier is None else once.join(earlier, keys, "left_anti")
