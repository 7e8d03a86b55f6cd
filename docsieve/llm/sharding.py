"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Documents lie in blocks (a keyed hash of the row). The driver draws, from the block sizes alone, how many
rows of each block go to each shard: a matrix whose margins are the block and the shard sizes, drawn row by
row from the multivariate hypergeometric law that a uniform shuffle would follow. Blocks are hashes of the rows
and not of their places, so that the same documents are dealt alike however they are stored. Each block is permuted by
a keyed order and dealt out by its row of the matrix; after the exchange each shard is permuted again by
another key. Shard sizes differ by one at most. Only DataFrame functions touch the documents.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import boxed, saved, unboxed

SHARDS = 24
#: Rows that a block holds about, and how many blocks there are at least and at most.
BLOCK_ROWS, MIN_BLOCKS, MAX_BLOCKS = 50_000, 256, 65_536


def hypergeometric(u: float, good: int, bad: int, n: int) -> int:
    """The draw that ``u`` (uniform on [0, 1)) stands for: marked items among ``n`` of good + bad.

    Weights go out from the mode by the ratios of neighbours, as far as a weight counts, and are divided by their
    sum: no factorial is needed, so nothing is lost to the size of the numbers.
    """
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    many = good + bad
    span = int(10 * (n * (good / many) * (bad / many)) ** 0.5) + 30 if many else 0
    up = np.arange(mode, min(high, mode + span), dtype=float)
    down = np.arange(mode, max(low, mode - span), -1, dtype=float)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.cumsum(np.concatenate((below[::-1], [1.0], above)))
    at = int(np.searchsorted(weights, u * weights[-1], side="right"))
    return mode - len(below) + min(at, len(weights) - 1)


def matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows by block, columns by shard; the sums are the given sizes."""
    rng, room, out = random.Random(seed), list(shard_sizes), []
    for size in block_sizes:
        rest, row = sum(room), []
        for s, cap in enumerate(room):
            rest -= cap
            row.append(size if not rest else hypergeometric(rng.random(), cap, rest, size) if size else 0)
            size -= row[-1]
            room[s] -= row[-1]
        out.append(row)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's bytes (null: none) plus 8. The law is ``rows``: shard sizes differ by one at most,
    so grown_shard is null. Repeated rows are dealt out one by one; rows without a doc_id, which may be many, go
    to their blocks by the number that they are written with. Other columns are not looked at; an empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    rows = saved(rows.withColumn("_no", number))
    total = rows.count()
    blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, -(-total // BLOCK_ROWS)))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "_no"), F.lit(blocks))
    rows = rows.withColumn("_block", place)
    sizes = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect()}  # MAX_BLOCKS at most
    wanted = [total // shards + (s < total % shards) for s in range(shards)]
    order = sorted(sizes)
    ends = []
    for block, row in zip(order, matrix([sizes[b] for b in order], wanted, seed), strict=True):
        ends.append({"b": block, "e": [sum(row[: i + 1]) for i in range(shards)]})
    dealt = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<b: long, e: array<long>>>"))).select(F.col("b").alias("_block"), F.col("e").alias("_ends"))
    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "_no"), "doc_id", "text_crc32", "_no")
    rows = rows.withColumn("_rank", F.row_number().over(local) - 1).join(F.broadcast(dealt), "_block")
    rows = rows.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
    parts = -(-blocks // shards)
    key = F.xxhash64(F.lit(seed + 2), "doc_id", "text_crc32", "_no")
    rows = saved(rows.withColumn("_part", F.pmod(key, F.lit(parts))).select("doc_id", "size", "text_crc32", "_no", "shard", "_part"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("n"))  # blocks + shards rows at most
    starts = counts.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "_part", "_start")
    again = Window.partitionBy("shard", "_part").orderBy(key, "doc_id", "text_crc32", "_no")
    return (
        rows.withColumn("_rank", F.row_number().over(again) - 1)
        .join(F.broadcast(starts), ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``docs`` with _shard and _slot, each row in its place; write it with partitionBy("_shard").

    Rows that repeat a doc_id and text are told apart by a running number, any order of which is the same.
    """
    crc = F.crc32(F.coalesce("text", F.lit(b"")))
    same = Window.partitionBy("id", "crc")
    places = assign(docs, shards, seed).select(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    places = places.withColumn("nth", F.row_number().over(same.orderBy("_shard", "_slot")))
    own = boxed(docs, F.col("doc_id").cast("long").alias("id")).withColumn("crc", crc)
    own = own.withColumn("nth", F.row_number().over(same.orderBy(F.lit(0))))
    met = own.alias("o").join(places.alias("p"), F.expr("o.id <=> p.id and o.crc = p.crc and o.nth = p.nth"))
    return unboxed(met.select("row", "text", "_shard", "_slot"), docs, "_shard", "_slot")
