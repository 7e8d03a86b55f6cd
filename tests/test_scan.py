"""Running values over ranges of the order against windows over whole keys."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsieve.operators import scan


def rows(spark, n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = rng.choice([7, 7, 7, *range(40), None])  # one key holds many rows
        out.append((key, rng.choice([None, *range(300)]), i, rng.choice([None, None, "a", "b", "c"]), rng.getrandbits(60), rng.random() < 0.2))
    return spark.createDataFrame(out, "k int, ts int, no int, digest string, h long, starts boolean").repartition(7)


def values():
    return {
        "at": scan.position(),
        "xor": scan.running_xor(F.col("h")),
        "section": scan.running_count(F.col("starts")),
        "last": scan.last_before(F.col("digest"), ["ts", "no"]),
    }


def windows(df):
    w = Window.partitionBy("k").orderBy("ts", "no")
    up_to, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        F.row_number().over(w).cast("long").alias("at"),
        F.bit_xor("h").over(up_to).alias("xor"),
        F.sum(F.col("starts").cast("long")).over(up_to).alias("section"),
        F.last("digest", ignorenulls=True).over(ahead).alias("last"),
    )


def everything(df):
    return sorted(map(str, df.collect()))


def test_ranges_equal_windows(spark):
    df = rows(spark)
    want = everything(windows(df))
    for chunk in (10**6, 400, 60):
        assert everything(scan.ordered_scan(df, ["k"], ["ts", "no"], values(), chunk_rows=chunk)) == want


def test_no_group_is_larger_than_a_range(spark, monkeypatch):
    """The key that holds a third of the rows is spread over all ranges."""
    df = rows(spark, 6000)
    seen = {}
    take = scan._cuts
    monkeypatch.setattr(scan, "_cuts", lambda *a: seen.setdefault("cuts", take(*a)))
    scan.ordered_scan(df, ["k"], ["ts", "no"], {"at": scan.position()}, chunk_rows=300).count()
    assert len(seen["cuts"]) == 19
    place = F.size(F.filter(F.array(*[F.struct(F.lit(c["ts"]).alias("ts"), F.lit(c["no"]).alias("no")) for c in seen["cuts"]]), lambda c: c <= F.struct("ts", "no")))
    sizes = [r["count"] for r in df.groupBy("k", place.alias("p")).count().collect()]
    assert max(sizes) < 100 and df.filter("k = 7").count() > 300


def test_empty_and_strings(spark):
    df = rows(spark).withColumn("ts", F.col("ts").cast("string"))
    assert everything(scan.ordered_scan(df, ["k"], ["ts", "no"], values(), chunk_rows=100)) == everything(windows(df))
    assert scan.ordered_scan(df.limit(0), ["k"], ["ts", "no"], values()).count() == 0
