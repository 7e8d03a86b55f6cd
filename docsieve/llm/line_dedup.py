"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

A line can only be on ``sites`` sites if it occurs that often, so a count by line hash leaves the few lines
worth a sketch. Their HyperLogLog sketches of the sites merge by aggregation; lines whose estimate is near
the threshold get an exact distinct count. A long line does not recur by chance: it is boilerplate if it stands
in a few distinct surroundings (the lines before and behind it), whatever the sites, while in copies of one
document, which are not this operator's matter, its surroundings are the same. A boilerplate line stays in the document with the least doc_id
that has it and goes from all others, so its content is never lost altogether.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import boxed, fits_broadcast, saved, shape, slices, unboxed

#: A line on this many distinct sites is boilerplate.
SITES = 10
#: A line with so many spaces is long, and in so many distinct surroundings boilerplate.
LONG_SPACES, SURROUNDINGS = 50, 3
#: Shorter lines (in characters) are never boilerplate: they recur by chance.
MIN_CHARS = 20
#: log2 of a sketch's registers (error 1.6 %), and how near to the threshold an estimate gets an exact count.
LG_K, NEAR = 12, 0.1


def _is_long(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= LONG_SPACES


def _occurrences(docs: DataFrame, sites: int, min_chars: int) -> DataFrame:
    """(doc_id, line, place, least): where each line stands, a site or for long lines their surroundings, and how
    many of these make it boilerplate."""
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    beside = lambda i: F.coalesce(F.get("lines", i), F.lit("\u0000"))
    place = lambda x, i: F.when(x["long"], F.xxhash64(beside(i - 1), beside(i + 1)).cast("string")).otherwise(F.col("site")).alias("place")
    told = F.transform("lines", lambda x: F.struct(x.alias("line"), _is_long(x).alias("long")))
    placed = F.transform(told, lambda x, i: F.struct(x["line"].alias("line"), place(x, i), F.when(x["long"], SURROUNDINGS).otherwise(sites).alias("least")))
    placed = F.filter(placed, lambda x: F.length(x["line"]) >= min_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), lines.alias("lines"))
    return rows.select("doc_id", F.explode(placed).alias("x")).select("doc_id", "x.*")


def boilerplate(docs: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line, holder, spread): lines on at least ``sites`` sites, or long ones in SURROUNDINGS surroundings, the
    least doc_id that has each, and how many of these it has.

    ``spread`` is exact near the threshold, else the sketch's estimate. A null source counts as one site.
    """
    occurrences = _occurrences(docs, sites, min_chars)
    hashed = occurrences.withColumn("h", F.xxhash64("line"))
    often = saved(hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("least").alias("least")).filter("n >= least").select("h"))
    few = fits_broadcast(often.count(), 16)
    common = hashed.join(F.broadcast(often) if few else often, "h")
    sketched = common.groupBy("line").agg(F.hll_sketch_agg("place", LG_K).alias("sketch"), F.min("doc_id").alias("holder"), F.min("least").alias("least"))
    sketched = saved(sketched.select("line", "holder", F.hll_sketch_estimate("sketch").alias("spread"), "least"))
    clear = sketched.filter(F.col("spread") > F.col("least") * (1 + NEAR)).select("line", "holder", "spread")
    near = sketched.filter(F.col("spread").between(F.floor(F.col("least") * (1 - NEAR)), F.col("least") * (1 + NEAR))).select("line", "holder", "least")
    size = near.agg(F.coalesce(F.sum(F.octet_length("line").cast("long") + 128), F.lit(0)).alias("n")).first()["n"]
    exact = occurrences.drop("least").join(F.broadcast(near) if fits_broadcast(size, 1) else near, "line").select("line", "holder", "least", "place").distinct().groupBy("line", "holder", "least").agg(F.count("*").alias("spread")).filter("spread >= least")
    return clear.unionByName(exact.select("line", "holder", "spread"))


def _strip(held: dict[bytes, int | None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lines_, removed = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = [] if text is None else text.split(b"\n")
                left = [x for x in lines if x not in held or held[x] == doc]
                texts.append(text if len(left) == len(lines) else b"\n".join(left))
                lines_.append(len(lines))
                removed.append(len(lines) - len(left))
            at = batch.schema.get_field_index("text")
            out = batch.set_column(at, "text", pa.array(texts, pa.binary()))
            yield out.append_column("_lines", pa.array(lines_, pa.int64())).append_column("_removed", pa.array(removed, pa.int64()))

    return strip


def strip_boilerplate(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` with the boilerplate cut out of their texts, plus _lines and _removed (counts of lines).

    ``lines`` is broadcast if its measured size is below the bound; otherwise the documents' lines meet it in
    a shuffle join. Null texts stay null with no lines. Repeated rows are treated alike.
    """
    lines = saved(lines.select("line", "holder"))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("line").cast("long") + 128), F.lit(0)).alias("n")).first()["n"]
    if fits_broadcast(size, 1):
        raw = boxed(docs, F.col("doc_id").cast("long").alias("doc_id"))
        held = {r["line"].encode(): r["holder"] for r in lines.toLocalIterator()}
        return unboxed(raw.mapInArrow(_strip(held), shape(raw, ", _lines long, _removed long")), docs, "_lines", "_removed")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    raw = boxed(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("parts", parts)
    met = raw.select("doc_id", F.explode("parts").alias("line")).join(lines, "line").filter("not (doc_id <=> holder)")
    cuts = met.groupBy("doc_id").agg(F.collect_set("line").alias("cut")).withColumnRenamed("doc_id", "cut_id")
    both = raw.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    left = both.withColumn("kept", F.when(F.col("cut").isNull(), F.col("parts")).otherwise(F.filter("parts", lambda x: ~F.array_contains("cut", x))))
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    out = left.withColumns({"text": F.array_join("kept", "\n"), "_lines": size("parts"), "_removed": size("parts") - size("kept")})
    return unboxed(out, docs, "_lines", "_removed")


def dedup_lines(docs: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without cross-site boilerplate lines, plus _lines and _removed (see ``strip_boilerplate``)."""
    return strip_boilerplate(docs, boilerplate(docs, sites, min_chars))
