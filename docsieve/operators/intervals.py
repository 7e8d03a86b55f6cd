"""Ranges met with the points of long tables, without gathering either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions in one bin of the join. A range is met once for each bin that it touches.
BIN = 64


def in_ranges(ranges: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, width: int = BIN) -> DataFrame:
    """Each range with each point of its key in [start, end]: an equi-join on (key, bin), then the exact test.

    Ranges that are null or turned round meet nothing. A key with very many ranges or points is spread over its bins;
    a range of any length becomes one row for each bin, before the exchange.
    """
    bins = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_bin")
    cut = ranges.filter(F.col(start) <= F.col(end)).select("*", bins)
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    return cut.join(placed, [key, "_bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def whole_ranges(ranges: DataFrame, points: DataFrame, key: str, range_id: str, start: str, end: str, at: str, text: str, page: str, width: int = BIN) -> DataFrame:
    """(range columns, whole, n_points, n_chars, page_start, page_end) of every range: whole if start and end are there
    in order and each position between them has a point. Sums and ends only: the points stay where they are.

    Repeated points count once for ``whole``, and each for the characters; pages are the first and last that are
    not null. What is not whole has no characters and pages. ``range_id`` tells the ranges of a key apart.
    """
    met = in_ranges(ranges.select(key, range_id, start, end), points.select(key, at, F.length(text).alias("_n"), F.col(page).alias("_page")), key, start, end, at, width)
    paged = F.when(F.col("_page").isNotNull(), F.col(at))
    sums = met.groupBy(key, range_id).agg(
        F.count_distinct(at).alias("n_points"), F.sum("_n").alias("n_chars"), F.min_by("_page", paged).alias("page_start"), F.max_by("_page", paged).alias("page_end")
    )
    out = ranges.join(sums, [key, range_id], "left")
    whole = F.coalesce(F.col("n_points") == F.col(end) - F.col(start) + 1, F.lit(False))
    only = lambda c: F.when(whole, F.col(c)).alias(c)
    return out.select(*ranges.columns, whole.alias("whole"), F.coalesce("n_points", F.lit(0)).alias("n_points"), only("n_chars"), only("page_start"), only("page_end"))


def inside(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    """Whether a range lies within another; false if any end is missing."""
    return F.coalesce((start >= outer_start) & (end <= outer_end), F.lit(False))
