"""Running values over the ordered rows of each key, whatever the number of rows of a key.

A window over a key puts all its rows into one task. Here the order itself is cut into ranges of about equal numbers of
rows, and windows run over (key, range) only, so that no task gets more of a key than a range holds. What a range
hands on to the next is one row for each key, made by an aggregate that combines before the exchange; the rows of a
key's earlier ranges are put together in a window over these few rows and joined back. A table of a single range needs
neither.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a range, about, and how many ranges there are at most.
CHUNK_ROWS, MAX_CHUNKS = 1_000_000, 256
#: Values of the order that the cuts are taken from, about.
SAMPLE = 20_000


class Running(NamedTuple):
    """A running value: over the rows of a range, what a range hands on, the same over earlier ranges, both together."""

    local: Callable[[WindowSpec], Column]
    handed: Column
    earlier: Callable[[Column, WindowSpec], Column]
    together: Callable[[Column, Column], Column]


def position() -> Running:
    """The number of the row in its key, from 1."""
    return Running(lambda w: F.row_number().over(w).cast("long"), F.count("*"), lambda c, w: F.sum(c).over(w), lambda here, before: here + F.coalesce(before, F.lit(0)))


def running_xor(x: Column) -> Running:
    """All values up to the row, the row itself included, joined by exclusive or."""
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return Running(lambda w: F.bit_xor(x).over(up_to(w)), F.bit_xor(x), lambda c, w: F.bit_xor(c).over(w), lambda here, before: F.coalesce(here, F.lit(0)).bitwiseXOR(F.coalesce(before, F.lit(0))))


def running_count(condition: Column) -> Running:
    """How many rows up to the row, itself included, meet the condition."""
    one = F.when(condition, 1).otherwise(0).cast("long")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return Running(lambda w: F.sum(one).over(up_to(w)), F.sum(one), lambda c, w: F.sum(c).over(w), lambda here, before: here + F.coalesce(before, F.lit(0)))


def last_before(x: Column, order: list[str]) -> Running:
    """The last value that is not null in the rows before the row; null where there is none."""
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))
    return Running(lambda w: F.last(x, ignorenulls=True).over(ahead(w)), last, lambda c, w: F.last(c, ignorenulls=True).over(w), lambda here, before: F.coalesce(here, before))


def _cuts(rows: DataFrame, order: list[str], chunk_rows: int) -> list:
    """Rows of the order at which a new range begins; none for a table of one range."""
    n = rows.count()
    chunks = min(MAX_CHUNKS, -(-n // chunk_rows))
    if chunks < 2:
        return []
    drawn = rows.select(*order).sample(fraction=min(1.0, SAMPLE / n), seed=17).toArrow().to_pylist()  # SAMPLE rows, about
    low = lambda r: tuple((r[c] is not None, r[c]) for c in order)
    drawn.sort(key=low)
    cuts = [drawn[len(drawn) * i // chunks] for i in range(1, chunks)] if drawn else []
    return [c for i, c in enumerate(cuts) if not i or low(cuts[i - 1]) < low(c)]


def ordered_scan(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Running], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with the running ``values`` of each key, rows taken by ``order`` (ascending, nulls first).

    Rows without a key form a key of their own, as in a window. Rows of a key that are equal in all of ``order`` come
    one behind the other as they may. An empty table stays empty. ``rows`` is counted, and its order sampled, before.
    """
    clash = set(values) & set(rows.columns)
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    cuts = _cuts(rows, order, chunk_rows)
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.select("*", *[v.local(w).alias(name) for name, v in values.items()])
    types = {f.name: f.dataType for f in rows.select(*order).schema}
    literal = lambda c: F.struct(*[F.lit(c[name]).cast(types[name]).alias(name) for name in order])
    place = F.size(F.filter(F.array(*map(literal, cuts)), lambda c: c <= F.struct(*order)))
    parts = rows.withColumn("_part", place)
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = parts.select("*", *[v.local(w).alias(f"_here_{name}") for name, v in values.items()])
    handed = parts.groupBy(*keys, "_part").agg(*[v.handed.alias(f"_out_{name}") for name, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = handed.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_key_part"), F.lag("_part").over(Window.partitionBy(*keys).orderBy("_part")).alias("_was"), *[v.earlier(F.col(f"_out_{name}"), earlier).alias(f"_in_{name}") for name, v in values.items()])
    carried = carried.filter("_was is not null")  # the first range of a key starts anew
    same = F.col("_part") == F.col("_key_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    joined = local.join(carried, same, "left")
    return joined.select(*rows.columns, *[v.together(F.col(f"_here_{name}"), F.col(f"_in_{name}")).alias(name) for name, v in values.items()])
