"""Which values of a table stand in which texts of another, for tables of any size: an inverted index of grams.

A value that stands in a text shares its grams with it, so each value looks only into the texts that have its rarest one.
Long values and the texts are thinned by the same rule first (of every run of grams the one with the least hash), which
keeps a gram of each such run on both sides; short values keep all of theirs. Grams of texts that no value has are
left out before the exchange by a bit set of fixed size. What meets is confirmed on the whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.sources.shared import saved
from docsieve.sources.tables import spread

#: Characters of a gram, and grams of a run of which the least is kept, of long values; shorter ones have a class each.
GRAM, RUN = 8, 9
LONG = GRAM + RUN - 1
#: Values from this length on share the class of their four-character grams.
SHORT = 4
#: log2 of the bits that tell grams of values apart.
BITS = 22

_STEP = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(letters: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` characters; the size is part of the hash."""
    n = len(letters) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x100000001B3) + letters[i : i + n]
    return _mix(out)


def _least(hashes: np.ndarray, run: int) -> np.ndarray:
    """Of every run of hashes the least."""
    if len(hashes) < run:
        return hashes[:0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, run).min(axis=1))


def _class(length: int) -> int:
    """The gram size of a value's class: its length up to ``SHORT``, ``SHORT`` below ``LONG``, else ``GRAM``."""
    return GRAM if length >= LONG else min(length, SHORT)


def _of_value(letters: np.ndarray) -> np.ndarray:
    size = _class(len(letters))
    found = _grams(letters, size)
    return _least(found, RUN) if size == GRAM else np.unique(found)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


#: Characters that are worked on at once; a longer text is cut into windows that overlap.
WINDOW = 1 << 20


def _of_text(text: str, classes: list[int], bits: np.ndarray | None) -> np.ndarray:
    letters, out = _letters(text), []
    for size in classes:
        over = size + (RUN if size == GRAM else 1) - 2
        for start in range(0, max(1, len(letters)), WINDOW):
            found = _grams(letters[start : start + WINDOW + over], size)
            found = _least(found, RUN) if size == GRAM else np.unique(found)
            if bits is not None:
                at = found >> np.uint64(64 - BITS)
                found = found[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
            out.append(found)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _explode(name: str, take: Callable[[str], np.ndarray], more: Callable[[str], int] | None = None) -> _STEP:
    """(name, text) -> (name, gram), a row for each gram; with ``more`` a number of the text besides."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                grams = [take(t) for t in texts]
                who = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
                columns = [part.column(name).take(pa.array(who)), pa.array(np.concatenate(grams).view(np.int64) if grams else np.empty(0, np.int64))]
                names = [name, "gram"]
                if more:
                    columns.append(pa.array(np.array([more(t) for t in texts], np.int32)[who]))
                    names.append("size")
                yield pa.RecordBatch.from_arrays(columns, names)

    return step


def contained(texts: DataFrame, values: DataFrame, text_id: str, value_id: str) -> DataFrame:
    """(text_id, value_id) of every text that contains a value, once each.

    ``texts``: (text_id, text), ``values``: (value_id, value), both with whole-number ids; fold the columns before if
    the comparison is to be folded. Empty and null values stand in nothing; null texts have nothing; rows without an id
    take no part; several texts of one id count as one that has what any of them has. Texts of any length are read
    whole. An empty table on either side gives an empty table.
    """
    spark = texts.sparkSession
    texts = spread(texts.select(F.col(text_id).cast("long").alias("t"), F.col("text").cast("string").alias("text")).filter("t is not null and text is not null"))
    values = values.select(F.col(value_id).cast("long").alias("v"), F.col("value").cast("string").alias("text")).filter("v is not null and text <> ''")
    wanted = saved(values.mapInArrow(_explode("v", lambda t: _of_value(_letters(t)), lambda t: _class(len(t))), "v long, gram long, size int"))
    classes = sorted(r["size"] for r in wanted.select("size").distinct().collect())
    # 2 ** BITS bits, whatever the number of values
    word = F.shiftrightunsigned("gram", 64 - BITS + 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITS}) & 63 as int))")
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    filled = wanted.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits[filled.column("w").to_numpy()] = filled.column("b").to_numpy().view(np.uint64)
    had = saved(texts.mapInArrow(_explode("t", lambda t: _of_text(t, classes, bits)), "t long, gram long").distinct())
    often = had.groupBy("gram").agg(F.count("*").alias("n"))
    # a value with a gram that no text has stands in none of them
    known = wanted.join(often, "gram", "left")
    rarest = known.groupBy("v").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("all"), F.count("n").alias("there")).filter("all = there").select("v", "gram")
    pairs = had.join(rarest, "gram").select("t", "v")
    met = pairs.join(values.withColumnRenamed("text", "value"), "v").join(texts, "t")
    return met.filter(F.col("text").contains(F.col("value"))).select(F.col("t").alias(text_id), F.col("v").alias(value_id)).distinct()
