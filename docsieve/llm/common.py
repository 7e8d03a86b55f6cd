"""Helpers shared by the corpus operators: tables, saved intermediates, words, batches."""

from __future__ import annotations

import contextlib
import ctypes
import mmap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.sources.shared import forget, saved, shared_dir
from docsieve.sources.tables import spread, table

__all__ = ["forget", "saved", "shared_dir", "spread", "table"]

#: Bytes of text that a numpy step handles at once; longer texts form a slice of their own.
SLICE_BYTES = 4 << 20
#: A side may be broadcast only below this many bytes; each use measures its side first.
BROADCAST_BYTES = 16 << 20


def fits_broadcast(rows: int, bytes_per_row: int) -> bool:
    return rows * bytes_per_row <= BROADCAST_BYTES


def text_bytes(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """The kept columns and the text as UTF-8 bytes (null stays null)."""
    return spread(docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text")))


def boxed(docs: DataFrame, *more: str) -> DataFrame:
    """(row, text, more...): all columns but the text as one struct, so that no name of theirs can clash, the text
    as bytes, and copies of the columns named in ``more``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))
    return spread(docs.select(row.alias("row"), F.col("text").cast("string").cast("binary").alias("text"), *more))


def shape(df: DataFrame, more: str = "") -> str:
    """The schema of ``df`` as text for mapInArrow, and more columns."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + more


def unboxed(df: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The columns of ``docs`` from the result of steps on ``boxed`` rows, and more; these win over equal names."""
    own = [F.col("text").cast("string").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in more]
    return df.select(*own, *more)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text at most."""
    try:
        for batch in batches:
            yield from cuts(batch, column, limit)
    finally:
        release()


def cuts(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut one record batch so that each part holds about ``limit`` bytes of text at most."""
    ends = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: Resident bytes above which a worker gives memory back.
RESIDENT = 256 << 20


def release() -> None:
    """Give free memory back to the system, so that a large worker between two tasks holds little of the first."""
    with contextlib.suppress(AttributeError, OSError):  # only Linux tells the size so, only the GNU C library trims
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * mmap.PAGESIZE < RESIDENT:
                return
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def blobs(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive word hashes; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + mix(h[i : i + n])
    return mix(out)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value's text, modulo ``modulus``; a null value counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
