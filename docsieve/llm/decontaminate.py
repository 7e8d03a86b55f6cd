"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over training token windows.

Words are runs of ASCII letters and digits and of all non-ASCII characters, lower-cased in A-Z. A window is
ten consecutive words of an item; an item of fewer words is one window. The windows go to the executors as
sorted hashes with their words in one blob; every hit is verified word by word. What is broadcast at once is
bounded: the windows of a larger benchmark are dealt by their hashes to as many parts as it takes, and the
documents are scanned once for each part, carrying the words that were hit so far. No step exchanges rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import blobs, boxed, hash_words, saved, shape, slices, text_bytes, unboxed, window_hashes

WINDOW = 10
#: Bytes of windows that are broadcast at once, and what a byte of an item's text makes of them at most, about.
PART_BYTES, PER_BYTE = 48 << 20, 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """A part of the benchmark's windows: for each length the sorted hashes, their words in a blob, and the items
    that hold them (those with an id)."""

    def __init__(self, items: Iterable[tuple[int | None, bytes | None]], part: int = 0, parts: int = 1):
        found: dict[int, dict[bytes, tuple[int, set]]] = {}
        for item, text in items:
            words = words_of(text or b"")
            k = min(WINDOW, len(words))
            if not k:
                continue
            own = found.setdefault(k, {})
            hashes = window_hashes(hash_words(words), k)
            for i in np.flatnonzero(hashes % np.uint64(parts) == part):
                own.setdefault(b" ".join(words[i : i + k]), (int(hashes[i]), set()))[1].add(item)
        self.by_length = {}
        for k, windows in found.items():
            rows = sorted((h, w, sorted(x for x in items if x is not None)) for w, (h, items) in windows.items())
            ends = lambda sizes: np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            self.by_length[k] = (
                np.array([h for h, _, _ in rows], np.uint64), ends([len(w) for _, w, _ in rows]), b"".join(w for _, w, _ in rows),
                ends([len(o) for _, _, o in rows]), np.array([x for _, _, o in rows for x in o], np.int64),
            )

    def hits(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words lie inside an occurrence of a window, and the items that occur."""
        hit, items = np.zeros(len(words), bool), set()
        for k, (known, ends, blob, owned, owners) in self.by_length.items():
            if not len(known):
                continue
            h = window_hashes(hashes, k)
            place = np.searchsorted(known, h)
            for i in np.flatnonzero(known[np.minimum(place, len(known) - 1)] == h):
                at, window = int(place[i]), b" ".join(words[i : i + k])
                while at < len(known) and known[at] == h[i]:
                    if blob[ends[at] : ends[at + 1]] == window:
                        hit[i : i + k] = True
                        items.update(owners[owned[at] : owned[at + 1]].tolist())
                    at += 1
        return hit, items


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; a run of them goes with what stands between them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    out, at = [], 0
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*out, text[at:]])


def _parts(benchmark: DataFrame) -> int:
    """Parts that the benchmark's windows are dealt to, so that each fits the bound."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-size * PER_BYTE // PART_BYTES))


def _windows(benchmark: DataFrame, part: int, parts: int) -> Windows:
    """The windows of one part; the items come to the driver one by one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return Windows(((r["item_id"], r["text"]) for r in items.toLocalIterator()), part, parts)


_MARKS = ", n_words long, hit array<int>, item_ids array<long>"


def _marker(windows: Windows, last: bool, keep_text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the words hit and the items met so far; the last pass may leave the text out."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before = [batch.column(c).to_pylist() if c in batch.schema.names else None for c in ("hit", "item_ids")]
            n, hits, ids = [], [], []
            for i, text in enumerate(blobs(batch)):
                words = words_of(text)
                hit, items = windows.hits(words, hash_words(words))
                if before[0]:
                    hit[before[0][i]] = True
                    items.update(before[1][i])
                n.append(len(words))
                hits.append(np.flatnonzero(hit).astype(np.int32))
                ids.append(sorted(items))
            own = [c for c in batch.schema.names if c not in ("n_words", "hit", "item_ids") and (c != "text" or keep_text or not last)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))], [*own, "n_words", "hit", "item_ids"])

    return mark


def _marked(rows: DataFrame, benchmark: DataFrame, keep_text: bool) -> DataFrame:
    """``rows`` (with text as bytes) plus n_words, hit (places of hit words) and item_ids."""
    parts, names = _parts(benchmark), rows
    for part in range(parts):
        last = part == parts - 1
        own = shape(names if keep_text or not last else names.drop("text"))
        rows = rows.mapInArrow(_marker(_windows(benchmark, part, parts), last, keep_text), own + _MARKS)
        rows = rows if last else saved(rows)
    return rows


def item_digest() -> Column:
    """SHA-256 of the items' ids, sorted as texts and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ","), 256)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids.

    Null and empty texts have no words and no hits; the digest of no items is that of an empty string. Items
    without words never occur; items with a null id hit words but are not counted. Repeated items count once.
    Repeated rows and rows with a null id are scanned like any other. Other columns are ignored; empty tables
    give an empty result or no hits.
    """
    found = _marked(text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), benchmark, False)
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), item_digest().alias("items_sha256"), (n_hit > 0).alias("contaminated"), "item_ids")


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = []
        for text, n, places in zip(batch.column("text").to_pylist(), batch.column("n_words").to_pylist(), batch.column("hit"), strict=True):
            hit = np.zeros(n, bool)
            hit[places.values.to_numpy(zero_copy_only=False)] = True
            texts.append(without(text, hit) if hit.any() else text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary())], ["row", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with hit words cut out of their texts, each row by its own text.

    A run of hit words goes with what stands between them. Nulls stay null, texts without a hit stay as they are;
    a text may be left empty. Columns and the number of rows are unchanged, whatever the ids; an empty table gives
    an empty table.
    """
    raw = boxed(docs)
    return unboxed(_marked(raw, benchmark, True).mapInArrow(_cut, shape(raw)), docs)


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in whose text a benchmark window occurs.

    Rows are judged one by one: a null or repeated doc_id makes no difference, and a row goes only by its own text.
    Null and empty texts stay. The columns are unchanged; an empty table gives an empty table.
    """
    return unboxed(_marked(boxed(docs), benchmark, True).filter(F.size("hit") == 0), docs)
