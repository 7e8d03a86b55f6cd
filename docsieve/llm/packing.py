"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Lengths are whole numbers up to the sequence length, so the plan needs only how many pieces there are of
each: documents above a third of the sequence go at most two to a bin, the largest with the largest that
fits; smaller ones go, longest first, to the bins with the least room that still holds them. Bins with equal
room are one run of sequence numbers, so the plan is a short table of slots whatever the input. Pieces find
their slot by their rank among pieces of equal length, which is counted per bucket of pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import blobs, saved, slices, text_bytes
from docsieve.llm.pieces import Uneven, careful_cut, is_even, plain_cut, stand_ins

LENGTH = 2048
#: Pieces of text that a task keeps the ids of, and the bytes of text that it encodes at once.
CACHE, SLICE = 250_000, 1 << 20
#: Pieces of one length that are ranked in one bucket, about.
BUCKET = 20_000
#: The id that ends a document.
END = 0


class _Known(dict):
    """Piece -> its number in the encoder's ragged table; unseen pieces are encoded when asked for."""

    def __init__(self, encoder: Encoder, lead: bytes):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: bytes) -> int:
        if not is_even(piece):
            raise Uneven
        self[piece] = n = self.encoder.add(self.lead + piece)
        return n


class Encoder:
    """Token ids of texts, with a cache of the tokens of pieces in one ragged array.

    Vocabulary, merges and special strings come from a file of the tokenizers library; pieces are merged by a faster
    encoder under the same ranks, and tests hold the ids equal to the library's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        of = {c: b for b, c in stand_ins().items()}
        tokens = [*stand_ins().values(), *("".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"])]
        special = {x["content"]: len(tokens) + i for i, x in enumerate(spec["added_tokens"])}
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(of[c] for c in t): i for i, t in enumerate(tokens)}, special_tokens=special)
        #: rank of a token -> its id in the file
        self.of_rank = np.array([*(vocabulary[t] for t in tokens), *(x["id"] for x in spec["added_tokens"])], np.uint32)
        self.forget()

    def forget(self) -> None:
        """Drop the cached pieces: an idle worker holds the vocabulary alone."""
        self.ids, self.starts = array("I"), array("q", [0])
        self.first, self.spaced = _Known(self, b""), _Known(self, b" ")
        self.feed, self.end = self.add(b"\n"), self._put([len(self.of_rank)])

    def _put(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        return len(self.starts) - 2

    def add(self, piece: bytes) -> int:
        text = piece.decode("utf-8", "replace")
        return self._put(self.bpe.encode(text, allowed_special="all") if any(x in piece for x in self.special) else self.bpe.encode_ordinary(text))

    def _pieces(self, text: bytes) -> list[int]:
        if not text:
            return [self.end]
        out: list[int] = []
        try:
            for line in plain_cut(text):
                out.append(self.first[line[0]])
                out.extend(map(self.spaced.__getitem__, line[1:]))
                out.append(self.feed)
            out[-1] = self.end
        except Uneven:
            out = [self.add(p) for p in careful_cut(text)] + [self.end]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids with the end id."""
        if len(self.starts) > CACHE:
            self.forget()
        pieces = [self._pieces(t) for t in texts]
        flat = np.fromiter(chain.from_iterable(pieces), np.int64, sum(map(len, pieces)))
        ids, starts = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.starts, np.int64)
        begin, size = starts[flat], starts[flat + 1] - starts[flat]
        ends = np.cumsum(size)
        out = np.append(self.of_rank, np.uint32(END))[ids[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]]
        del ids, starts
        return np.split(out, ends[np.cumsum([len(p) for p in pieces])[:-1] - 1])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(path: str, length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        try:
            for batch in slices(batches, limit=SLICE):
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(blobs(batch)), strict=True):
                    start, piece, stop = 0, 0, len(ids) % length or min(length, len(ids))
                    while start < len(ids):
                        rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].astype("<u4").tobytes())))
                        start, stop, piece = stop, stop + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            encoder.forget()

    return cut


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end id, cut only above ``length``;
    then the first piece takes the remainder and may be shorter. ``path`` is a tokenizer file of the tokenizers
    library that every executor has."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_cut(path, length), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Runs of open bins by their room: room -> [(first bin, bins)]."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((first, n))

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """Take the run with the least room for ``size``."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.rooms[at]
        return room, first, n


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (size, rank_from, rank_to, first_bin, per_bin, offset) for pieces counted by size.

    The piece of rank r in [rank_from, rank_to) goes to bin first_bin + (r - rank_from) // per_bin, after
    (r - rank_from) % per_bin others of its slot.
    """
    left, taken, bins, slots, next_bin = dict(counts), dict.fromkeys(counts, 0), _Bins(), [], 0

    def place(size: int, first: int, n: int, per_bin: int, room: int) -> None:
        many = n * per_bin
        slots.append((size, taken[size], taken[size] + many, first, per_bin, length - room))
        taken[size] += many
        left[size] -= many

    large = sorted(s for s in counts if 3 * s > length and counts[s])
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        at = bisect_left(large, min(size, length - size) + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        partner = large[at] if at >= 0 else None
        if partner is None or partner == size and left[size] < 2:
            if partner == size and at > 0:  # an odd one left over: its next smaller partner
                at -= 1
                while at >= 0 and not left[large[at]]:
                    large.pop(at)
                    at -= 1
                partner = large[at] if at >= 0 else None
            else:
                partner = None
        if partner is None:
            n = left[size]
            place(size, next_bin, n, 1, length)
            bins.put(length - size, next_bin, n)
        elif partner == size:
            n = left[size] // 2
            place(size, next_bin, n, 2, length)
            bins.put(length - 2 * size, next_bin, n)
        else:
            n = min(left[size], left[partner])
            place(size, next_bin, n, 1, length)
            place(partner, next_bin, n, 1, length - size)
            bins.put(length - size - partner, next_bin, n)
        next_bin += n
    for size in sorted((s for s in counts if 3 * s <= length), reverse=True):
        while left[size]:
            run = bins.tightest(size)
            if run is None:  # no room left: new bins, as many as the rest of this size fills
                n = -(-left[size] // (length // size))
                run = (length, next_bin, n)
                next_bin += n
            room, first, n = run
            per_bin = min(room // size, left[size])
            full = min(n, left[size] // per_bin)
            place(size, first, full, per_bin, room)
            bins.put(room - per_bin * size, first, full)
            first, n = first + full, n - full
            if n and left[size]:  # the last bin of this size takes what is left of it
                per_bin = left[size]
                place(size, first, 1, per_bin, room)
                bins.put(room - per_bin * size, first, 1)
                first, n = first + 1, n - 1
            bins.put(room, first, n)
    return slots


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` (any table with doc_id, piece, start, length, ids_crc32) plus sequence_id and offset.

    The driver sees one count for each length, at most ``length`` of them. Pieces are numbered as they are
    written and dealt by these numbers to buckets of about BUCKET pieces of one length, so that a length which a
    third of all pieces have, or a crowd of equal pieces, is ranked in many tasks.
    """
    spark = cut.sparkSession
    cut = saved(cut.withColumn("_no", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    many = F.broadcast(spark.createDataFrame([(s, -(-n // BUCKET)) for s, n in counts.items()], "length long, _many long"))
    cut = cut.join(many, "length").withColumn("_bucket", F.pmod(F.xxhash64("_no"), F.col("_many")))
    sizes = saved(cut.groupBy("length", "_bucket").agg(F.count("*").alias("n")))
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    slots = spark.createDataFrame(plan(counts, length), "length long, _from long, _to long, _bin long, _per long, _at long")
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_no")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    met = ranked.join(F.broadcast(slots), "length").filter("_rank >= _from and _rank < _to").withColumn("_k", F.col("_rank") - F.col("_from"))
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_bin") + F.expr("_k div _per")).alias("sequence_id"),
        (F.col("_at") + F.col("_k") % F.col("_per") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Every document's pieces with their sequence and place in it.

    A null or empty text is the end id alone. Repeated rows are packed each for itself. Other columns are
    not looked at; an empty table gives an empty table.
    """
    return pack(pieces(docs, length, path), length)
