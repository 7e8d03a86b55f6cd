"""Alignment of two tokenizers over a corpus: groups, links, and how well each link is supported.

Tokens of side A and side B cover the same bytes, so every byte at which a token of either side ends marks one link:
the A token and the B token that hold it. Bytes at which both end cut the text into groups. Texts are cut before
single spaces and line feeds between other characters, where both tokenizers end a token whatever stands around;
the ids, groups and links of such a piece are worked out once and kept for a while.

How many documents hold an (A, B) pair linked is counted in dense matrices, one for each stripe of A ids
(``id % STRIPES``, which deals frequent ids out evenly): partial counts of the pairs are partitioned by stripe and added
into the stripe's block with ``np.add.at``, and the maxima of its rows tell each A id's best partners. The links, kept
as compressed blocks of one stripe and one slice of documents, are partitioned like the matrices and scored
beside them; a stripe whose links are many is dealt out to several tasks, each with a copy of its matrix.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsieve.llm.common import blobs, cuts, release, saved, slices, text_bytes
from docsieve.llm.pieces import stand_ins

#: Stripes of A ids. A block has (A ids / STRIPES) x (B ids) cells of 8 bytes, 25 MB for 50,000 and 32,000 ids.
STRIPES = 512
#: Bytes of compressed links of one stripe that one task scores, about.
SCORED_BYTES = 32 << 20
#: Bytes of text whose links are one slice, and rows: a row's number in its slice must fit 16 bits.
SLICE, SLICE_ROWS = 4 << 20, 1 << 16
#: Bytes of text that a task aligns at once, and pieces that it gives to the tokenizers at once: what these return for a
#: piece is many times as large.
ALIGNED, SETTLED = 512 << 10, 1 << 13
#: Pieces, and bytes of them, that a worker keeps.
KEPT, KEPT_BYTES = 400_000, 32 << 20
#: Cells of partial counts that a task holds before it sends them on.
HELD = 4 << 20

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class Uneven(Exception):
    """A word that is empty or has white space at an end, which the plain cut must not make."""


class _Known(dict):
    """Word -> the number of its piece; a word not seen before gets the next number and waits for its ids."""

    def __init__(self, table: Aligner, lead: str):
        self.table, self.lead = table, lead

    def __missing__(self, word: str) -> int:
        if self.lead and (not word or word[0].isspace() or word[-1].isspace()):
            raise Uneven
        self[word] = n = self.table.wait(self.lead + word)
        return n


def ragged(values: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i]:starts[i + 1]]`` of all ``i`` in ``at``, one behind the other."""
    begin, size = starts[at], starts[at + 1] - starts[at]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begin - ends + size, size)]


class Aligner:
    """Ids, groups and links of texts under two tokenizer files: A of the tokenizers library with a byte-level
    vocabulary, B of sentencepiece."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = {c: b for b, c in stand_ins().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.shown = [str(i) for i in range(max(len(self.a_bytes), n))]
        self.forget()

    def forget(self) -> None:
        """Drop the pieces kept: an idle worker holds the vocabularies alone."""
        self.spaced, self.fed, self.whole = _Known(self, " "), _Known(self, "\n"), _Known(self, "")
        self.waiting: list[str] = []
        self.groups: list[str | None] = []
        #: A tokens, B tokens and groups of each piece; -1 A tokens: the ids of a side do not give the piece
        self.sizes = array("q")
        self.cells, self.starts, self.bytes = array("q"), array("q", [0]), 0

    def wait(self, piece: str) -> int:
        self.waiting.append(piece)
        return len(self.groups) + len(self.waiting) - 1

    def _numbers(self, text: str) -> list[int]:
        """The numbers of the pieces of a space and the text."""
        try:
            lines = text.split("\n")
            out = list(map(self.spaced.__getitem__, lines[0].split(" ")))
            for line in lines[1:]:
                first, *rest = line.split(" ")
                out.append(self.fed[first])
                out.extend(map(self.spaced.__getitem__, rest))
            return out
        except Uneven:
            return [self.whole[p] for p in _CUT.split(" " + text)]

    def _settle(self) -> None:
        """Work out the pieces that wait."""
        while pieces := self.waiting[:SETTLED]:
            self._work_out(pieces)
            del self.waiting[:SETTLED]

    def _work_out(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)  # B puts a space before all
        b = [x if p[0] == " " else x[1:] for p, x in zip(pieces, b, strict=True)]
        take_a, take_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = [b"".join(map(take_a, x)) == r == b"".join(map(take_b, y)) for x, y, r in zip(a, b, raw, strict=True)]
        ids_a = np.fromiter(chain.from_iterable(x for x, g in zip(a, good, strict=True) if g), np.int64)
        ids_b = np.fromiter(chain.from_iterable(x for x, g in zip(b, good, strict=True) if g), np.int64)
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        marks = np.union1d(ends_a, ends_b)
        cells = ids_a[np.searchsorted(ends_a, marks)] * len(self.b_bytes) + ids_b[np.searchsorted(ends_b, marks)]
        piece_ends = np.cumsum([len(r) if g else 0 for r, g in zip(raw, good, strict=True)])
        links = np.searchsorted(marks, piece_ends, side="right")
        until = np.searchsorted(both, piece_ends, side="right").tolist()
        cut_a, cut_b = (np.searchsorted(both_of, both, side="right").tolist() for both_of in (ends_a, ends_b))
        shown = self.shown
        text_a, text_b = [shown[i] for i in ids_a.tolist()], [shown[i] for i in ids_b.tolist()]
        at = from_a = from_b = 0
        for x, y, g, stop in zip(a, b, good, until, strict=True):
            if not g:
                self.groups.append(None)
                self.sizes.extend((-1, 0, 0))
                continue
            parts = []
            for k in range(at, stop):
                parts.append(",".join(text_a[from_a : cut_a[k]]) + "|" + ",".join(text_b[from_b : cut_b[k]]))
                from_a, from_b = cut_a[k], cut_b[k]
            self.groups.append(";".join(parts))
            self.sizes.extend((len(x), len(y), stop - at))
            at = stop
        base = self.starts[-1]
        self.cells.frombytes(cells.astype(np.int64).tobytes())
        self.starts.frombytes((links + base).astype(np.int64).tobytes())
        self.bytes += sum(map(len, raw))

    def align(self, texts: list[bytes]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray]:
        """(A tokens, B tokens, groups, links, the groups' text) of each text, and all links: numbers of texts and cells
        ``a * (B ids) + b``. A text that is empty, or that a side's tokens do not give back, has zeros and no links."""
        if len(self.groups) > KEPT or self.bytes > KEPT_BYTES:
            self.forget()
        clean = [t.decode("utf-8", "replace") for t in texts]
        # a text that is not UTF-8 is not what its tokens give back
        numbers = [self._numbers(c) if t and ("�" not in c or c.encode() == t) else [] for t, c in zip(texts, clean, strict=True)]
        self._settle()
        sizes = np.frombuffer(self.sizes, np.int64).reshape(-1, 3)
        odd = [i for i, n in enumerate(numbers) if n and (sizes[n, 0] < 0).any()]
        del sizes
        for i in odd:  # no piece by piece: as a whole
            numbers[i] = [self.whole[" " + clean[i]]]
        self._settle()
        sizes = np.frombuffer(self.sizes, np.int64).reshape(-1, 3)
        for i in odd:
            if sizes[numbers[i][0], 0] < 0:
                numbers[i] = []
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, sum(map(len, numbers)))
        text_of = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        starts, cells = np.frombuffer(self.starts, np.int64), np.frombuffer(self.cells, np.int64)
        per = np.zeros((len(texts), 4), np.int64)
        np.add.at(per[:, :3], text_of, sizes[flat])
        many = (starts[flat + 1] - starts[flat]) if len(flat) else np.empty(0, np.int64)
        np.add.at(per[:, 3], text_of, many)
        out = ragged(cells, starts, flat) if len(flat) else np.empty(0, np.int64)
        del sizes, starts, cells
        groups = [";".join(map(self.groups.__getitem__, n)) for n in numbers]
        return [(*p, g) for p, g in zip(per.tolist(), groups, strict=True)], np.repeat(text_of, many), out


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, whatever the machine has
    return Aligner(a_path, b_path)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, each in the least whole number type that holds it."""
    body, head = [], []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        head.append((kind.str, len(x)))
        body.append(x.astype(kind).tobytes())
    top = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(top).to_bytes(4, "little") + top + b"".join(body))


def _unpacked(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    return out


_ALIGNED = "doc_id long, slice long, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, block binary"
_NAMES = [x.split()[0] for x in _ALIGNED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary()]
_STEP = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _align(a_path: str, b_path: str, stripes: int) -> _STEP:
    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        wide = len(aligner.b_bytes)
        try:
            for batch in (x.slice(i, SLICE_ROWS) for x in slices(batches, limit=SLICE) for i in range(0, x.num_rows, SLICE_ROWS)):
                rows, links, cells = [], [], []
                for part in cuts(batch, limit=ALIGNED):
                    texts, owner, found = aligner.align(blobs(part))
                    links.append(owner + len(rows))
                    cells.append(found)
                    ids = part.column("doc_id").to_pylist()
                    rows += [(d, number, i, *t[:4], hashlib.sha256(t[4].encode()).hexdigest() if t[0] else "", None, None) for i, (d, t) in enumerate(zip(ids, texts, strict=True), len(rows))]
                    del texts
                yield _rows(_NAMES, _TYPES, rows)
                links, cells = np.concatenate(links), np.concatenate(cells)
                a, b = np.divmod(cells, wide)
                high = -(-len(aligner.a_bytes) // stripes) * wide
                keys, times = np.unique((((a % stripes) * high + a // stripes * wide + b) << 16) | links, return_counts=True)
                stripe, cell = np.divmod(keys >> 16, high)
                bounds = np.searchsorted(stripe, np.arange(stripes + 1))
                out = []
                for s in np.flatnonzero(np.diff(bounds)):
                    part = slice(bounds[s], bounds[s + 1])
                    first = np.flatnonzero(np.diff(cell[part], prepend=-1))
                    runs = np.diff(first, append=bounds[s + 1] - bounds[s])
                    out.append((None, number, *[None] * 6, int(s), _packed(np.diff(cell[part][first], prepend=0), runs, keys[part] & 0xFFFF, times[part] - 1)))
                if out:
                    yield _rows(_NAMES, _TYPES, out)
                number += 1
        finally:
            aligner.forget()
            release()

    return align


def _partial_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stripe, block of cells and counts) of the links that a task reads."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        for s, parts in held.items():
            cells, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.zeros(len(cells), np.int64)
            np.add.at(counts, back, np.concatenate([p[1] for p in parts]))
            yield _rows(["stripe", "block"], [pa.int32(), pa.binary()], [(s, _packed(np.diff(cells, prepend=0), counts))])

    for batch in batches:
        for s, block in zip(batch.column("stripe").to_pylist(), batch.column("block").to_pylist(), strict=True):
            steps, runs, _, _ = _unpacked(block)
            held.setdefault(s, []).append((np.cumsum(steps), runs))
            n += len(runs)
            if n > HELD:
                yield from out()
                held, n = {}, 0
    yield from out()


def _matrices(ids: int, wide: int) -> _STEP:
    """Rows sorted by stripe, partial counts -> (stripe, block of the cells that are not zero and their counts)."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = np.zeros(ids * wide, np.int64), None

        def out() -> Iterator[pa.RecordBatch]:
            cells = np.flatnonzero(block)
            yield _rows(["stripe", "block"], [pa.int32(), pa.binary()], [(now, _packed(np.diff(cells, prepend=0), block[cells]))])
            block[cells] = 0

        for batch in batches:
            for s, part in zip(batch.column("stripe").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if s != now and now is not None:
                    yield from out()
                now = s
                steps, counts = _unpacked(part)
                np.add.at(block, np.cumsum(steps), counts)
        if now is not None:
            yield from out()

    return add


def _score(ids: int, wide: int) -> _STEP:
    """Rows sorted by stripe, its matrix first -> (slice, block of documents, best links and sums of counts)."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, filled = np.zeros(ids * wide, np.int64), None, np.empty(0, np.int64)
        for batch in batches:
            rows = []
            for number, part in zip(batch.column("slice").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if number is None:
                    block[filled] = 0
                    steps, counts = _unpacked(part)
                    filled = np.cumsum(steps)
                    block[filled] = counts
                    best = block.reshape(ids, wide).max(axis=1)
                    continue
                steps, runs, docs, more = _unpacked(part)
                cells = np.cumsum(steps)
                count = block[cells]
                top = count == best[cells // wide]
                times = more + 1
                who, back = np.unique(docs, return_inverse=True)
                n_best, sums = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
                np.add.at(n_best, back, times * np.repeat(top, runs))
                np.add.at(sums, back, times * np.repeat(count, runs))
                rows.append((number, _packed(np.diff(who, prepend=0), n_best, sums)))
            if rows:
                yield _rows(["slice", "block"], [pa.int64(), pa.binary()], rows)

    return score


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice -> (slice, at, n_best, count_sum) of its documents."""
    total, now = np.zeros((SLICE_ROWS, 2), np.int64), None

    def out() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), *(pa.array(total[at, i].copy()) for i in (0, 1))], ["slice", "at", "n_best", "count_sum"])
        total[at] = 0

    for batch in batches:
        for number, block in zip(batch.column("slice").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if number != now and now is not None:
                yield from out()
            now = number
            steps, n_best, sums = _unpacked(block)
            at = np.cumsum(steps)
            np.add.at(total[:, 0], at, n_best)
            np.add.at(total[:, 1], at, sums)
    if now is not None:
        yield from out()


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, stripes: int = STRIPES, scored_bytes: int = SCORED_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows of ``docs`` that hold it linked; n_best is the number of links whose count is
    the highest of their A id, ties included, and count_sum the sum of the counts of all links. Texts that are null or
    empty, or that the tokens of a side do not give back byte by byte, have zeros and an empty digest. Texts of any
    length are aligned as a whole; repeated rows, and rows without a doc_id, count one by one; other columns are not
    looked at; an empty table gives an empty table. Files: A of the tokenizers library, B of sentencepiece.
    """
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    texts = text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    aligned = saved(texts.mapInArrow(_align(a_path, b_path, stripes), _ALIGNED))
    links = aligned.filter("stripe is not null").select("stripe", "slice", "block")
    wide, high = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size(), Tokenizer.from_file(a_path).get_vocab_size()
    ids = -(-high // stripes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partial = links.select("stripe", "block").mapInArrow(_partial_counts, "stripe int, block binary")
    matrices = saved(partial.repartition(min(parts, stripes), "stripe").sortWithinPartitions("stripe").mapInArrow(_matrices(ids, wide), "stripe int, block binary"))
    # one row for each stripe: how many tasks share its links
    shares = F.broadcast(links.groupBy("stripe").agg(F.ceil(F.sum(F.octet_length("block")) / scored_bytes).cast("int").alias("shares")))
    with_copies = matrices.join(shares, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("slice"), "block")
    dealt = links.join(shares, "stripe").select("stripe", F.pmod(F.xxhash64("slice"), F.col("shares")).cast("int").alias("share"), "slice", "block")
    scored = with_copies.unionByName(dealt).repartition(parts, "stripe", "share").sortWithinPartitions("stripe", "share", F.col("slice").asc_nulls_first()).mapInArrow(_score(ids, wide), "slice long, block binary")
    sums = scored.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_sums, "slice long, at int, n_best long, count_sum long")
    rows = aligned.filter("stripe is null").drop("stripe", "block")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(sums, ["slice", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
