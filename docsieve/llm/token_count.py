"""Token counts by rank-synchronous array merging of byte-pair sequences in ragged numpy arrays.

A batch's distinct pre-tokens lie end to end in one symbol array. In each round every sequence merges its
own lowest-ranked pair wherever that stands in it, all sequences at once; sequences without a ranked pair
leave with their symbol count. Long sequences (an unbroken text can be one) go through the same merges by rank,
but from a queue of the places of each rank, so that a round costs what it merges and not what it passes over.
Counts of pieces are cached in the worker, up to ``CACHE`` pieces and ``CACHE_BYTES`` bytes of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import blobs, slices, text_bytes
from docsieve.llm.pieces import careful_cut, is_even, plain_cut, stand_ins

#: Pieces that a worker keeps the counts of, and bytes of these pieces.
CACHE, CACHE_BYTES = 700_000, 32 << 20
#: Bytes from which a sequence is merged from the queue.
LONG = 192
LIMIT = 512
_NONE = np.iinfo(np.int32).max


class Merges:
    """Merge ranks of a byte-level tokenizer file, ready for lookup of whole arrays of symbol pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = stand_ins()
        vocabulary = spec["model"]["vocab"]
        self.of_byte = np.array([vocabulary[stand_in[b]] for b in range(256)], np.int64)
        self.width = 1 + max(vocabulary.values())
        keys, made = [], []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            keys.append(vocabulary[a] * self.width + vocabulary[b])
            made.append(vocabulary[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[order], order.astype(np.int32), np.array(made, np.int64)
        self.special = [x["content"].encode() for x in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive of each pre-token."""
        out = np.array([len(t) for t in tokens], np.int64)
        long = np.flatnonzero(out >= LONG)
        if len(long):
            short = np.flatnonzero(out < LONG)
            out[long] = self._queued([tokens[i] for i in long])
            out[short] = self.lengths([tokens[i] for i in short])
            return out
        if not len(out):
            return out
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), out)
        while len(symbols) > 1:
            rank = self.rank(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = _NONE
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(np.append(rank, _NONE), first)
            goes = (rank == np.repeat(least, size)[:-1]) & (rank != _NONE)
            # of pairs that overlap (a symbol's run), every second one from the left
            at = np.arange(len(goes))
            begin = np.maximum.accumulate(np.where(goes & ~np.concatenate(([False], goes[:-1])), at, 0))
            goes &= (at - begin) % 2 == 0
            where = np.flatnonzero(goes)
            symbols[where] = self.made[rank[where]]
            left = np.ones(len(symbols), bool)
            left[where + 1] = False
            ended = least == _NONE
            out[owner[first[ended]]] = size[ended]
            left &= ~np.repeat(ended, size)
            symbols, owner = symbols[left], owner[left]
        if len(symbols):
            out[owner[0]] = 1
        return out


    def _queued(self, tokens: list[bytes]) -> np.ndarray:
        """``lengths`` of long pre-tokens: the places of each rank wait in a queue by rank."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        n = int(sizes.sum())
        symbols = np.append(self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)], 0)
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[np.append(start[1:], n) - 1] = n  # place n stands behind every last symbol
        before[start] = -1
        lives, ranks = np.ones(n + 1, bool), np.full(n + 1, _NONE, np.int32)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            right = after[at]
            ranks[at] = np.where(right < n, self.rank(symbols[at], symbols[right]), _NONE)
            at = at[ranks[at] != _NONE]
            at = at[np.argsort(ranks[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(ranks[at])) + 1
            for group in np.split(at, cuts) if len(at) else []:
                rank = int(ranks[group[0]])
                if rank not in places:
                    places[rank] = []
                    heappush(queue, rank)
                places[rank].append(group)

        put(np.arange(n))
        heapify(queue)
        while queue:
            rank = heappop(queue)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[lives[at] & (ranks[at] == rank)]
            if not len(at):
                continue
            # of pairs that overlap (a symbol's run), every second one from the left
            k = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.concatenate(([True], at[1:] != after[at[:-1]])), k, 0))
            at = at[(k - begin) % 2 == 0]
            right = after[at]
            symbols[at], lives[right], ranks[right] = self.made[rank], False, _NONE
            after[at] = after[right]
            before[after[at]] = at
            left = before[at]
            put(np.union1d(at, left[left >= 0]))
        return np.add.reduceat(lives[:n].astype(np.int64), start)


@lru_cache(maxsize=4)
def _merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Token counts of texts for one tokenizer file."""

    def __init__(self, path: str):
        self.merges = _merges(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(regex.escape(x.decode()) for x in self.merges.special) or r"(?!)")
        self.first: dict[bytes, int] = {}
        self.spaced: dict[bytes, int] = {}
        self.held = 0

    def _learn(self, pieces: list[bytes], into: dict[bytes, int], keys: list[bytes]) -> None:
        place: dict[bytes, int] = {}
        of_piece: list[list[int]] = []
        extra = np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            text = piece.decode("utf-8", "replace")
            parts = self.special.split(text)
            extra[i] = len(parts) - 1
            of_piece.append([place.setdefault(t.encode(), len(place)) for part in parts for t in self.pattern.findall(part)])
        n = self.merges.lengths(list(place))
        for i, key in enumerate(keys):
            into[key] = int(extra[i] + sum(n[j] for j in of_piece[i]))
            self.held += len(key)

    def counts(self, texts: list[bytes]) -> list[int]:
        if len(self.first) + len(self.spaced) > CACHE or self.held > CACHE_BYTES:
            self.first.clear()
            self.spaced.clear()
            self.held = 0
        first, spaced, cuts = set(), set(), []
        for text in texts:
            lines = plain_cut(text)
            for line in lines:
                first.add(line[0])
                spaced.update(line[1:])
            cuts.append(lines)
        new = [p for p in first if p not in self.first and is_even(p)]
        self._learn(new, self.first, new)
        new = [p for p in spaced if p not in self.spaced and is_even(p)]
        self._learn([b" " + p for p in new], self.spaced, new)
        out: list[int] = []
        uneven: list[int] = []
        for i, lines in enumerate(cuts):
            try:
                n = len(lines) - 1
                for line in lines:
                    n += self.first[line[0]]
                    if len(line) > 1:
                        n += sum(map(self.spaced.__getitem__, line[1:]))
                out.append(n)
            except KeyError:
                out.append(0)
                uneven.append(i)
        if uneven:
            careful = {i: careful_cut(texts[i]) for i in uneven if texts[i]}
            known: dict[bytes, int] = {}
            new = list({p for cut in careful.values() for p in cut})
            self._learn(new, known, new)
            for i, cut in careful.items():
                out[i] = sum(map(known.__getitem__, cut))
        return out


def _count(path: str, limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches):
            texts = blobs(batch)
            n = np.array(counter.counts(texts), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """One counter a worker process: its cache serves the later tasks too."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` is a byte-level BPE tokenizer file that every executor has. Null and empty texts have no
    tokens; repeated rows are counted alike; other columns are not looked at; an empty table gives an empty table.
    A text of one unbroken run, however long, takes time in proportion to its length, about.
    """
    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_count(path or public_tokenizers.path("byte_bpe_50k.json"), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
