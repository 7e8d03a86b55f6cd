"""Class-based n-gram scoring: exchange clustering of words, class transitions, word emissions.

Counts cover every training token, and every word of the vocabulary gets a class by the words beside it.
Training texts are written once as short unit numbers: the most frequent words are units of their own, any other
word is written as the unit of its ending and its hash. Units are clustered by exchange: the most frequent of
them on the driver from their own bounded bigram matrix, then all of them in rounds, in each of which every
unit's counts of left and right classes are gathered from the whole corpus and half of the units choose at
once. Then each of the other words, however many, leaves the unit of its ending and takes the class that its own
left and right class counts fit best: its contexts are gathered by word, and no key is larger than those of the
least frequent unit. Words that training has not seen take the class of their ending's unit.

Scoring broadcasts the head's classes and counts; the other words of each document meet the vocabulary in a
join, and the transitions next to them are added up after it.

Probabilities sum to one: in each class an absolute discount of its words' counts is left for words that
training has not seen, and transitions are smoothed towards the classes' own shares.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.common import blobs, crc_mod, forget, saved, slices, text_bytes

#: Words and endings that are units of their own at most (the most frequent), buckets for the rest, and classes.
WORD_UNITS, ENDING_UNITS, BUCKETS, CLASSES = 32_000, 4_096, 64, 48
#: Units that are clustered first, one by one, at most.
SEEDS = 512
#: Words whose counts are broadcast for scoring, at most (the most frequent).
HEAD = 150_000
#: Bytes of text that scoring handles at once: it holds a score of arrays of the words.
SCORED = 1 << 20
#: Bytes of a word's ending.
ENDING = 3
#: Rounds of exchange, and the weight of the classes' own shares in a transition.
ROUNDS, SMOOTH = 4, 5.0
#: Distinct words that a task holds before it passes their counts on, and tail words that it sorts at once.
FLUSH, SORTED = 300_000, 2_000_000
#: Units whose counts are one row.
BLOCK = 512
UNITS = WORD_UNITS + ENDING_UNITS + BUCKETS
END_ID, START_ID = UNITS, UNITS + 1
START = CLASSES + 1
#: Classes with the end and the start of a text, the cell of a unit's pairs with itself, and the cells of a unit.
WIDE = CLASSES + 2
SELF = 2 * WIDE
CELLS = SELF + 1
#: Rows of ``gathered`` that hold class pairs: of all neighbours, and of those that are words of their own.
ALL_PAIRS, WORD_PAIRS = -1, -2


def unit_of(word: bytes, units: dict[bytes, int], endings: dict[bytes, int]) -> int:
    """The word's unit: its own, that of its ending, or its ending's bucket."""
    unit = units.get(word)
    if unit is None:
        unit = endings.get(word[-ENDING:])
    return WORD_UNITS + ENDING_UNITS + zlib.crc32(word[-ENDING:]) % BUCKETS if unit is None else unit


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for text in blobs(batch):
            counts.update(text.lower().split())
        if len(counts) > FLUSH:
            yield out()
            counts.clear()
    yield out()


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, n): the counts of all words of the training texts, lower-cased in A-Z."""
    return text_bytes(training).mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Places(dict):
    """Word -> its unit, or for other words -1 - k where ``hashes`` and ``units`` have the word's at k."""

    def __init__(self, words: dict[bytes, int], endings: dict[bytes, int]):
        self.words, self.endings = words, endings
        self.hashes, self.units = array("Q"), array("H")

    def __missing__(self, word: bytes) -> int:
        place = self.words.get(word)
        if place is None:
            place = -1 - len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(word, 42))  # as the SQL function xxhash64 has it
            unit = self.endings.get(word[-ENDING:])
            self.units.append(unit_of(word, {}, {}) if unit is None else unit)
        self[word] = place
        return place


def _encode(words: dict[bytes, int], endings: dict[bytes, int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (ids, tails): the units of a run of texts with START_ID and END_ID around each, and the hashes of the
    words that are no units, in order."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Places(words, endings)
        first, last = np.array([START_ID]), np.array([END_ID])
        for batch in slices(batches):
            parts = []
            for text in blobs(batch):
                own = text.lower().split()
                parts += [first, np.fromiter(map(known.__getitem__, own), np.int64, len(own)), last]
            ids = np.concatenate(parts)
            at = np.flatnonzero(ids < 0)
            place = -1 - ids[at]
            hashes, units = np.array(known.hashes, np.uint64), np.array(known.units, np.int64)
            ids[at] = units[place]
            yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.uint16).tobytes()], pa.binary()), pa.array([hashes[place].tobytes()], pa.binary())], ["ids", "tails"])
            if len(known) > FLUSH:
                known = _Places(words, endings)

    return encode


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 6) -> np.ndarray:
    """Class of each unit: units move, one by one, to the class that raises the likelihood of the bigrams most.

    Units start dealt out by frequency. The likelihood of class bigrams is the sum of n log n over class pairs
    less that over the classes as left and as right sides. Bounded by rounds; stops when nothing moves.
    """
    n = bigrams.astype(float)
    many = len(n)
    order = np.argsort(-(n.sum(0) + n.sum(1)), kind="stable")
    of = np.zeros(many, np.int64)
    of[order] = np.arange(many) % classes
    one = np.eye(classes)[of]
    pairs = one.T @ n @ one
    left, right = pairs.sum(1), pairs.sum(0)
    for _ in range(rounds):
        moved = 0
        for u in order:
            out_, in_, self_ = np.bincount(of, n[u], classes), np.bincount(of, n[:, u], classes), n[u, u]
            if not out_.any() and not in_.any():
                continue
            c = of[u]
            out_[c] -= self_
            in_[c] -= self_
            pairs[c] -= out_
            pairs[:, c] -= in_
            pairs[c, c] -= self_
            left[c] -= out_.sum() + self_
            right[c] -= in_.sum() + self_
            # joining class k adds out_ to its row, in_ to its column, and both with self_ where these cross
            gain = (_g(pairs + out_[None, :]) - _g(pairs)).sum(1) + (_g(pairs + in_[:, None]) - _g(pairs)).sum(0)
            d = np.diag(pairs)
            gain += _g(d + out_ + in_ + self_) - _g(d + out_) - _g(d + in_) + _g(d)
            gain -= _g(left + out_.sum() + self_) - _g(left) + _g(right + in_.sum() + self_) - _g(right)
            k = int(gain.argmax()) if gain.max() > gain[c] + 1e-9 else c
            of[u] = k
            moved += k != c
            pairs[k] += out_
            pairs[:, k] += in_
            pairs[k, k] += self_
            left[k] += out_.sum() + self_
            right[k] += in_.sum() + self_
        if not moved:
            break
    return of


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def choose(pairs: np.ndarray, of: np.ndarray | None, word: np.ndarray, cell: np.ndarray, n: np.ndarray, many: int) -> np.ndarray:
    """The best class of each of ``many`` words, all other words staying where they are.

    word, cell and n are their counts: cell k of classes to the right, WIDE + k of classes to the left, SELF of
    the word beside itself. A class is judged by what the word's counts add to the likelihood there, each cell of
    ``pairs`` by itself; in its own class (``of``, None for words that are in no class yet) by what they add to
    the rest of it.
    """
    key, place = np.unique(word * CELLS + cell, return_inverse=True)
    n = np.bincount(place, n, len(key))
    word, cell = key // CELLS, key % CELLS
    # row c of at: the cells of pairs that a word of class c has its counts in
    at = np.concatenate((pairs[:CLASSES], pairs[:, :CLASSES].T, np.diag(pairs)[:CLASSES, None]), 1)
    gain = np.zeros((many, CLASSES))
    for start in range(0, len(key), 1 << 15):
        part = slice(start, start + (1 << 15))
        w, j, m = word[part], cell[part], n[part]
        base = at[:, j].T
        if of is not None:
            own = np.arange(len(w)), of[w]
            base[own] = np.maximum(base[own] - m, 0)
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(_g(base + m[:, None]) - _g(base), first, axis=0)
    one = np.arange(many), of
    for total, drop in ((pairs.sum(1), (cell >= WIDE) & (cell < SELF)), (pairs.sum(0), cell < WIDE)):
        mass = np.bincount(word, np.where(drop, 0, n), many)
        base = np.repeat(total[None, :CLASSES], many, 0)
        if of is not None:
            base[one] = np.maximum(base[one] - mass, 0)
        gain -= _g(base + mass[:, None]) - _g(base)
    gain = np.round(gain, 6)
    best = gain.argmax(1)
    return best if of is None else np.where(gain[one] < gain[np.arange(many), best], best, of)


def _ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for blob in batch.column("ids").to_pylist():
        yield np.frombuffer(blob, np.uint16).astype(np.int64)


def _seed_bigrams(place: np.ndarray, many: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pair, n): bigrams of the seeds, whose places in the matrix are given by unit (-1 for other units)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many * many, np.int64)
        for batch in batches:
            for ids in _ids_of(batch):
                a, b = place[ids[:-1]], place[ids[1:]]
                near = (a >= 0) & (b >= 0)
                total += np.bincount(a[near] * many + b[near], minlength=many * many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return count


def _cells(of: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, cells): the counts by cell of all units, a row for BLOCK of them, and two rows of class pairs.
    Neighbours without a class (-1) are left out."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs, words = np.zeros(UNITS * CELLS, np.int64), np.zeros(WIDE * WIDE, np.int64), np.zeros(WIDE * WIDE, np.int64)
        for batch in batches:
            for ids in _ids_of(batch):
                a, b = ids[:-1], ids[1:]
                inside = a != END_ID
                a, b = a[inside], b[inside]
                left, right = of[a], of[b]
                known = right >= 0
                near = known & (a < UNITS)
                # added in place: a run of texts touches few of the cells
                np.add.at(total, a[near] * CELLS + np.where(a == b, SELF, right)[near], 1)
                near = (left >= 0) & (b < UNITS) & (a != b)
                np.add.at(total, b[near] * CELLS + WIDE + left[near], 1)
                near = (left >= 0) & known
                pair = left * WIDE + right
                pairs += np.bincount(pair[near], minlength=len(pairs))
                near &= ~_is_tail(a) & ~_is_tail(b)
                words += np.bincount(pair[near], minlength=len(words))
        rows = [(ALL_PAIRS, pairs), (WORD_PAIRS, words)]
        rows += [(i // (BLOCK * CELLS), total[i : i + BLOCK * CELLS]) for i in range(0, len(total), BLOCK * CELLS)]
        rows = [(i, _packed(x)) for i, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "cells"])

    return count


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed behind that number of bytes."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


def _is_tail(ids: np.ndarray) -> np.ndarray:
    return (ids >= WORD_UNITS) & (ids < UNITS)


def _add_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of each block, which come one after another."""
    at, total = None, np.zeros(0, np.int64)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_packed(total)], pa.binary())], ["block", "cells"])
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
            cells = _unpacked(blob.as_py())
            if block == at:
                total = total + cells
            else:
                if at is not None:
                    yield row()
                at, total = block, cells
    if at is not None:
        yield row()


def gathered(encoded: DataFrame, of: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written counts of all units under the classes ``of``, and their two matrices of class pairs."""
    out = saved(encoded.select("ids").mapInArrow(_cells(of), "block int, cells binary").repartition("block").sortWithinPartitions("block").mapInArrow(_add_blocks, "block int, cells binary"))
    found = {r["block"]: _unpacked(r["cells"]).reshape(WIDE, WIDE) for r in out.filter("block < 0").collect()}  # two rows
    none = np.zeros((WIDE, WIDE), np.int64)
    return out, found.get(ALL_PAIRS, none), found.get(WORD_PAIRS, none)


def _chooser(pairs: np.ndarray, of: np.ndarray, share: int, turn: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(unit, cls) of the units that move: those in no class yet, or those whose turn it is."""

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                cells = _unpacked(blob).reshape(-1, CELLS)
                units = block * BLOCK + np.arange(len(cells))
                own = of[units]
                if share:
                    cells = np.where((_spread(units) % share == turn)[:, None], cells, 0)
                else:
                    cells = np.where((own < 0)[:, None], cells, 0)
                word, cell = np.nonzero(cells)
                found = choose(pairs, own if share else None, word, cell, cells[word, cell].astype(float), len(cells))
                moved = np.flatnonzero(cells.any(axis=1) & (found != own))
                yield pa.RecordBatch.from_arrays([pa.array(units[moved].astype(np.int32)), pa.array(found[moved].astype(np.int32))], ["unit", "cls"])

    return move


def _spread(units: np.ndarray) -> np.ndarray:
    return (units * 2654435761 & 0xFFFFFFFF) >> 9


def likelihood(pairs: np.ndarray) -> float:
    return float(_g(pairs).sum() - _g(pairs.sum(1)).sum() - _g(pairs.sum(0)).sum())


def cluster(encoded: DataFrame, frequency: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all units (and of START_ID and END_ID), with the two matrices of class pairs under them.

    ``frequency`` has the units' counts. A round that lowers the likelihood is taken back, and the share of the
    units that moves at once is halved; the classes returned are those of the greatest likelihood.
    """
    seeds = np.argsort(-frequency, kind="stable")[:SEEDS]
    seeds = seeds[frequency[seeds] > 0]
    place = np.full(UNITS + 2, -1)
    place[seeds] = np.arange(len(seeds))
    flat = np.zeros(len(seeds) ** 2)
    if len(seeds):
        found = encoded.select("ids").mapInArrow(_seed_bigrams(place, len(seeds)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # SEEDS * SEEDS at most
        flat[found["pair"].to_numpy()] = found["n"].to_numpy()
    of = np.full(UNITS + 2, -1)
    of[seeds] = exchange(flat.reshape(len(seeds), -1), CLASSES) if len(seeds) else 0
    of[[END_ID, START_ID]] = CLASSES, START
    cells, pairs, words = gathered(encoded, of)

    def moved(share: int, turn: int) -> np.ndarray:
        out = of.copy()
        found = cells.filter("block >= 0").mapInArrow(_chooser(pairs, of, share, turn), "unit int, cls int").toArrow()  # UNITS at most
        out[found["unit"].to_numpy()] = found["cls"].to_numpy()
        return out

    of = moved(0, 0)
    of[of < 0] = 0  # units that nothing stands beside
    forget(cells)
    best, share = None, 2
    for at in range(rounds + 1):
        cells, pairs, words = gathered(encoded, of)
        value = likelihood(pairs)
        if best is None or value > best[0]:
            if best is not None:
                forget(best[2])
            best = value, of, cells, pairs, words
        else:
            forget(cells)
            if value == best[0]:
                break
            share *= 2
            _, of, cells, pairs, words = best
        if at < rounds:
            of = moved(share, at % share)
    forget(best[2])
    return best[1], best[3], best[4]


#: Codes of a tail word's neighbours: its left class, + WIDE if the neighbour is a tail word too; 2 * WIDE more on the right.
CODES = 4 * WIDE


def _contexts(of: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(w, codes): the neighbours' codes of each word that is no unit, two bytes an occurrence."""

    def out(hashes: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        w, code = np.concatenate(hashes), np.concatenate(codes)
        order = np.argsort(w, kind="stable")
        w, code = w[order], code[order]
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        ends = np.append(first, len(w)).astype(np.int32) * 2
        lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(code.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(w[first]), lists], ["w", "codes"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, codes, held = [], [], 0
        for batch in batches:
            for ids, tails in zip(_ids_of(batch), batch.column("tails").to_pylist(), strict=True):
                tail = _is_tail(ids)
                code = of[ids] + WIDE * tail
                at = np.flatnonzero(tail)
                if len(at):
                    hashes.append(np.frombuffer(tails, np.int64))
                    codes.append(np.stack((code[at - 1], code[at + 1] + 2 * WIDE), 1).astype(np.uint8))
                    held += len(at)
                if held > SORTED:
                    yield out(hashes, codes)
                    hashes, codes, held = [], [], 0
        if held:
            yield out(hashes, codes)

    return gather


def _place_tail(pairs: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (w, cls) of words whose contexts come one after another, and (null, cls, right, n): the class pairs
    that they make with neighbours that are units of their own."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDE * WIDE, np.int64)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def settle(words: np.ndarray, owner: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cls = choose(pairs, None, owner, np.where(code < 2 * WIDE, WIDE, 0) + code % WIDE, n.astype(float), len(words))
            own, other, real = cls[owner], code % WIDE, code // WIDE % 2 == 0
            pair = np.where(code < 2 * WIDE, other * WIDE + own, own * WIDE + other)
            np.add(total, np.bincount(pair[real], n[real], len(total)).astype(np.int64), out=total)
            none = pa.nulls(len(words), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(cls.astype(np.int32)), none, pa.nulls(len(words), pa.int64())], ["w", "cls", "right", "n"])

        for batch in batches:
            w = batch.column("w").to_numpy()
            lists = batch.column("codes")
            sizes = pa.compute.binary_length(lists).to_numpy()
            owner = np.concatenate((held[0], np.repeat(w, sizes)))
            codes = np.frombuffer(b"".join(lists.to_pylist()), np.uint8).astype(np.int64)
            codes, n = np.concatenate((held[1], codes)), np.concatenate((held[2], np.ones(len(codes), np.int64)))
            words, owner = np.unique(owner, return_inverse=True)
            key, again = np.unique(owner * CODES + codes, return_inverse=True)
            n = np.bincount(again, n, len(key)).astype(np.int64)
            owner, codes = key // CODES, key % CODES
            # the last word may go on in the next batch
            last = owner == len(words) - 1 if w[-1] == words[-1] else owner == np.searchsorted(words, w[-1])
            held = words[owner[last]], codes[last], n[last]
            rest = np.delete(np.arange(len(words)), np.searchsorted(words, w[-1]))
            if len(rest):
                yield settle(words[rest], np.searchsorted(rest, owner[~last]), codes[~last], n[~last])
        if len(held[0]):
            yield settle(held[0][:1], np.zeros(len(held[0]), np.int64), held[1], held[2])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array((at // WIDE).astype(np.int32)), pa.array((at % WIDE).astype(np.int32)), pa.array(total[at])], ["w", "cls", "right", "n"])

    return place


def _tail_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lw, w): two words beside each other that are no units."""
    for batch in batches:
        for ids, tails in zip(_ids_of(batch), batch.column("tails").to_pylist(), strict=True):
            tail, hashes = _is_tail(ids), np.frombuffer(tails, np.int64)
            at = np.cumsum(tail) - 1
            left = at[np.flatnonzero(tail[:-1] & tail[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[left]), pa.array(hashes[left + 1])], ["lw", "w"])


def refine(encoded: DataFrame, frequency: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Exchange over the whole vocabulary: classes of the units, (w, cls) of all other words, class pair counts.

    The pair counts are those of the training texts under the classes of their words.
    """
    of, pairs, words = cluster(encoded, frequency, rounds)
    placed = saved(encoded.mapInArrow(_contexts(of), "w long, codes binary").repartition("w").sortWithinPartitions("w").mapInArrow(_place_tail(pairs), "w long, cls int, right int, n long"))
    tail = placed.filter("w is not null").select("w", "cls")
    of_w, of_left = tail.withColumnRenamed("cls", "right"), tail.withColumnRenamed("w", "lw")
    both = encoded.mapInArrow(_tail_pairs, "lw long, w long").join(of_w, "w").select("lw", "right")
    flat = both.join(of_left, "lw").select("cls", "right", F.lit(1).cast("long").alias("n")).unionByName(placed.filter("w is null").select("cls", "right", "n"))
    out = words.astype(float)
    for r in flat.groupBy("cls", "right").agg(F.sum("n").alias("n")).collect():  # WIDE * WIDE at most
        out[r["cls"], r["right"]] += r["n"]
    return of, tail, out


@dataclass
class Model:
    """What scoring needs, all of bounded size; ``vocabulary`` (word, n, cls) stays a table."""

    units: dict[bytes, int]  # all words of the head
    endings: dict[bytes, int]  # for words unseen in training
    of_unit: np.ndarray  # unit -> class; the end of text is class CLASSES
    transitions: np.ndarray  # log10, (CLASSES + 2) x (CLASSES + 1), the last row from the start of a text
    emission_base: np.ndarray  # log10 of a class's tokens
    unseen: np.ndarray  # log10 of the share that a class leaves for unseen words
    discount: float
    head: dict[bytes, int]
    tokens: int
    types: int
    documents: int
    vocabulary: DataFrame | None

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words with their counts: all words above a count, then words of the step of counts below
    it (an eighth of an octave) by their hash, so that ties never empty or overfill the list. By count, then word."""
    step = F.floor(F.log2("n") * 8)
    words, above, share = 0, 1 << 62, 0.0
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("s")).collect():  # 8 rows an octave
        if words + r["words"] > most:
            share = (most - words) / r["words"]
            below = F.col("n").between(r["least"], above - 1) & (F.shiftrightunsigned(F.xxhash64("word", F.lit("head")), 2) < F.lit(int(share * (1 << 62))))
            break
        words, above, below = words + r["words"], r["least"], F.lit(False)
    else:
        below = F.lit(False)
    found = counts.filter((F.col("n") >= above) | below).select("word", "n").toArrow()  # ``most``, give or take the spread of the hash
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))[:most]


def _words_table(spark: SparkSession, words: Iterable[bytes], **more: np.ndarray) -> DataFrame:
    """A bounded list of words as a table to broadcast."""
    return F.broadcast(spark.createDataFrame(pa.table({"word": pa.array(list(words), pa.binary()), **more})))


def fit(training: DataFrame) -> Model:
    """Count all of ``training`` (its text column) and cluster. No rows give a model without known words."""
    spark: SparkSession = training.sparkSession
    counts = saved(vocabulary(training))
    documents = training.count()
    head_rows = most_frequent(counts, max(HEAD, WORD_UNITS))
    words = {w: i for i, (w, _) in enumerate(head_rows[:WORD_UNITS])}
    ending = F.expr(f"substring(word, greatest(octet_length(word) - {ENDING - 1}, 1), {ENDING})")
    rest = counts.join(_words_table(spark, words), "word", "left_anti").withColumn("w", F.xxhash64("word"))
    by_ending = saved(rest.groupBy(ending.alias("ending")).agg(F.sum("n").alias("n")))
    frequent = most_frequent(by_ending.withColumnRenamed("ending", "word"), ENDING_UNITS)
    endings = {e: WORD_UNITS + i for i, (e, _) in enumerate(frequent)}
    frequency = np.zeros(UNITS, np.int64)
    frequency[: len(words)] = [n for _, n in head_rows[: len(words)]]
    frequency[WORD_UNITS : WORD_UNITS + len(frequent)] = [n for _, n in frequent]
    head_rows = head_rows[:HEAD]
    encoded = saved(text_bytes(training).mapInArrow(_encode(words, endings), "ids binary, tails binary"))
    of, of_tail, pairs = refine(encoded, frequency)
    final = _words_table(spark, words, n=frequency[: len(words)], cls=of[: len(words)].astype(np.int32))
    counts = saved(final.unionByName(rest.join(of_tail, "w").select("word", "n", "cls")))
    late = counts.join(_words_table(spark, (w for w, _ in head_rows[len(words) :])), "word", "left_semi").toArrow()  # HEAD at most
    of_head = dict(zip(words, of.tolist(), strict=False)) | dict(zip(late["word"].to_pylist(), late["cls"].to_pylist(), strict=True))
    stats = counts.groupBy("cls").agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
    units = {w: UNITS + 2 + of_head[w] for w, _ in head_rows}
    of_unit = np.concatenate((of, np.arange(CLASSES)))
    pairs = pairs[:, : CLASSES + 1]
    tokens, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in stats:
        tokens[r["cls"]] += r["n"]
        types[r["cls"]] += r["types"]
    n1, n2 = sum(r["n1"] for r in stats), sum(r["n2"] for r in stats)
    discount = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
    share = (np.append(tokens[:CLASSES], documents) + 0.1) / (tokens.sum() + documents + 0.1 * (CLASSES + 1))
    share /= share.sum()
    # from the end of a text nothing follows; that row is unused
    transitions = np.log10((pairs + SMOOTH * share[None, :]) / (pairs.sum(1, keepdims=True) + SMOOTH))
    unseen = np.log10(np.where(tokens > 0, discount * types / np.maximum(tokens, 1), 1.0))
    return Model(
        units, endings, of_unit, transitions, np.log10(np.maximum(tokens, 1)), unseen, discount,
        dict(head_rows), int(tokens.sum()) + documents, int(types.sum()) + (documents > 0), documents, counts,
    )


class _Heads(dict):
    """Word -> its number here, by which ``words``, ``cls`` and ``n`` have it, its class and its count in the head
    (0 if it is not there; the class is that of its ending then)."""

    def __init__(self, model: Model):
        self.units, self.endings, self.head, self.of_unit = model.units, model.endings, model.head, model.of_unit.tolist()
        self.words: list[bytes] = []
        self.cls, self.n = array("h"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.words)
        self.words.append(word)
        n = self.head.get(word)
        if n is None:  # the units of a model are the words of its head
            unit = self.endings.get(word[-ENDING:])
            if unit is None:
                unit = unit_of(word, {}, {})
            self.n.append(0)
        else:
            unit = self.units[word]
            self.n.append(n)
        self.cls.append(self.of_unit[unit])
        return place


_PARTS = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, cls: int, times: int>>, links array<long>"


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of the given sizes that the values fill in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _score(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums over the words of the head; ``tail`` has the other words with the class of their ending, and
    ``links`` the transitions next to them: left << 32 | right, each a class or WIDE and the place in ``tail``."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Heads(model)
        end_known = model.documents > 0
        end_base = float(model.base(np.array(model.documents)))
        for batch in slices(batches, limit=SCORED):
            if len(known) > FLUSH:
                known = _Heads(model)
            words = [np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in (text.lower().split() for text in blobs(batch))]
            sizes = np.array([len(x) for x in words], np.int64)
            docs = len(sizes)
            word = np.concatenate(words)
            del words
            cls, n, doc = np.array(known.cls, np.int64)[word], np.array(known.n, np.int64)[word], np.repeat(np.arange(docs), sizes)
            head = n > 0
            tail, place, times = np.unique(doc[~head] * len(known) + word[~head], return_inverse=True, return_counts=True)
            many = np.bincount(tail // len(known), minlength=docs) if len(tail) else np.zeros(docs, np.int64)
            first = np.concatenate(([0], np.cumsum(many)[:-1]))
            # texts end to end, each with its start and its end
            begin = np.concatenate(([0], np.cumsum(sizes + 2)))
            path, of = np.full(begin[-1], START), np.repeat(np.arange(docs), sizes + 2)
            path[begin[1:] - 1] = CLASSES
            at = np.arange(len(word)) + 2 * doc + 1
            path[at] = cls
            path[at[~head]] = WIDE + place - first[doc[~head]]
            inside = np.ones(len(path) - 1, bool)
            inside[begin[1:-1] - 1] = False
            left, right = path[:-1], path[1:]
            near = (left < WIDE) & (right < WIDE)
            far, near = inside & ~near, inside & near
            scores = np.bincount(of[:-1][near], model.transitions[left[near], right[near]], docs)
            scores += np.bincount(doc[head], np.log10(n[head] - model.discount) - model.emission_base[cls[head]], docs)
            bases = np.bincount(doc[head], model.base(n[head]), docs) + end_base
            met = tail % len(known) if len(tail) else tail
            tails = pa.StructArray.from_arrays([pa.array([known.words[i] for i in met], pa.binary()), pa.array(np.array(known.cls, np.int32)[met]), pa.array(times.astype(np.int32))], ["word", "cls", "times"])
            links = _lists(np.bincount(of[:-1][far], minlength=docs), pa.array(left[far] << 32 | right[far]))
            knowns = np.bincount(doc[head], minlength=docs) + end_known
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), batch.column("held_out"), pa.array(sizes + 1), pa.array(knowns), pa.array(bases), pa.array(scores), _lists(many, tails), links], ["doc_id", "rid", "held_out", "n_tokens", "n_known", "base", "score", "tail", "links"])

    return score


def _add_tail(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of ``_score`` with what the met words add: their base, emissions and transitions."""
    unseen = model.base(np.zeros(1))[0]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            knowns, bases, scores = (batch.column(c).to_pylist() for c in ("n_known", "base", "score"))
            for i, (met, links) in enumerate(zip(batch.column("met"), batch.column("links"), strict=True)):
                if not met.is_valid:
                    continue
                place, cls, n, times = (met.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "cls", "n", "times"))
                of = np.arange(WIDE + len(place))
                of[WIDE + place] = cls
                seen = n > 0
                knowns[i] += int(times[seen].sum())
                bases[i] += float((times * np.where(seen, model.base(n), unseen)).sum())
                emission = np.where(seen, np.log10(np.maximum(n - model.discount, 1e-300)) - model.emission_base[cls], model.unseen[cls])
                pairs = links.values.to_numpy(zero_copy_only=False)
                scores[i] += float((times * emission).sum() + model.transitions[of[pairs >> 32], of[pairs & 0xFFFFFFFF]].sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens")), pa.array(knowns, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return add


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (its doc_id, text and held_out): n_tokens, n_known, train_tokens, base_score, score,
    and perplexity, 10 ** (-score / n_tokens).

    Null and empty texts are the end token alone. Rows are told apart by a number that is written with the
    partial sums, so repeated rows are scored alike. Other columns are not looked at.
    """
    bounded = replace(model, vocabulary=None)
    parts = saved(text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), "held_out").mapInArrow(_score(bounded), _PARTS))
    tail = parts.select("rid", F.posexplode("tail").alias("place", "t")).select("rid", "place", "t.word", F.col("t.cls").alias("ending_cls"), "t.times")
    # words of the head never come here
    found = tail.join(model.vocabulary, "word", "left").groupBy("rid").agg(F.collect_list(F.struct("place", F.coalesce("cls", "ending_cls").alias("cls"), F.coalesce("n", F.lit(0)).alias("n"), "times")).alias("met"))
    out = parts.drop("tail").join(found, "rid", "left").mapInArrow(_add_tail(replace(bounded, units={}, endings={}, head={})), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Fit on the documents whose crc32(doc_id as text) mod 10 is not 0, then score all of them."""
    rows = docs.select("doc_id", "text", (crc_mod("doc_id", 10) == 0).alias("held_out"))
    return score(rows, fit(rows.filter("not held_out").select("text")))
