"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

The trees are fitted on the driver from a bounded sample of labelled documents (``SAMPLE`` rows, those
whose ids hash lowest); statistics and verdicts cover whole texts of all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import blobs, boxed, hash_words, shape, slices, text_bytes, unboxed, window_hashes

#: Labelled rows that a fit reads at most.
SAMPLE = 8000
REPEAT_WINDOW = 5
#: A document is rejected when the model's probability of good quality falls below this.
KEEP_ABOVE = 0.2

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols", "bangs", "bars", "capitals", "digits", "stops", "dup_lines", "repeats", "distinct_words", "line_words", "non_ascii"]
#: Features in which the probability of good quality must not rise (-1).
MONOTONE = {"symbols": -1, "bangs": -1, "capitals": -1, "dup_lines": -1, "repeats": -1}

_CLASSES = [b"#*$%&|<>", b"!", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?,;:", bytes(range(0x80, 0xC0)), b" \t\n\v\f\r", bytes(range(0xC0, 0x100))]
_IN_CLASS = np.array([[c in k for c in range(256)] for k in _CLASSES], np.int64)


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts (``COUNTS``) and the model's features (``FEATURES``) of one text."""
    words = text.split()
    n = len(words)
    symbols, bangs, bars, capitals, digits, stops, tails, spaces, heads = (_IN_CLASS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    chars = len(text) - tails - spaces
    lines = [x for x in text.split(b"\n") if x.strip()]
    hashes = hash_words(words)
    repeats = 0
    if n > REPEAT_WINDOW:
        _, inverse, times = np.unique(window_hashes(hashes, REPEAT_WINDOW), return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        if again.any():
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, np.flatnonzero(again), 1)
            np.add.at(steps, np.flatnonzero(again) + REPEAT_WINDOW, -1)
            repeats = int((np.cumsum(steps) > 0).sum())
    dup = len(lines) - len(set(lines))
    m, c = max(n, 1), max(chars, 1)
    features = [np.log1p(n), chars / m, symbols / m, bangs / m, bars / m, capitals / c, digits / c, stops / m, dup / max(len(lines), 1), repeats / m, len(np.unique(hashes)) / m, n / max(len(lines), 1), heads / c]
    return [n, chars, symbols, dup, repeats], features


@dataclass
class Trees:
    """Boosted trees as node arrays, one row a tree: leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves each row reaches, all trees descended at once."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            goes = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(goes, self.left[trees, node], self.right[trees, node])
        return self.value[trees, node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        return 1 / (1 + np.exp(-(self.base + self.raw(x))))


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, signs: np.ndarray, depth: int, l2: float, least: float) -> list[list[float]]:
    """One tree on gradients and hessians: nodes [feature, threshold, left, right, value] by best gain.

    A split on a constrained feature must order its children's values; their middle bounds all below.
    """
    nodes: list[list[float]] = []
    bins = max(len(e) for e in edges) + 1

    def leaf(rows: np.ndarray, lo: float, hi: float) -> float:
        return float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), lo, hi))

    def build(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, leaf(rows, lo, hi)])
        if level == depth or h[rows].sum() < 2 * least:
            return me
        best = (1e-6, 0, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(binned.shape[1]):
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], bins))[: len(edges[f])]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], bins))[: len(edges[f])]
            gr, hr = total_g - gl, total_h - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
            fine = (hl >= least) & (hr >= least)
            if signs[f]:
                fine &= signs[f] * (np.clip(-gr / (hr + l2), lo, hi) - np.clip(-gl / (hl + l2), lo, hi)) >= 0
            gain = np.where(fine, gain, 0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[0] <= 1e-6:
            return me
        _, f, cut = best
        inside = binned[rows, f] <= cut
        lefts, rights = rows[inside], rows[~inside]
        bounds = (lo, hi), (lo, hi)
        if signs[f]:
            mid = (leaf(lefts, lo, hi) + leaf(rights, lo, hi)) / 2
            bounds = ((lo, mid), (mid, hi)) if signs[f] > 0 else ((mid, hi), (lo, mid))
        nodes[me][:2] = [f, float(edges[f][cut])]
        nodes[me][2] = build(lefts, level + 1, *bounds[0])
        nodes[me][3] = build(rights, level + 1, *bounds[1])
        return me

    build(np.arange(len(g)), 0, -np.inf, np.inf)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boost with the logistic loss (Newton steps). Needs no rows of both classes: one class gives its rate."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    grown = []
    if len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        signs = np.array([monotone.get(f, 0) for f in range(x.shape[1])])
        raw = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            nodes = _grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), signs, depth, l2, least)
            for n in nodes:
                n[4] *= rate
            grown.append(nodes)
            raw = raw + _flat([nodes], 0.0, depth).raw(x)
    return _flat(grown or [[[0, 0.0, 0, 0, 0.0]]], base, depth)


def _flat(trees: list[list[list[float]]], base: float, depth: int) -> Trees:
    size = max(len(t) for t in trees)
    a = np.array([t + [[0, 0.0, i, i, 0.0] for i in range(len(t), size)] for t in trees], float)
    return Trees(a[:, :, 0].astype(int), a[:, :, 1], a[:, :, 2].astype(int), a[:, :, 3].astype(int), a[:, :, 4], base, depth)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [statistics(t)[1] for t in blobs(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on ``sample`` labelled ids at most: those that hash lowest, so the choice is repeatable.

    Of labels that contradict each other for one id the worst counts. Each distinct row of a repeated id is
    learned from. Rows without a label or an id are not used; no usable rows give a model that keeps everything.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    # ids that hash below the sample's share, then the exact number of them: tasks send few rows each
    share = min(1.0, 1.2 * sample / max(usable.count(), 1))
    likely = usable.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) <= F.lit(int((1 << 62) * share)))
    chosen = likely.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 2), "doc_id").limit(sample)
    rows = text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(_measure, "doc_id long, label int, x array<double>")
    found = sorted({(r["doc_id"], r["label"], tuple(r["x"])) for r in rows.toLocalIterator()})
    x = np.array([r[2] for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] > 0 for r in found], float), {FEATURES.index(k): v for k, v in MONOTONE.items()})


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def _judge(trees: Trees, keep_above: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(t) for t in blobs(batch)]
            counts = np.array([c for c, _ in found], np.int64)
            quality = trees.score(np.array([x for _, x in found], float))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= keep_above))], ["doc_id", *COUNTS, "base_failed", "quality", "kept"])

    return judge


def judge(docs: DataFrame, trees: Trees, keep_above: float = KEEP_ABOVE) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, quality (probability of good) and kept.

    Null and empty texts have no words, so they fail. Repeated rows are judged one by one; other columns are
    not looked at; an empty table gives an empty table.
    """
    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_judge(trees, keep_above), VERDICT)


def _filter(trees: Trees, keep_above: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(t) for t in blobs(batch)]
            counts = np.array([c for c, _ in found], np.int64)
            good = (counts[:, 0] >= 10) & (100 * counts[:, 4] <= 20 * counts[:, 0]) & (trees.score(np.array([x for _, x in found], float)) >= keep_above)
            yield batch.filter(pa.array(good))

    return keep


def keep_good(docs: DataFrame, trees: Trees, keep_above: float = KEEP_ABOVE) -> DataFrame:
    """The rows of ``docs`` that the rules and the model keep, columns unchanged, in one pass without a join.

    Null and empty texts have no words and go. Rows are judged one by one, so repeated rows and repeated or null
    ids make no difference; an empty table gives an empty table.
    """
    raw = boxed(docs)
    return unboxed(raw.mapInArrow(_filter(trees, keep_above), shape(raw)), docs)
