"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are its character n-grams with word ends marked. Each hashes to a row of an embedding
table; a text is the average over its subwords, and a linear layer with a softmax gives the languages.
Embeddings and layer are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled documents; a temperature fitted on a held-back part of it calibrates the probabilities, and the
score below which a prediction counts as rejected is a quantile there. For prediction a word is the sum of its
table rows, which workers cache; where languages are fewer than dimensions the layer is applied to the rows first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import blobs, mix, slices, text_bytes

#: Labelled documents that a fit learns from at most (one for each language where these are more).
SAMPLE = 4000
BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
#: Share of correct held-back predictions that the rejection threshold lets through.
ACCEPT = 0.995
#: Words that a worker keeps the sums of.
CACHE = 300_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the words, lower-cased with their ends marked, and whose they are.

    The words stand in one array of code points; a line feed, which no word holds, marks the ends.
    """
    text = "\n" + "\n".join([w.decode("utf-8", "replace") for w in words]).lower() + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    marks = points == 10
    word = np.cumsum(marks) - 1
    rows, owners = [], []
    for k in ORDERS:
        n = len(points) - k + 1
        if n <= 0:
            continue
        h, inside = np.full(n, k, np.uint64), np.ones(n, bool)
        for i in range(k):
            h = h * np.uint64(0x01000193) + points[i : i + n]
            if 0 < i < k - 1:
                inside &= ~marks[i : i + n]
        inside &= word[:n] < len(words)
        at = np.flatnonzero(inside)
        rows.append((mix(h[at]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(word[at])
    return np.concatenate(rows), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x dimensions: embedding rows
    layer: np.ndarray  # dimensions x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(n, 1)[:, None] @ self.layer + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


class _Words:
    """The worker's table of words: the sum of each one's subword rows and how many they are."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sums, self.sizes = np.empty((0, self.model.table.shape[1]), np.float32), np.empty(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.place]
        if not new:
            return
        rows, owner = subwords(new)
        values = self.model.table[rows]
        sums = np.stack([np.bincount(owner, values[:, i], len(new)) for i in range(values.shape[1])], 1)
        begin, end = len(self.place), len(self.place) + len(new)
        self.place.update(zip(new, range(begin, end), strict=True))
        if end > len(self.sizes):
            room = max(end, 2 * len(self.sizes)) - len(self.sizes)
            self.sums = np.concatenate([self.sums, np.zeros((room, self.sums.shape[1]), np.float32)])
            self.sizes = np.concatenate([self.sizes, np.zeros(room, np.int64)])
        self.sums[begin:end], self.sizes[begin:end] = sums, np.bincount(owner, minlength=len(new))


def train(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Model:
    """Fit on documents given as the buckets of their subwords and how often each stands there. The last fifth is
    held back to calibrate."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    bags = [(rows, (times / max(times.sum(), 1)).astype(np.float32)) for rows, times in texts]
    cut = len(bags) - len(bags) // 5 if len(bags) >= 20 else len(bags)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(cut):
            rows, weight = bags[i]
            mean = weight @ embed[rows]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            embed[rows] -= step * len(rows) * weight[:, None] * back[None, :] / max(1.0, np.sqrt(len(rows)))
    few = k < DIM
    model = Model(languages, (embed @ layer).astype(np.float32) if few else embed, np.eye(k, dtype=np.float32) if few else layer, bias, 1.0, 0.0)
    held = range(cut, len(bags))
    if len(held):
        sums = np.stack([bags[i][1] @ model.table[bags[i][0]] for i in held])
        one, truth = np.ones(len(held)), y[list(held)]
        losses = []
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = float(t)
            losses.append((-np.log(np.maximum(model.probabilities(sums, one)[np.arange(len(held)), truth], 1e-12)).mean(), float(t)))
        model.temperature = min(losses)[1]
        p = model.probabilities(sums, one)
        right = p.argmax(axis=1) == truth
        if right.any():
            model.threshold = float(np.quantile(p.max(axis=1)[right], 1 - ACCEPT))
    return model


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, times = zip(*(np.unique(subwords(text.split())[0].astype(np.int32), return_counts=True) for text in blobs(batch)), strict=True)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "h", "doc_id")), pa.array(rows, pa.list_(pa.int32())), pa.array([t.astype(np.int32) for t in times], pa.list_(pa.int32()))], ["lang", "h", "doc_id", "rows", "times"])


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on ``sample`` rows at most of those with a lang, a text and an id: in each language those whose ids
    hash lowest, in equal numbers as far as they go, and one at least. Every language is learned.

    The driver gets a document as counts by bucket, BUCKETS of them at most however long the text is. None if there
    is nothing to learn from.
    """
    usable = docs.filter("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").toArrow().to_pylist()  # one for each language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # a language's ids that hash below its share: about as many as wanted, the surplus goes by hash order
    below = [(r["lang"], int((1 << 62) * min(1.0, 1.2 * (each + 8) / r["n"]))) for r in counts]
    share = docs.sparkSession.createDataFrame(pa.table({"lang": [x for x, _ in below], "below": [y for _, y in below]}))
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)
    rows = usable.join(F.broadcast(share), "lang").filter(h <= F.col("below")).select("lang", h.alias("h"), "doc_id", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_bags, "lang string, h long, doc_id long, rows array<int>, times array<int>").toArrow()
    keys = sorted(zip(found["h"].to_pylist(), found["doc_id"].to_pylist(), found["lang"].to_pylist(), range(found.num_rows), strict=True))
    bag = lambda i: tuple(found[c][i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rows", "times"))
    languages, taken = [r["lang"] for r in counts], {}
    for _, _, lang, i in keys:
        own = taken.setdefault(lang, [])
        if len(own) < each:
            own.append(bag(i))
    pairs = [(i, lang, b) for lang, bags in sorted(taken.items()) for i, b in enumerate(bags)]
    pairs.sort(key=lambda p: p[:2])
    return train([p[2] for p in pairs], np.array([languages.index(p[1]) for p in pairs], np.int64), languages)


PREDICTION = "doc_id long, lang_pred string, score double, rejected boolean"


def _predict(model: Model | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model) if model else None
        for batch in slices(batches):
            texts = blobs(batch)
            known = [model is not None and bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
            names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            which = [i for i, k in enumerate(known) if k]
            if which:
                if len(words.place) > CACHE:
                    words.clear()
                own = [texts[i].split() for i in which]
                words.learn(set().union(*own))
                at = np.fromiter((n for w in own for n in map(words.place.__getitem__, w)), np.int64, sum(map(len, own)))
                first = np.concatenate(([0], np.cumsum([len(w) for w in own])[:-1])).astype(np.int64)
                p = model.probabilities(np.add.reduceat(words.sums[at], first, axis=0), np.add.reduceat(words.sizes[at], first))
                for i, best, score in zip(which, p.argmax(axis=1), p.max(axis=1), strict=True):
                    names[i], scores[i], rejected[i] = model.languages[best], float(score), bool(score < model.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return predict


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score, rejected (the calibrated score is below the threshold).

    Only the text is looked at. A null text, or one without a letter, is ``und`` with score 0 and rejected; so
    is every text if there is no model. Repeated rows get equal answers.
    """
    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_predict(model), PREDICTION)
