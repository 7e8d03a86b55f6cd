"""Class LM, quality rules and language identification."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import class_lm, lang_id, quality
from docsieve.llm.common import crc_mod


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_class_lm_counts_and_base(tricky, tricky_rows):
    found = class_lm.score_documents(tricky).collect()
    want, n = brute.base_scores([((r[0], r[1]), r[1]) for r in tricky_rows], [r[1] for r in tricky_rows if not held_out(r[0])])
    totals = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in found)
    assert totals == sorted((k[0] is None, k[0] or 0, *want[k][:2], round(want[k][2], 4)) for k in ((r[0], r[1]) for r in tricky_rows))
    assert {r["train_tokens"] for r in found} == {n}
    assert all(r["held_out"] == held_out(r["doc_id"]) and np.isfinite(r["score"]) for r in found)


def test_class_lm_sums_to_one(tricky):
    rows = tricky.select("text")
    model = class_lm.fit(rows)
    assert np.allclose((10.0 ** model.transitions[[*range(class_lm.CLASSES), class_lm.START]]).sum(1), 1)
    mass = np.zeros(class_lm.CLASSES)
    types = np.zeros(class_lm.CLASSES)
    for r in model.vocabulary.collect():
        c = model.of_unit[class_lm.unit_of(bytes(r["word"]), model.units, model.endings)]
        mass[c] += 10 ** (np.log10(r["n"] - model.discount) - model.emission_base[c])
        types[c] += 1
    used = types > 0
    assert np.allclose((mass + 10.0 ** model.unseen[: class_lm.CLASSES])[used], 1)


def test_class_lm_tail_is_joined(tricky, monkeypatch):
    """Words beyond the broadcast head meet the vocabulary in a join; the scores are the same."""
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in class_lm.score_documents(tricky).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 200)
    for r in class_lm.score_documents(tricky).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"], r["n_tokens"]], rel=1e-9)


def test_class_lm_classes_by_context(spark, monkeypatch):
    """Rare words of one ending get classes by their neighbours, in the head and beyond it alike."""
    rng = np.random.default_rng(3)
    often, rare = ([[f"{name}{k}x{i}{end}" for i in range(n)] for k in range(3)] for name, n, end in (("f", 50, ""), ("r", 40, "end")))
    texts = [" ".join(str(rng.choice((rare if rng.random() < 0.15 else often)[(at + i) % 3])) for i in range(40)) for at in range(600)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = []
    for head in (100_000, 200):
        monkeypatch.setattr(class_lm, "HEAD", head)
        model = class_lm.fit(docs)
        assert (len(model.head) < 270) == (head == 200)
        of = {bytes(r["word"]).decode(): r["cls"] for r in model.vocabulary.collect()}
        assert set(of) == {w for k in (*often, *rare) for w in k}
        main = [max(sum(of[w] == c for w in k) for k in rare) for c in range(class_lm.CLASSES)]
        assert sum(main) > 0.6 * 120  # one class by the ending alone: a third
        found.append(of)
    assert found[0] == found[1]


def test_class_lm_pairs_are_counted_whole(spark, tricky, monkeypatch):
    """The class pair counts of the rounds are those of the texts under the classes of the words."""
    for head in (100_000, 200):
        monkeypatch.setattr(class_lm, "HEAD", head)
        kept = {}
        refine = class_lm.refine
        monkeypatch.setattr(class_lm, "refine", lambda *a, f=refine, k=kept: k.setdefault("r", f(*a)))
        model = class_lm.fit(tricky.select("text"))
        monkeypatch.setattr(class_lm, "refine", refine)
        of = {bytes(r["word"]): r["cls"] for r in model.vocabulary.collect()}
        want = np.zeros((class_lm.WIDE, class_lm.WIDE))
        for r in tricky.collect():
            path = [class_lm.START, *(of[w] for w in brute.words(r["text"])), class_lm.CLASSES]
            np.add.at(want, (path[:-1], path[1:]), 1)
        assert (kept["r"][2] == want).all()


def test_class_lm_other_words_choose_by_their_contexts(spark, tricky, monkeypatch):
    """Words beyond the units get classes by their neighbours too, and their pairs are counted whole."""
    rng = np.random.default_rng(3)
    often, rare = ([[f"{name}{k}x{i}{end}" for i in range(n)] for k in range(3)] for name, n, end in (("f", 50, ""), ("r", 40, "end")))
    texts = [" ".join(str(rng.choice((rare if rng.random() < 0.15 else often)[(at + i) % 3])) for i in range(40)) for at in range(600)]
    monkeypatch.setattr(class_lm, "most_frequent", lambda counts, most, f=class_lm.most_frequent: f(counts, 150 if most > class_lm.ENDING_UNITS else most))
    for docs in (spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), tricky.select("text")):
        kept = {}
        refine = class_lm.refine
        monkeypatch.setattr(class_lm, "refine", lambda *a, f=refine, k=kept: k.setdefault("r", f(*a)))
        model = class_lm.fit(docs)
        monkeypatch.setattr(class_lm, "refine", refine)
        assert 100 < len(model.head) <= 150 and kept["r"][1].count() > 100
        of = {bytes(r["word"]): r["cls"] for r in model.vocabulary.collect()}
        want = np.zeros((class_lm.WIDE, class_lm.WIDE))
        for r in docs.collect():
            path = [class_lm.START, *(of[w] for w in brute.words(r["text"])), class_lm.CLASSES]
            np.add.at(want, (path[:-1], path[1:]), 1)
        assert (kept["r"][2] == want).all()
        if len(of) == 270:
            main = [max(sum(of[w.encode()] == c for w in k) for k in rare) for c in range(class_lm.CLASSES)]
            assert sum(main) > 0.6 * 120


def test_class_lm_score_by_the_letter(tricky, tricky_rows, monkeypatch):
    """The score, worked out word by word from the model's parts."""
    monkeypatch.setattr(class_lm, "HEAD", 200)
    training = tricky.filter(crc_mod("doc_id", 10) != 0).select("text")
    model = class_lm.fit(training)
    known = {bytes(r["word"]): (r["cls"], r["n"]) for r in model.vocabulary.collect()}
    want = []
    for r in tricky_rows:
        total, before = 0.0, class_lm.START
        for w in brute.words(r[1]):
            cls, n = known.get(w) or (int(model.of_unit[class_lm.unit_of(w, {}, model.endings)]), 0)
            emission = np.log10(n - model.discount) - model.emission_base[cls] if n else model.unseen[cls]
            total += model.transitions[before, cls] + emission
            before = cls
        want.append((str(r[0]), round(total + model.transitions[before, class_lm.CLASSES], 4)))
    rows = class_lm.score(tricky.select("doc_id", "text", F.lit(False).alias("held_out")), model).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in rows) == sorted(want)


def test_most_frequent_takes_ties_by_hash(spark):
    counts = spark.createDataFrame([(bytearray(b"w%d" % i), 1) for i in range(3000)] + [(bytearray(b"often"), 9)], "word binary, n long")
    found = class_lm.most_frequent(counts, 500)
    assert found[0] == (b"often", 9) and 400 < len(found) <= 500
    assert found == class_lm.most_frequent(counts.repartition(7), 500)
    assert len(class_lm.most_frequent(counts, 4000)) == 3001


def test_class_lm_beats_single_words(docs):
    held = class_lm.score_documents(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 60)
    bigrams = np.zeros((60, 60))
    for a in range(60):
        for b in np.flatnonzero(truth == (truth[a] + 1) % 3):
            bigrams[a, b] = rng.integers(5, 15)
    of = class_lm.exchange(bigrams, 3, 20)
    assert all(len(set(of[truth == c])) == 1 for c in range(3)) and len(set(of)) == 3


def test_quality_counts(spark, tricky, tricky_rows, docs, labels):
    trees = quality.fit_on(docs, labels)
    rows = quality.judge(tricky, trees).collect()
    got = sorted(str((r["doc_id"], *[r[c] for c in quality.COUNTS], r["base_failed"])) for r in rows)
    want = []
    for r in tricky_rows:
        c = brute.quality_counts(r[1])
        want.append(str((r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])))
    assert got == sorted(want)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    kept = quality.keep_good(tricky, trees)
    assert kept.columns == tricky.columns and kept.count() == sum(r["kept"] for r in rows)


def walk(trees, x):
    """The score of one row, node by node."""
    total = trees.base
    for t in range(len(trees.feature)):
        node = 0
        while trees.left[t, node] != node:
            node = trees.left[t, node] if x[trees.feature[t, node]] <= trees.threshold[t, node] else trees.right[t, node]
        total += trees.value[t, node]
    return 1 / (1 + np.exp(-total))


def test_trees_score_and_are_monotone(docs, labels):
    trees = quality.fit_on(docs, labels)
    x = np.array([quality.statistics(r["text"].encode())[1] for r in docs.limit(200).collect()])
    assert np.allclose(trees.score(x), [walk(trees, row) for row in x])
    for name in quality.MONOTONE:
        at = quality.FEATURES.index(name)
        last = np.full(len(x), np.inf)
        for v in np.linspace(0, x[:, at].max() + 1, 60):
            moved = x.copy()
            moved[:, at] = v
            p = trees.score(moved)
            assert (p <= last + 1e-12).all()
            last = p


def test_trees_learn_the_labels(docs, labels):
    held = labels.filter(F.col("doc_id") % 3 == 0)
    trees = quality.fit_on(docs, labels.filter(F.col("doc_id") % 3 != 0))
    scored = quality.judge(docs, trees).withColumnRenamed("quality", "p").join(held, "doc_id").collect()
    good, bad = [r["p"] for r in scored if r["quality"]], [r["p"] for r in scored if not r["quality"]]
    assert np.mean([a > b for a in good for b in bad]) > 0.85
    assert np.mean([r["kept"] for r in scored if r["quality"]]) > 0.93


def test_quality_without_labels(spark, tricky, labels, empty):
    trees = quality.fit_on(tricky, labels.limit(0))
    assert quality.judge(tricky, trees).filter("kept <> (not base_failed)").count() == 0
    assert quality.judge(empty, trees).count() == 0


def test_language_held_out(docs):
    out = crc_mod("doc_id", 4) == 2
    model = lang_id.fit_on(docs.filter(~out))
    rows = lang_id.predict(docs, model).join(docs.filter(out).select("doc_id", "lang"), "doc_id").collect()
    sure = [r for r in rows if r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == r["lang"] for r in sure]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in sure]) < 0.1


def test_language_awkward_rows(spark, tricky, tricky_rows, empty, docs):
    model = lang_id.fit_on(docs)
    rows = lang_id.predict(tricky, model).collect()
    assert len(rows) == len(tricky_rows)
    texts = {}
    for r in tricky_rows:
        texts.setdefault(r[0], r[1])
    for r in rows:
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letters)
    assert lang_id.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in lang_id.predict(tricky, lang_id.fit_on(empty)).collect()} == {"und"}


def test_cells_are_added_in_place(monkeypatch):
    """A run of texts touches few cells: no array of all units' cells is made for each run; the counts are the same."""
    import numpy as np
    import pyarrow as pa

    from docsieve.llm import class_lm as c

    sizes, own = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, minlength=0, **k: sizes.append(minlength) or own(*a, minlength=minlength, **k))
    runs = [np.array([c.START_ID, 0, 0, 1, c.END_ID, c.START_ID, 1, c.END_ID]), np.array([c.START_ID, 1, 0, c.END_ID])]
    of = np.zeros(c.UNITS + 2, np.int64)
    of[[1, c.END_ID, c.START_ID]] = 1, c.CLASSES, c.START
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint16).tobytes() for x in runs], pa.binary())], ["ids"])
    out = next(c._cells(of)(iter([batch])))
    cells = {k: c._unpacked(v) for k, v in zip(out.column("block").to_pylist(), out.column("cells").to_pylist(), strict=True)}
    assert max(sizes) == c.WIDE**2
    zero, one = cells[0][: c.CELLS], cells[0][c.CELLS : 2 * c.CELLS]
    assert (zero[c.SELF], zero[1], zero[c.CLASSES], zero[c.WIDE + c.START], zero[c.WIDE + 1], zero.sum()) == (1, 1, 1, 1, 1, 5)
    assert (one[0], one[c.CLASSES], one[c.WIDE], one[c.WIDE + c.START], one.sum()) == (1, 2, 1, 2, 6)
    assert cells[c.ALL_PAIRS].sum() == 9
