"""The pipeline against a brute-force version, stage by stage on what the stage before kept."""

from __future__ import annotations

import re

import brute
import numpy as np
import public_tokenizers
import pytest
from test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from docsieve.llm import line_dedup, quality
from docsieve.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage but the last leaves."""
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF))
        out.append(docs)
    return out


def brute_stages(rows, trees, items):
    """What each stage but the last keeps of rows (doc_id, text, lang, source, n_chars, ...)."""
    good = []
    for r in rows:
        c, x = quality.statistics((r[1] or "").encode())
        assert c == brute.quality_counts(r[1])
        if c[0] >= 10 and 100 * c[4] <= 20 * c[0] and trees.score(np.array([x]))[0] >= quality.KEEP_ABOVE:
            good.append(r)
    yield good
    texts = brute.without_boilerplate([(r[0], r[3], r[1]) for r in good], line_dedup.SITES, line_dedup.MIN_CHARS)
    cut = [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t), *r[5:]) for r, t in zip(good, texts, strict=True) if t == r[1] or re.search(r"[^\x20\x09-\x0D]", t)]
    yield cut
    # rows stand for themselves: each by its own text, the least id of a group first, rows without an id stay
    order = sorted((i for i, r in enumerate(cut) if r[0] is not None), key=lambda i: cut[i][0])
    groups = brute.near_components((n, cut[i][1]) for n, i in enumerate(order))
    alone = [cut[i] for n, i in enumerate(order) if groups[n][1] == n] + [r for r in cut if r[0] is None]
    yield alone
    yield [r for r in alone if not brute.benchmark_hits(r[1], items)[1]]


def test_pipeline_by_brute_force(spark, kept):
    docs = table(spark, SF, "documents")
    trees = quality.fit_on(docs, table(spark, SF, "labels"))
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    rows = [tuple(r) for r in docs.collect()]
    for (name, _), found, want in zip(corpus_pipeline.STAGES[:-1], kept, brute_stages(rows, trees, items), strict=True):
        assert rows_of(found) == sorted(map(str, want))
        assert 0 < len(want) < len(rows) + (name == "line_dedup")  # lines go there, documents need not
        rows = want
    packed = corpus_pipeline.run(spark, SF).collect()
    check_packing(packed, [(r[0], r[1]) for r in rows], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_stages_keep_the_right_rows_of_an_awkward_table(spark, tricky, tricky_rows):
    """Nulls, empty and long texts, repeated rows and ids, clashing names: the same rows as the brute-force version.

    The table holds no benchmark passages; those of rows without an id are tested with the operator.
    """
    trees = quality.fit_on(tricky, table(spark, SF, "labels"))
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    docs = tricky
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], brute_stages(tricky_rows, trees, items), strict=True):
        docs = saved(stage(spark, docs, SF))
        assert docs.columns == tricky.columns and rows_of(docs) == sorted(map(str, want))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() > 40


def test_stages_take_awkward_tables(spark, tricky, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (tricky, empty):
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= docs.count() or name == "packing"
