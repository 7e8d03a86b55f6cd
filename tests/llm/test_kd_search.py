"""Exact top-k search against a search of all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from paths import DATA

from docsieve.llm import kd_search

SCHEMA = "vec_id long, embedding array<double>, label int, v string, `key` int, shard int, id string"


def plain(rows, k=20, every=20):
    good = []
    for n, (i, x) in enumerate(rows):
        if x is not None and all(e is not None and math.isfinite(e) for e in x):
            good.append((n, i, [math.floor(64 * e) for e in x]))
    out = []
    for n, i, x in good:
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j is None, j or 0, m, j) for m, j, y in good if m != n)
            out += [(i, r + 1, s[4], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(spark, rows, **more):
    table = spark.createDataFrame([(i, x, 1, "v", 2, 3, "i") for i, x in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in kd_search.top_k(table, **more).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def clustered(seed, n, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]


def awkward():
    rows = clustered(3, 300)
    rows += [(1000 + i, list(rows[7][1])) for i in range(150)]  # a vector of many rows
    rows += [(2000, None), (2020, []), (2021, [None] * 6), (2040, [float("nan")] * 6), (2060, [float("inf")] + [0.0] * 5), (2080, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [0.5] * 6), (None, None), (2100, [0.25, -0.5])]
    return rows + [rows[20], rows[20], (40, [9.0] * 6), (40, [9.0] * 6), (60, [-0.0] * 6), (-20, [0.01] * 6)]


@pytest.mark.parametrize("shard_rows", [None, 40, 7])
def test_against_plain(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(kd_search, "ASKED", 10)
    assert got(spark, awkward(), shard_rows=shard_rows) == plain(awkward())


def test_boxes_in_passes_and_few_values(spark, monkeypatch):
    """Cells that planes cannot cut are dealt by number; boxes go out in several passes."""
    monkeypatch.setattr(kd_search, "BOXES", 3)
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.5]) for _ in range(9)]) for i in range(400)]
    assert got(spark, rows, shard_rows=15, k=5) == plain(rows, 5)


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10**7 for _ in range(4)]) for i in range(90)]
    assert got(spark, rows, k=3) == plain(rows, 3)


def test_few_and_none(spark):
    assert got(spark, []) == []
    assert got(spark, [(20, [1.0])]) == []
    assert got(spark, [(20, [1.0]), (3, [2.0])]) == [(20, 1, 3, 64 * 128)]


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert sorted((tuple(r) for r in kd_search.top_k(table, shard_rows=64).collect()), key=str) == plain(rows)


def test_tree_boxes_and_pruning():
    """Boxes are tight, and a walk with a known k-th score looks at few leaves of clustered points."""
    points = np.array([[int(64 * e) for e in x] for _, x in clustered(4, 4000)])
    tree = kd_search.Tree(points, 32)
    for (start, stop), low, high in zip(tree.range, tree.low, tree.high, strict=True):
        own = points[tree.order[start:stop]]
        assert (own.min(axis=0) == low).all() and (own.max(axis=0) == high).all()
    assert sorted(tree.order) == list(range(4000))
    scores, found = next(tree.search(points[:1], np.array([-np.inf]), 5))
    all_scores = points @ points[0]
    assert scores.tolist() == sorted(all_scores.tolist(), reverse=True)[:5] and (all_scores[found] == scores).all()
    assert next(tree.search(points[:1], np.array([1e12]), 5))[0].size == 0


def test_query_equals_sql(spark):
    import duckdb

    from docsieve.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/sf0.01/embeddings.parquet')")
    want = sorted(con.execute(ORACLES["op11_top_k"]).fetchall())
    df = QUERIES["op11_top_k"](spark, f"{DATA}/sf0.01")
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, df.collect())) == want and len(want) == 500
