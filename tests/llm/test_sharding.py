"""Exact shard sizes, gapless slots and the law of the communication matrix."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from docsieve.llm import sharding


def test_assign(tricky, tricky_rows):
    rows = sharding.assign(tricky).collect()
    want = sorted(str((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()))) for r in tricky_rows)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == want
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_assign_is_the_same_again(docs):
    a, b = (sorted(map(tuple, sharding.assign(d).select("doc_id", "shard", "slot").collect())) for d in (docs, docs.repartition(7)))
    assert a == b
    assert a != sorted(map(tuple, sharding.assign(docs, seed=8).select("doc_id", "shard", "slot").collect()))


def test_shards_are_mixed(docs):
    """Neighbours of the input do not stay together: shards of the first tenth of ids are near even."""
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    first = set(ids[: len(ids) // 10])
    rows = sharding.assign(docs, 4).collect()
    n = Counter(r["shard"] for r in rows if r["doc_id"] in first)
    assert min(n.values()) > len(first) / 4 - 5 * (len(first) * 3 / 16) ** 0.5


def test_matrix_margins_and_law():
    rng = random.Random(1)
    blocks, shards = [rng.randint(0, 40) for _ in range(30)], [0] * 7
    for i in range(sum(blocks)):
        shards[i % 7] += 1
    m = sharding.matrix(blocks, shards, 3)
    assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m, strict=True)] == shards
    draws = [sharding.hypergeometric(rng.random(), 30, 70, 10) for _ in range(4000)]
    mean = sum(draws) / len(draws)
    var = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 3) < 0.1 and abs(var - 10 * 0.3 * 0.7 * 90 / 99) < 0.2
    assert sharding.hypergeometric(0.999999, 5, 0, 3) == 3


def test_shard_documents(tricky, empty):
    done = sharding.shard_documents(tricky, 4)
    assert done.count() == tricky.count() and set(done.columns) == set(tricky.columns) | {"_shard", "_slot"}
    assert done.select("_shard", "_slot").distinct().count() == tricky.count()
    assert sharding.assign(empty).count() == 0
