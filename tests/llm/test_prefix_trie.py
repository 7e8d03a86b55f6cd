"""The prefix trie against one of Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from paths import DATA

from docsieve.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, conv int, `at` string, p1 long, n int, depth string"


def plain(rows):
    """rows: (conv_id, turn, role, text); equal turns must have equal contents or a null turn only once."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        first = own.get(c - int(np.fmod(c, 20)), [])[:h]
        whole = tuple(first + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()), key=str)


def got(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 1, "a", 2, 3, "d") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(table, **sizes).select(*COLUMNS).collect()), key=str)


def talk(seed, convs=120):
    """Few different turns, so that much is shared; a long conversation; one that many have; awkward rows."""
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "user", "assistant", None, ""]), rng.choice(["a b", "c  d\te", "", None, "x y z"]))
    rows = []
    for c in [*range(convs), -5, -20, -21, 10**12]:
        if c % 17 != 3:
            rows += [(c, t, *say()) for t in range(rng.randint(1, 7))]
    same = [say() for _ in range(12)]
    for c in range(1000, 1080):
        rows += [(c, t, *x) for t, x in enumerate(same[: rng.choice([12, 12, 12, 5, 9])])]
    long = [say() for _ in range(150)]
    rows += [(2003, t, *x) for t, x in enumerate(long)] + [(2004, t, *x) for t, x in enumerate(long[:130])] + [(2005, t, *x) for t, x in enumerate([*long[:90], *long[:30]])]
    rows += [(None, 1, "user", "a"), (5000, None, "user", "first of all"), (5000, -3, "user", "second"), (5000, 7, None, None), (6001, None, None, None), (3, 2, "user", "a"), (3, 2, "user", "a")]
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"least": 8, "chunk_rows": 100}), (3, {"least": 3, "shard_nodes": 20}), (4, {"least": 1}), (5, {"least": 40, "upper": 10})])
def test_against_plain(spark, seed, sizes):
    rows = talk(seed)
    assert got(spark, rows, **sizes) == plain(rows)


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    assert sorted((tuple(r) for r in prefix_trie.prefix_nodes(table).select(*COLUMNS).collect()), key=str) == plain(rows)


def test_small_pieces_of_digests(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    rows = [(c, 0, "user", "hello") for c in range(20, 300)]
    assert got(spark, rows) == plain(rows)


def test_empty_and_turnless(spark):
    assert got(spark, []) == []
    one = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    assert got(spark, [(one, 0, "user", "a")]) == plain([(one, 0, "user", "a")])  # its first turn would come from an absent one


def test_louds():
    """Parents and children read from the bits; packed shards give the same tries."""
    rng = random.Random(6)
    parent = np.array([-1, -1, *(rng.randint(0, i - 1) for i in range(2, 300))])
    labels = np.array([[rng.randint(-9, 9), i] for i in range(300)])
    trie = prefix_trie.Louds(parent, labels)
    place = np.empty(300, np.int64)
    place[trie.order] = np.arange(300)
    assert (trie.parents() == np.where(parent[trie.order] < 0, -1, place[parent[trie.order]])).all()
    for node in range(-1, 300):
        own = trie.children(node)
        assert list(own) == np.flatnonzero(trie.parents() == node).tolist()
        assert [tuple(trie.labels[i]) for i in own] == sorted(tuple(trie.labels[i]) for i in own)
    ones = trie.add_up(np.ones((300, 1), np.int64))
    assert ones[list(trie.children(-1))].sum() == 300


def test_packed(spark):
    table = spark.createDataFrame([(*r, 1, "a", 2, 3, "d") for r in talk(7)], SCHEMA)
    forest = prefix_trie.Forest(table)
    shards = forest.packed().collect()
    assert sum(s["nodes"] for s in shards) == forest.light.count()
    for s in shards:
        bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=2 * s["nodes"] + 1)
        assert bits.sum() == s["nodes"] and len(s["labels"]) == 16 * s["nodes"] and len(s["members"]) == 8 * s["nodes"]


def test_query_equals_sql(spark):
    import duckdb

    from docsieve.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DATA}/sf0.01/conversations.parquet')")
    want = sorted(con.execute(ORACLES["op13_prefix_trie"]).fetchall(), key=str)
    df = QUERIES["op13_prefix_trie"](spark, f"{DATA}/sf0.01")
    assert df.columns == COLUMNS and sorted(map(tuple, df.collect()), key=str) == want
