"""Near-duplicates, components and line dedup against plain versions."""

from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from docsieve.llm import line_dedup, near_dedup
from docsieve.llm.components import components


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_near_duplicates(spark, tricky, tricky_rows):
    found = near_dedup.near_duplicates(tricky).collect()
    assert len(found) == len(tricky_rows)
    distinct = {r[0]: r[1] for r in tricky_rows if r[0] is not None}
    want = brute.near_components(distinct.items())
    for i, rows in by_id(found).items():
        if i is None:
            assert all(r["component_id"] is None and r["kept"] for r in rows)
        else:
            assert {(r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {(*want[i], want[i][1] == i)}
    assert sum(v[1] == 40 for v in want.values()) == 13 and sum(v[1] == 41 for v in want.values()) > 8


def test_deduplicate(tricky, tricky_rows):
    kept = near_dedup.deduplicate(tricky)
    assert kept.columns == tricky.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    want = brute.near_components({r[0]: r[1] for r in tricky_rows if r[0] is not None}.items())
    assert sorted(ids) == sorted(i for i, v in want.items() if v[1] == i)


def test_rows_of_one_id_go_by_their_own_text(spark):
    """A row goes only for its own text; another row of its id has no part in that."""
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (5, a + " more"), (5, b), (6, c), (6, d), (6, d), (None, a), (None, None), (7, None), (7, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, rid string, best int")
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(str, [(1, a), (5, b), (6, c), (6, d), (None, a), (None, None), (7, None)]))


def test_crowd_of_near_copies_in_blocks(spark, monkeypatch):
    """Blocks give a forest of links, not a square."""
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    texts = [" ".join([*base[: 5 * i % 190], f"w{i}", *base[5 * i % 190 + 1 :]]) for i in range(60)]
    rows = near_dedup.saved(spark.createDataFrame(list(enumerate(texts)), "rid long, text string").selectExpr("rid", "rid as doc_id", "cast(text as binary) as text"))
    nodes = near_dedup.saved(near_dedup.sketches(rows).selectExpr("rid as id", "n_shingles", "sig"))
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    members = nodes.selectExpr("0 as hub", "id", "id as comp").withColumn("hub", F.col("hub").cast("long"))
    links = near_dedup._block_links(members, nodes, rows)
    assert {r["component"] for r in components(links).collect()} == {0}
    assert components(links).count() == 60 and links.count() < 700  # of 1,770 pairs


def test_empty_table(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.deduplicate(empty).columns == empty.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_shuffled_ways_agree(tricky, monkeypatch):
    """Above the broadcast bound the joins shuffle; blocks of one exercise the cutting of buckets."""
    want = sorted(map(str, near_dedup.near_duplicates(tricky).collect()))
    lines = sorted(map(str, line_dedup.dedup_lines(tricky).select("doc_id", "text", "_lines", "_removed").collect()))
    for module in (near_dedup, line_dedup):
        monkeypatch.setattr(module, "fits_broadcast", lambda rows, size: False)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    assert sorted(map(str, near_dedup.near_duplicates(tricky).collect())) == want
    assert sorted(map(str, line_dedup.dedup_lines(tricky).select("doc_id", "text", "_lines", "_removed").collect())) == lines


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = spark.createDataFrame([*chain, (7, 7), (3, 9), (9, 3), (9, 11), (None, 4)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 3: 3, 9: 3, 11: 3}
    assert components(edges.limit(0)).count() == 0


def test_line_dedup(tricky, tricky_rows):
    done = line_dedup.dedup_lines(tricky)
    assert set(tricky.columns) | {"_lines", "_removed"} == set(done.columns)
    texts = brute.without_boilerplate([(r[0], r[3], r[1]) for r in tricky_rows], line_dedup.SITES, line_dedup.MIN_CHARS)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in done.collect()))) == sorted(map(str, zip((r[0] for r in tricky_rows), texts, strict=True)))
    assert done.filter(F.col("_removed") > 0).count() >= 20


def test_long_lines_by_their_surroundings(spark):
    """A passage of over 50 words in unlike documents of one site goes from all but one; copies stay as they are."""
    passage, other, pair = (" ".join(f"{x}{i}" for i in range(60)) for x in "pqr")
    rows = [(i, f"opening {i}\n{passage}\nending {i}", "one") for i in range(4)]
    rows += [(10 + i, f"a title\n{other}", "one") for i in range(5)] + [(20 + i, f"lead {i}\n{pair}", "one") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert done == {i: t if i == 0 or i >= 10 else f"opening {i}\nending {i}" for i, t, _ in rows}


def test_line_spread_near_the_threshold(spark):
    """9, 10 and 11 sites: the sketch is not trusted there."""
    rows = [(100 * s + i, f"a line that stands on {s} different sites", f"site{i}") for s in (9, 10, 11, 40) for i in range(s)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["line"]: (r["holder"], r["spread"]) for r in line_dedup.boilerplate(docs).collect()}
    assert {int(k.split()[-3]) for k in found} == {10, 11, 40}
    assert found["a line that stands on 10 different sites"] == (1000, 10)
