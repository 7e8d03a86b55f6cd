"""Values in texts by an inverted index, and ranges over long tables, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators import containment, intervals


def pairs(spark, texts, values):
    t = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    v = spark.createDataFrame(values, "value_id long, value string").repartition(3)
    return sorted(map(tuple, containment.contained(t, v, "doc_id", "value_id").collect()))


def plain(texts, values):
    return sorted({(t, v) for t, x in texts for v, y in values if t is not None and v is not None and x is not None and y and y in x})


@pytest.mark.parametrize("window", [1 << 20, 50])
def test_values_of_all_lengths(spark, monkeypatch, window):
    monkeypatch.setattr(containment, "WINDOW", window)
    rng = random.Random(3)
    letters = "ab cé漢🙂"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    values = []
    for n in range(1, 40):
        for _ in range(4):
            source = rng.choice(texts)[1]
            at = rng.randint(0, max(0, len(source) - n))
            values.append((len(values), source[at : at + n] if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(n))))
    values += [(1000, ""), (1001, None), (None, "a"), (1002, texts[5][1]), (1003, texts[5][1] + "a")]
    texts += [(None, "ab ab"), (500, None), (7, "a second text of one id: zzzzzzzzzzzzzzzzzzzzzzzzzz"), (501, "")]
    values.append((1004, "zzzzzzzzzzzzzzzzzzzzzzz"))
    assert pairs(spark, texts, values) == plain(texts, values)


def test_many_values_and_a_common_one(spark):
    """Ten thousand words, one of which stands in all texts: pairs that match are all that is confirmed."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 20)))
    words = sorted({word() for _ in range(10_000)})
    texts = [(i, " ".join(["everywhere", *rng.sample(words, 20)])) for i in range(300)]
    values = [*enumerate(words), (20_000, "everywhere")]
    assert pairs(spark, texts, values) == plain(texts, values)


def test_empty_sides(spark):
    assert pairs(spark, [], [(1, "a")]) == [] and pairs(spark, [(1, "a")], []) == []


def test_ranges(spark):
    rng = random.Random(5)
    blocks = [(d, i, "x" * rng.randint(0, 5), rng.choice([None, i // 7])) for d in range(12) for i in range(rng.randint(0, 260)) if rng.random() < 0.995] + [(3, 5, "again", 9)]
    ranges = [(rng.randint(0, 13), n, rng.choice([None, *range(0, 200)]), rng.choice([None, *range(0, 240)])) for n in range(300)] + [(3, 400, 0, 250), (None, 401, 1, 2)]
    for i in range(300):
        d, n, s, e = ranges[i]
        if i % 3 == 0 and s is not None:
            ranges[i] = (d, n, s, s + rng.randint(0, 70))
    r = spark.createDataFrame(ranges, "doc_id long, n long, s int, e int")
    b = spark.createDataFrame(blocks, "doc_id long, block_index int, text string, page_number int")
    got = {x["n"]: tuple(x)[4:] for x in intervals.whole_ranges(r, b, "doc_id", "n", "s", "e", "block_index", "text", "page_number", width=16).collect()}
    for d, n, s, e in ranges:
        own = [x for x in blocks if d is not None and x[0] == d and s is not None and e is not None and s <= x[1] <= e]
        whole = s is not None and e is not None and s <= e and len({x[1] for x in own}) == e - s + 1
        count = len({x[1] for x in own})
        pages = [x for x in sorted(own, key=lambda x: x[1]) if x[3] is not None]
        assert got[n][:2] == (whole, count), (n, got[n])
        assert got[n][2] == (sum(len(x[2]) for x in own) if whole else None)
        if not (d == 3 and s is not None and s <= 5 <= (e or 0)):  # two blocks of one index: either page
            assert got[n][3:] == ((pages[0][3], pages[-1][3]) if whole and pages else (None, None))
    assert len(got) == 302 and intervals.whole_ranges(r.limit(0), b, "doc_id", "n", "s", "e", "block_index", "text", "page_number").count() == 0


def test_inside(spark):
    row = spark.range(1).select(*[intervals.inside(*[F.lit(x).cast("int") for x in v]).alias(f"c{i}") for i, v in enumerate([(1, 2, 0, 3), (1, 4, 0, 3), (None, 2, 0, 3), (0, 3, 0, 3)])]).first()
    assert tuple(row) == (True, False, False, True)
