from __future__ import annotations

import random

import pytest
from paths import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` int, `key` string, `_entities` string, n int, `line` string, shard int, `first` long"
VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstvz"


def prose(rng, n):
    word = lambda: "".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))
    stock = [word() for _ in range(400)]
    return " ".join(rng.choice(stock) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def rows():
    """Prose with exact and near copies, shared lines and passages, and every awkward case."""
    rng = random.Random(5)
    shared = "This boilerplate line stands on many sites. " + prose(rng, 8)
    few = "This other line stands on few sites. " + prose(rng, 8)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(60)]
    for i in range(24):
        texts[i] = texts[i] + "\n" + shared + "\n" + prose(rng, 20)
    for i in range(24, 30):
        texts[i] = texts[i] + "\n" + few
    texts += [texts[40]] * 12  # a group of copies
    near = texts[41].split()
    for i in range(12):  # near copies: one word each
        copy = list(near)
        copy[3 * i + 2] = f"word{i}"
        texts.append(" ".join(copy))
    texts += ["a b c", "A B C", "one", "x " * 40, "tab\tand\x0bvt  \n\n  end ", "<|endoftext|> a <|endoftext|>", "naïve Ελλάδα 漢字テスト 🙂 пример", " nbsp em space", "", "   ", "\n\n", "🙂" * 50, prose(rng, 30000)]
    out = [(i, t, "en", f"site{i % 16}", len(t)) for i, t in enumerate(texts)]
    n = len(out)
    out += [(n, None, None, None, None), (None, prose(rng, 40), None, None, None), (None, None, "en", "s", 0), (n + 1, None, "de", None, 3)]
    out += [out[3], out[3], (n, None, None, None, None)]  # repeated rows
    return [(*r, 1, "k", "e", 2, "l", 3, 4) for r in out]


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def tricky_rows():
    return rows()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
