"""Token counts and packing against the tokenizer library."""

from __future__ import annotations

import time
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docsieve.llm import packing, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts(tricky, tricky_rows, library):
    got = sorted(map(str, (tuple(r) for r in token_count.token_counts(tricky).collect())))
    sizes = {t: len(library.encode(t or "", add_special_tokens=False).ids) for t in {r[1] for r in tricky_rows}}
    assert got == sorted(str((r[0], len((r[1] or "").encode()), sizes[r[1]], sizes[r[1]] > 512)) for r in tricky_rows)


def test_counts_of_all_documents(docs, library):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {i: len(e.ids) for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs).collect()} == want


_ODD = st.text(st.sampled_from(list("ab  \n\n\t\r'.sS19é漢🙂  \u0085\x1c<|>")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(_ODD)
def test_any_text(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "library") else test_any_text.library
    test_any_text.library = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert token_count.Counter(PATH).counts([text.encode()]) == [len(ids)]
    encoder = packing._encoder(PATH)
    assert encoder.encode([text.encode()])[0].tolist() == [*ids, 0]


def check_packing(rows, texts, library):
    """Pieces are the library's ids, sequences are gapless and within the limit; returns the number of sequences."""
    want = []
    for key, text in texts:
        for piece, start, ids in brute.pieces([*library.encode(text or "", add_special_tokens=False).ids, 0], packing.LENGTH):
            want.append((key, piece, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    return len(bins), sum(r["length"] for r in rows)


def test_packing(tricky, tricky_rows, library):
    rows = packing.pack_documents(tricky).collect()
    check_packing(rows, [(r[0], r[1]) for r in tricky_rows], library)


def test_packing_is_tight(docs, library):
    rows = packing.pack_documents(docs).collect()
    n, total = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    assert n <= 1.02 * -(-total // packing.LENGTH) + 1


def test_plan_places_every_rank():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(s): int(c) for s, c in zip(rng.choice(np.arange(1, 2049), 30, replace=False), rng.integers(1, 9, 30), strict=True)}
        used = defaultdict(list)
        for size, low, high, first, per_bin, offset in packing.plan(counts):
            for r in range(low, high):
                used[first + (r - low) // per_bin].append((offset + (r - low) % per_bin * size, size))
        assert sum(map(len, used.values())) == sum(counts.values())
        for own in used.values():
            own.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 2048
            assert sum(3 * n > 2048 for _, n in own) <= 2


def test_long_unbroken_texts(spark, library):
    """Runs without a cut go through the queue of places; a million letters take seconds."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(a), n)) for a in ("ab", "abcdefghijklmnop", "éx漢🙂") for n in (191, 192, 193, 700, 20_000)]
    texts += ["a" * n for n in (300, 301, 20_001)] + [" ".join(texts[:6])]
    counter = token_count.Counter(PATH)
    assert counter.counts([t.encode() for t in texts]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    merges = token_count._merges(PATH)
    tokens = [t.encode() for t in texts[:4]]
    assert merges._queued(tokens).tolist() == [merges.lengths([t])[0] if len(t) < token_count.LONG else merges._queued([t])[0] for t in tokens]
    start = time.perf_counter()
    docs = spark.createDataFrame([(1, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000)))], "doc_id long, text string")
    assert token_count.token_counts(docs).first()["n_tokens"] > 500_000 and time.perf_counter() - start < 60


def test_empty(empty):
    assert packing.pack_documents(empty).count() == 0
    assert token_count.token_counts(empty).count() == 0
