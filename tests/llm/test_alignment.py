"""Alignment of two tokenizers against a version that walks every text byte by byte."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import public_tokenizers as public
import sentencepiece
from tokenizers import Tokenizer

from docsieve.llm import alignment
from docsieve.llm.pieces import stand_ins

A = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
OF = {c: b for b, c in stand_ins().items()}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a ▁ b", "<0x41> <s> </s> <unk>", "▁", "  two  spaces \n\n and\nlines\n", "\n", " ", "x\r\ny", "a\x1cb c\x85d e", "<|endoftext|>", "漢字 かな\n🙂🙂 ñ", "\x00 a", "it's  don't\t\tx", "1234567 890", "é ﬁ ①", "a" * 5000]


def tokens(text):
    """(id, bytes) of both sides on the whole text, by the libraries."""
    a = A.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(OF[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    right = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def plain(rows):
    """What align_documents returns, for (doc_id, text) rows."""
    parts, held = [], Counter()
    for doc, text in rows:
        left, right = tokens(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(b for _, b in left) != whole or b"".join(b for _, b in right) != whole:
            parts.append((doc, 0, 0, [], []))
            continue
        owner = [[i for i, (_, b) in enumerate(side) for _ in b] for side in (left, right)]
        pairs = sorted(set(zip(*owner, strict=True)))
        links = [(left[i][0], right[j][0]) for i, j in pairs]
        groups, i, j = [], 0, 0
        for at in range(len(whole)):  # a group ends where both owners change
            if at + 1 == len(whole) or (owner[0][at] != owner[0][at + 1] and owner[1][at] != owner[1][at + 1]):
                groups.append((left[i : owner[0][at] + 1], right[j : owner[1][at] + 1]))
                i, j = owner[0][at] + 1, owner[1][at] + 1
        held.update(set(links))
        parts.append((doc, len(left), len(right), groups, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for doc, n_a, n_b, groups, links in parts:
        text = ";".join(",".join(str(i) for i, _ in x) + "|" + ",".join(str(i) for i, _ in y) for x, y in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


def got(docs, **more):
    return sorted((tuple(r) for r in alignment.align_documents(docs, **more).select(*COLUMNS).collect()), key=str)


def test_against_plain(spark, tricky, tricky_rows):
    assert got(tricky) == plain([(r[0], r[1]) for r in tricky_rows])


def test_whole_table(spark, docs):
    assert got(docs) == plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", range(3))
def test_odd_texts(spark, seed):
    rng = random.Random(seed)
    bits = ["a", "b ", " c", "\n", "  ", "\t", "▁", "é", "漢", "🙂", "<s>", "<0x0A>", "12", "'s", ".", " ", " ", "\x1f", "word", " the"]
    texts = [*ODD, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain(rows)


def test_links_dealt_out_to_many_tasks(spark, docs):
    """Stripes are shared by many tasks, each with a copy of the matrix: the same rows."""
    some = docs.limit(150)
    rows = [(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()]
    few = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(few, stripes=7, scored_bytes=2_000) == plain(rows)


def test_partial_counts_and_forgetting(spark, monkeypatch):
    """Pieces are forgotten between slices, and counts leave a task in several parts."""
    aligner = alignment.Aligner(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "KEPT", 3)
    for text in ODD * 2:
        (n_a, n_b, n_groups, n_links, groups), = aligner.align([text.encode()])[0]
        assert (n_a, n_b, n_groups, n_links) == plain([(0, text)])[0][1:5] and len(groups.split(";")) == max(1, n_groups)
    assert aligner.align([b"\xff not utf-8"])[0] == [(0, 0, 0, 0, "")]


def test_empty(empty):
    assert got(empty) == []


def test_tokenizers_get_bounded_runs_of_pieces(monkeypatch):
    """What they return for a piece is many times as large as the piece: a slice of new words is not given to them at once."""
    monkeypatch.setattr(alignment, "SETTLED", 7, raising=False)
    aligner, sizes = alignment.Aligner(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")), []

    class Counted:
        def encode_batch_fast(self, pieces, **how):
            sizes.append(len(pieces))
            return A.encode_batch_fast(pieces, **how)

    text = " ".join(f"word{i}" for i in range(100))
    whole = aligner.align([text.encode(), b"", "a ▁ b".encode()])
    aligner.forget()
    aligner.a = Counted()
    again = aligner.align([text.encode(), b"", "a ▁ b".encode()])
    assert whole[0] == again[0] and (whole[1] == again[1]).all() and (whole[2] == again[2]).all()
    assert max(sizes) == 7 and sum(sizes) > 100


def test_slices_are_aligned_in_parts(spark, monkeypatch):
    """Numbers of documents run on over the parts of a slice; an idle worker gives back what the pieces took."""
    import pyarrow as pa

    rows = [(i, x) for i, x in enumerate(ODD * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([x.encode() for _, x in rows])], ["doc_id", "text"])
    monkeypatch.setattr(alignment, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": staticmethod(lambda: 0)}))}))
    calls, kept = [], []
    monkeypatch.setattr(alignment, "release", lambda: kept.append(len(alignment._aligner(*paths).groups)), raising=False)
    paths = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    step = alignment._align(*paths, 8)
    whole = [x.to_pylist() for x in step([batch])]
    own = alignment.Aligner.align
    monkeypatch.setattr(alignment, "ALIGNED", 50, raising=False)
    monkeypatch.setattr(alignment.Aligner, "align", lambda self, texts: calls.append(len(texts)) or own(self, texts))
    assert [x.to_pylist() for x in step([batch])] == whole
    assert len(calls) > 5 and sum(calls) == len(rows) and kept == [0, 0]
