"""Plain versions of what the corpus operators compute, one text at a time."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(rows):
    """[(doc_id, text)] with distinct ids -> doc_id -> (set size, least id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    owners = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            owners[s].append(i)
    shared = Counter()
    for own in owners.values():
        shared.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def benchmark_hits(text, items):
    """Word count, hit words, items with occurring windows."""
    w = ALNUM.findall((text or "").encode().lower())
    hit, found = set(), set()
    for item, item_text in items:
        v = ALNUM.findall((item_text or "").encode().lower())
        k = min(10, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    return len(w), len(hit), found


def quality_counts(text):
    text = text or ""
    w = [x.decode() for x in WORD.findall(text.encode())]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    repeated = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)]


def without_boilerplate(rows, sites, min_chars, spaces=50, surroundings=3):
    """[(doc_id, source, text)] -> texts in order."""
    spread, holder = defaultdict(set), {}
    for i, source, text in rows:
        lines = text.split("\n") if text is not None else []
        for at, line in enumerate(lines):
            if len(line) >= min_chars:
                around = (lines[at - 1] if at else None, lines[at + 1] if at + 1 < len(lines) else None)
                spread[line].add(around if line.count(" ") >= spaces else source or "")
                if i is not None:
                    holder[line] = min(holder.get(line, i), i)
    gone = {line for line, s in spread.items() if len(s) >= (surroundings if line.count(" ") >= spaces else sites)}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in gone or holder.get(x) == i) for i, _, t in rows]


def base_scores(rows, training):
    """[(key, text)] and training texts -> key -> (tokens, known tokens, base score), and the training tokens."""
    counts = Counter()
    for t in training:
        counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for key, t in rows:
        tokens = [*words(t), None]
        out[key] = (len(tokens), sum(counts[x] > 0 for x in tokens), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens))
    return out, n


def pieces(ids, length):
    """(piece, start, ids) of a document's ids, the first piece the remainder."""
    first = len(ids) % length or min(length, len(ids))
    starts = [0, *range(first, len(ids), length)]
    return [(i, s, ids[s : (starts[i + 1] if i + 1 < len(starts) else len(ids))]) for i, s in enumerate(starts)]
