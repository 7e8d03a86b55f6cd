"""MinHash near-duplicate detection: hash minima, banding, verification on full sets, components.

A document's set holds its distinct 5-word shingles. Documents with equal sets are joined by a fingerprint
of the set first, so that a group of copies is one node from then on. Nodes that share a band of their
signature are candidates. Within a bucket no pairs are spelled out. First every member meets the bucket's
most central node, the one with most candidates overall, which joins most buckets to one component. In
buckets that it does not join, the members outside the largest component are a query set against all other
members; both are cut into blocks, and each pair of blocks is compared in arrays inside a task. A signature
estimate drops hopeless pairs (six standard deviations below the threshold), all others are compared on
their full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import blobs, boxed, fits_broadcast, hash_words, saved, slices, text_bytes, unboxed, window_hashes
from docsieve.llm.components import components

SHINGLE = 5
BANDS, BAND_ROWS = 32, 4
#: Pairs below this share of equal signature slots are not compared in full: at a similarity of 0.75 a
#: share under 0.5 lies 6.5 standard deviations out.
ESTIMATE = 0.5
#: Nodes in a block, and shingles of its texts, about.
BLOCK, BLOCK_SHINGLES = 256, 500_000

_SEEDS = np.random.default_rng(20240229)
_A = _SEEDS.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEEDS.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(SHINGLE, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum for each universal hash function (a * x + b, its upper 32 bits)."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = _A[:, None] * shingles[None, at : at + 2048]
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, prints, signatures = [], [], []
        for text in blobs(batch):
            shingles = shingle_set(hash_words(text.lower().split()))
            counts.append(len(shingles))
            prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            signatures.append(signature(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], ["rid", "doc_id", "n_shingles", "print", "sig"])


def sketches(rows: DataFrame) -> DataFrame:
    """Per row (rid, doc_id, text): n_shingles, the set's fingerprint and its signature (both null for an empty set)."""
    return rows.mapInArrow(_sketch, "rid long, doc_id long, n_shingles long, print binary, sig binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, id) for each band of each node's signature."""
    width = 4 * BAND_ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(BANDS)])
    return nodes.select("id", F.explode(keys).alias("key"))


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()] for c in ("sig_a", "sig_b"))
        keep = [bool((x == y).mean() >= ESTIMATE) for x, y in zip(a, b, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
    for batch in slices(batches, "text_b"):
        keep = []
        for x, y in zip(blobs(batch, "text_a"), blobs(batch, "text_b"), strict=True):
            if last[0] != x:
                last = (x, shingle_set(hash_words(x.lower().split())))
            other = shingle_set(hash_words(y.lower().split()))
            shared = len(np.intersect1d(last[1], other, assume_unique=True))
            keep.append(shared > 0 and 100 * shared >= 75 * (len(last[1]) + len(other) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the distinct ``id``s, which are broadcast if their measured number allows."""
    ids = ids.select(F.col("id").alias(key))
    return rows.join(F.broadcast(ids) if fits_broadcast(ids.count(), 16) else ids, key, "left_semi")


def _bodies(ids: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, sig, text) of some nodes: what pairs are compared by."""
    ids = saved(ids.distinct())
    return saved(_only(rows.select(F.col("rid").alias("id"), "text"), ids, "id").join(_only(nodes.select("id", "sig"), ids, "id"), "id"))


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough. Pairs of one ``a`` may be many:
    they are split into parts of about BLOCK pairs, each of which meets its own copy of ``a``."""
    pairs = saved(pairs)
    heavy = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).filter("parts > 1"))
    heavy = F.broadcast(heavy) if fits_broadcast(heavy.count(), 32) else heavy
    bodies = _bodies(pairs.select(F.explode(F.array("a", "b")).alias("id")), nodes, rows)
    parts = F.coalesce("parts", F.lit(1).cast("long"))

    def meet(own: DataFrame, what: str) -> DataFrame:
        """Pairs with ``what`` of both sides."""
        left = own.join(heavy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
        hubs = bodies.select(F.col("id").alias("a"), F.col(what).alias(f"{what}_a")).join(pairs.select("a").distinct(), "a", "left_semi")
        copies = hubs.join(heavy, "a", "left").select("a", f"{what}_a", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        return left.join(bodies.select(F.col("id").alias("b"), F.col(what).alias(f"{what}_b")), "b").join(copies, ["a", "part"]).select("a", "b", f"{what}_a", f"{what}_b")

    likely = saved(meet(pairs, "sig").mapInArrow(_alike, "a long, b long"))
    return meet(likely, "text").mapInArrow(_confirm, "a long, b long").distinct()


def _links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all similar pairs of nodes."""
    bands = band_keys(nodes)
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = saved(bands.join(shared, "key").select("key", "id", "n"))
    central = members.groupBy("id").agg(F.sum("n").alias("w"))
    ranked = members.join(central, "id").select("key", "id", F.struct("w", -F.col("id")).alias("w"))
    middle = ranked.groupBy("key").agg(F.max("w").alias("w")).select("key", (-F.col("w.col2")).alias("middle"))
    met = saved(members.select("key", "id").join(middle, "key").filter("id <> middle"))
    pairs = met.select(F.col("middle").alias("a"), F.col("id").alias("b")).distinct()
    links = saved(confirmed(pairs, nodes, rows))
    comp = saved(components(links))
    # members of buckets that are not in one component; the middle has met all others of its bucket
    state = met.select("key", "id").join(comp, met.id == comp.node, "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    sizes = state.groupBy("key", "comp").agg(F.count("*").alias("n"))
    hubs = sizes.groupBy("key").agg(F.max(F.struct("n", -F.col("comp"))).alias("w"), F.count("*").alias("comps")).filter("comps > 1").select("key", (-F.col("w.col2")).alias("hub"))
    open_ = saved(state.join(hubs, "key").select("hub", "id", "comp").distinct())
    return links if open_.isEmpty() else links.unionByName(saved(_block_links(open_, nodes, rows)))


def _block_links(members: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links among ``members`` (hub, id, comp): those outside the hub's component against all. A block has about
    BLOCK nodes, or BLOCK_SHINGLES shingles where these are long."""
    queries, targets = members.filter("comp <> hub"), members
    sized = members.join(nodes.select("id", "n_shingles"), "id")
    many = lambda rows, size: F.ceil(F.greatest(rows / BLOCK, F.coalesce(size, F.lit(0)) / BLOCK_SHINGLES))
    query = F.col("comp") != F.col("hub")
    parts = sized.groupBy("hub").agg(many(F.count_if(query), F.sum(F.when(query, F.col("n_shingles")))).alias("qs"), many(F.count("*"), F.sum("n_shingles")).alias("ts"))
    spot = F.xxhash64("id", F.lit("block"))
    q = queries.join(parts, "hub").select("hub", F.pmod(spot, "qs").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ts") - 1)).alias("tb"), F.lit(True).alias("query"), "id", "comp")
    t = targets.join(parts.filter("qs > 0"), "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)).alias("qb"), F.pmod(spot, "ts").alias("tb"), F.lit(False).alias("query"), "id", "comp")
    met = q.unionByName(t).join(_bodies(members.select("id"), nodes, rows), "id").select("hub", "qb", "tb", "query", "id", "comp", "sig", "text")
    return met.repartition("hub", "qb", "tb").sortWithinPartitions("hub", "qb", "tb").mapInArrow(_compare_blocks, "a long, b long").distinct()


def _compare_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block pair; a block pair may go over batches."""
    block, held, found = None, [], []
    for batch in slices(batches):
        for row in batch.to_pylist():
            at = (row["hub"], row["qb"], row["tb"])
            if at != block:
                found += _similar(held)
                block, held = at, []
            held.append(row)
        if found:
            yield _edges(found)
            found = []
    yield _edges(found + _similar(held))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def _similar(rows: list[dict]) -> list[tuple[int, int]]:
    """Links between components of the block whose sets are similar: as many as join what is joined by all pairs
    of a query and a target of another component, so a crowd of similar texts gives no square of links."""
    qs, ts = [r for r in rows if r["query"]], [r for r in rows if not r["query"]]
    if not qs or not ts:
        return []
    sig_t = np.stack([np.frombuffer(r["sig"], np.uint32) for r in ts])
    comp_t, hub = np.array([r["comp"] for r in ts]), rows[0]["hub"]
    id_t = np.array([r["id"] for r in ts])
    hopeful = []
    for i, r in enumerate(qs):
        likely = (sig_t == np.frombuffer(r["sig"], np.uint32)).mean(axis=1) >= ESTIMATE
        # a pair of two queries comes twice: the lesser asks
        likely &= (comp_t != r["comp"]) & ((comp_t == hub) | (id_t > r["id"]))
        if likely.any():
            hopeful.append((i, np.flatnonzero(likely)))
    if not hopeful:
        return []
    shingles = lambda r: shingle_set(hash_words(r["text"].lower().split()))
    wanted = np.unique(np.concatenate([x for _, x in hopeful]))
    sets = [shingles(ts[j]) for j in wanted]
    sizes = np.array([len(x) for x in sets])
    known, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out, joined = [], _Joined()
    for i, likely in hopeful:
        likely = likely[[joined.top(int(comp_t[j])) != joined.top(qs[i]["comp"]) for j in likely]]
        if not len(likely):
            continue
        own = shingles(qs[i])
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        mark = np.zeros(len(known), np.int64)
        mark[at[known[at] == own]] = 1
        shared = np.add.reduceat(mark[inverse], starts)
        alike = 100 * shared >= 75 * (len(own) + sizes - shared)
        for k in wanted[np.flatnonzero(alike & np.isin(wanted, likely))]:
            if joined.join(qs[i]["comp"], int(comp_t[k])):
                out.append((qs[i]["id"], int(id_t[k])))
    return out


class _Joined:
    """Which components of a block its links have joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.top(x), self.top(y)))
        if x != y:
            self.up[y] = x
        return x != y


def _judged(rows: DataFrame) -> DataFrame:
    """Per row (rid, doc_id, text): rid, doc_id, n_shingles, and ``best``: the least (id, rid) of its group.

    Nodes are numbered by rows, not by ids, so rows that repeat an id are judged by their own texts. Rows without
    an id are a group of their own; rows without a shingle are one with those of the same id.
    """
    feats = saved(sketches(rows))
    full = feats.filter("print is not null and doc_id is not null")
    groups = saved(full.groupBy("print").agg(F.min(F.struct(F.col("doc_id").alias("id"), "rid")).alias("best"), F.count("*").alias("n")))
    shared = groups.filter("n > 1").select("print", F.col("best.rid").alias("first"))
    marked = full.join(F.broadcast(shared) if fits_broadcast(shared.count(), 48) else shared, "print", "left")
    nodes = saved(marked.filter("first is null or first = rid").select(F.col("rid").alias("id"), "n_shingles", "sig"))
    comp = saved(components(_links(nodes, rows)))
    placed = saved(groups.join(comp, groups["best.rid"] == comp.node, "left").select("print", "best", "component"))
    least = placed.filter("component is not null").groupBy("component").agg(F.min("best").alias("least"))
    least = F.broadcast(least) if fits_broadcast(comp.count(), 48) else least
    of_print = placed.join(least, "component", "left").select("print", F.coalesce("least", "best").alias("best"))
    linked = full.select("rid", "doc_id", "n_shingles", "print").join(of_print, "print").select("rid", "doc_id", "n_shingles", "best")
    nameless = feats.filter("doc_id is null").select("rid", "doc_id", "n_shingles", F.struct(F.col("doc_id").alias("id"), "rid").alias("best"))
    empty = feats.filter("print is null and doc_id is not null").select("rid", "doc_id", "n_shingles")
    first = empty.groupBy("doc_id").agg(F.min("rid").alias("first"))
    return linked.unionByName(nameless).unionByName(empty.join(first, "doc_id").select("rid", "doc_id", "n_shingles", F.struct(F.col("doc_id").alias("id"), F.col("first").alias("rid")).alias("best")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Nulls and empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id are judged
    by their own texts, and linked by them alone. A null doc_id takes no part: its component_id is null and it is
    kept. Other columns of ``docs`` are not looked at. An empty table gives an empty table.
    """
    rows = saved(text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("rid", F.monotonically_increasing_id()))
    judged = _judged(rows).select("doc_id", "n_shingles", F.col("best.id").alias("component_id"))
    return judged.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one with the least doc_id.

    Rows are numbered when they are written, and dropped by number. So of rows that repeat a doc_id, each goes or
    stays by its own text: repeated texts (nulls and empty ones too) are reduced to one row, other texts stay. Null
    and empty texts of distinct ids, and all rows with a null doc_id, stay. The columns are unchanged; an empty table gives an empty table.
    """
    raw = saved(boxed(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("rid", F.monotonically_increasing_id()))
    gone = saved(_judged(raw.select("rid", "doc_id", "text")).filter(F.col("best.rid") != F.col("rid")).select("rid"))
    few = fits_broadcast(gone.count(), 16)
    return unboxed(raw.join(F.broadcast(gone) if few else gone, "rid", "left_anti"), docs)
