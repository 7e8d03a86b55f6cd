"""Exact top-k search by integer inner product in KD-trees, one for each shard of the vectors.

Equal vectors become one point that carries its k + 1 least rows: no more of them can stand in any answer, and a vector
that fills a third of the table is one point. Points are dealt to shards by the upper levels of a KD-tree, whose
planes are medians of a bounded sample of points; the sample decides where points lie, never which are found. A task
builds the tree of a shard from whole points: median splits of the widest side, a tight box around every node.

A query walks a tree best first: the inner product with a box is at most that with the corner that the signs of the
query name, nodes wait on a heap by this bound, and the walk ends at a bound below the k-th score so far. Each
query walks the shard that it lies in first; the k-th score found there goes with it, and only to shards whose
whole box does not stay below that score. Shards and queries meet by a keyed exchange; a shard that many queries ask for
is built by several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import saved, spread

#: Components are multiplied by this and rounded down.
SCALE = 64.0
K = 20
#: Points of one shard: at most, and at least where there are cores to spare; points of a leaf.
SHARD_ROWS, LEAST_ROWS, LEAF = 65_536, 4_096, 256
#: Points whose medians place the planes between shards.
SAMPLE = 8_192
#: Queries that one task takes through a shard, and that have their bounds worked out at once.
ASKED, AT_ONCE = 65_536, 512
#: Boxes of shards that are sent to all tasks at once; more go in further passes.
BOXES = 8_192
#: Products are exact in floating point below this.
EXACT = float(1 << 53)

_STEP = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Tree:
    """A KD-tree over the rows of ``points`` (whole numbers): median splits of the widest side, tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.range, self.child = [], [], [], []
        waiting = [(0, len(points), -1)]
        while waiting:
            start, stop, parent = waiting.pop()
            rows = self.points[self.order[start:stop]]
            node = len(self.range)
            self.low.append(rows.min(axis=0))
            self.high.append(rows.max(axis=0))
            self.range.append((start, stop))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(node)
            if stop - start > leaf:
                side = int(np.argmax(self.high[-1].astype(float) - self.low[-1]))
                middle = (stop - start) // 2
                self.order[start:stop] = self.order[start:stop][np.argpartition(rows[:, side], middle)]
                waiting += [(start, start + middle, node), (start + middle, stop, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.by_leaf = np.ascontiguousarray(self.points[self.order])
        self.largest = float(np.abs(self.points.astype(float)).max(initial=0))

    def search(self, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the scores and points of its ``k`` best among those with ``least`` or more, ties to the smaller
        point number."""
        exact = self.largest * float(np.abs(queries.astype(float)).max(initial=0)) * queries.shape[1] < EXACT
        leaves = self.by_leaf.astype(float) if exact else self.by_leaf
        for i in range(0, len(queries), AT_ONCE):
            part = queries[i : i + AT_ONCE]
            bounds = upper_bounds(part, self.low, self.high, exact)
            for q, row, floor in zip(part.astype(float) if exact else part, bounds.tolist(), least[i : i + AT_ONCE].tolist(), strict=True):
                yield self._walk(leaves, q, row, floor, k)

    def _walk(self, leaves: np.ndarray, q: np.ndarray, bounds: list[float], kth: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if self.child[node]:
                for c in self.child[node]:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            start, stop = self.range[node]
            here = leaves[start:stop] @ q
            good = np.flatnonzero(here >= kth)
            if len(good):
                scores = np.concatenate((scores, here[good].astype(np.int64)))
                found = np.concatenate((found, self.order[start:stop][good]))
                best = np.lexsort((found, -scores))[:k]
                scores, found = scores[best], found[best]
                if len(scores) == k:
                    kth = max(kth, float(scores[-1]))
        return scores, found


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray, exact: bool) -> np.ndarray:
    """(queries x boxes) the most that an inner product with a point of the box can be."""
    q, low, high = queries.astype(float), low.astype(float), high.astype(float)
    out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return out if exact else out + 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def planes(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(side, cut) of every node of the upper levels, in heap order."""
    sides, cuts = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1, np.int64)
    parts = {0: sample}
    for node in range(len(sides)):
        rows = parts.pop(node)
        if len(rows):
            sides[node] = np.argmax(rows.max(axis=0).astype(float) - rows.min(axis=0))
            side = np.sort(rows[:, sides[node]])
            cuts[node] = side[(len(side) - 1) // 2]
        right = rows[:, sides[node]] > cuts[node] if len(rows) else np.zeros(0, bool)
        parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
    return sides, cuts


def _place(sides: np.ndarray, cuts: np.ndarray, levels: int, width: int) -> _STEP:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _dense(batch.column("v"), width)
            node = np.zeros(len(points), np.int64)
            for _ in range(levels):
                node = 2 * node + 1 + (points[np.arange(len(points)), sides[node]] > cuts[node])
            yield batch.append_column("cell", pa.array(node))

    return place


def _hits(scores: np.ndarray, found: np.ndarray, rows: list, k: int) -> list[dict]:
    """The ``k`` first rows of the points found, by score, id (null last) and number."""
    out = [(-s, r["last"], r["id"], r["no"]) for s, p in zip(scores.tolist(), found.tolist(), strict=True) for r in rows[p]]
    out.sort(key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
    return [{"score": -s, "id": i, "no": n} for s, _, i, n in out[:k]]


_HIT = "array<struct<score: long, id: long, no: long>>"
_HITS = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64()), ("no", pa.int64())]))


def _shards(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[object, np.ndarray, list, pa.RecordBatch | None]]:
    """From rows sorted by shard, share and kind: for each batch of queries (kind 1) the points (kind 0) before them."""
    now, held, ready = None, [], None
    for batch in batches:
        shards, shares, kinds = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("shard", "share", "kind"))
        edges = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(shares) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:], strict=False):
            if start == stop:
                continue
            part, at = batch.slice(start, stop - start), (shards[start], shares[start])
            if at != now:
                now, held, ready = at, [], None
            if kinds[start] == 0:
                held.append(part)
                continue
            if ready is None:
                ready = _ordered(held, width)
                held = []
            yield (*ready, part)


def _ordered(held: list[pa.RecordBatch], width: int) -> tuple[Tree, list]:
    """The tree of a shard and the rows of its points; points are in the order of their first rows, so that ties go to
    the smaller number."""
    points = np.concatenate([_dense(b.column("v"), width) for b in held])
    rows = [r for b in held for r in b.column("rows").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0]["last"], rows[i][0]["id"] or 0, rows[i][0]["no"]))
    return Tree(points[order]), [rows[i] for i in order]


def _visit(width: int, k: int) -> _STEP:
    """Rows sorted by shard, share and kind -> (key, hits) of each query; the row before the first k-th is its floor."""

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, rows, asked in _shards(batches, width):
            least = np.array([-np.inf if x is None else x for x in asked.column("kth").to_pylist()], float)
            hits = [_hits(s, f, rows, k) for s, f in tree.search(_dense(asked.column("v"), width), least, k)]
            yield pa.RecordBatch.from_arrays([asked.column("key"), pa.array(hits, _HITS)], ["key", "hits"])

    return visit


def _boxes(width: int) -> _STEP:
    """(shard, v) -> (shard, low, high) of each batch's points; boxes of a shard are joined later."""

    def boxes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, shards = _dense(batch.column("v"), width), batch.column("shard").to_numpy()
            order = np.argsort(shards, kind="stable")
            names, first = np.unique(shards[order], return_index=True)
            if len(names):
                low, high = (f.reduceat(points[order], first, axis=0) for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(low), pa.list_(pa.int64())), pa.array(list(high), pa.list_(pa.int64()))], ["shard", "low", "high"])

    return boxes


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial boxes sorted by shard -> one box a shard."""
    now = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.list_(pa.int64())), pa.array([now[2]], pa.list_(pa.int64()))], ["shard", "low", "high"])

    for batch in batches:
        for shard, low, high in zip(*(batch.column(c).to_pylist() for c in ("shard", "low", "high")), strict=True):
            if now and now[0] != shard:
                yield out()
                now = None
            now = (shard, np.minimum(now[1], low), np.maximum(now[2], high)) if now else (shard, np.array(low), np.array(high))
    if now:
        yield out()


def _further(names: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> _STEP:
    """(shard, key, v, kth) of a query in its own shard -> the same for every other shard that can hold as good a score."""

    def further(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            queries = _dense(batch.column("v"), width)
            least = np.array([-np.inf if x is None else x for x in batch.column("kth").to_pylist()], float)
            own = batch.column("shard").to_numpy()
            bounds = upper_bounds(queries, low, high, False)
            who, where = np.nonzero((bounds >= least[:, None]) & (own[:, None] != names[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(names[where]), *(batch.column(c).take(pa.array(who)) for c in ("key", "v", "kth"))], ["shard", "key", "v", "kth"])

    return further


def whole_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, no, v): the rows whose vector has neither null nor non-finite components, rounded down, with a number."""
    x = F.col(column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = spread(vectors.select(F.col(key).cast("long").alias("id"), x.alias(column))).filter(x.isNotNull() & finite)
    v = F.transform(x, lambda e: F.floor(F.lit(SCALE) * e.cast("double")).cast("long"))
    return rows.select("id", v.alias("v"), F.monotonically_increasing_id().alias("no"))


def top_k(vectors: DataFrame, every: int = 20, k: int = K, key: str = "vec_id", column: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of each row whose id is divisible by ``every``.

    Scores are inner products of floor(64 x), exact in 64 bits (beyond them they wrap round); ties go to the smaller id,
    null ids last. Rows whose vector is null or holds null or non-finite components take no part; a shorter vector counts
    as ending in zeros. Rows without an id are found and never ask; rows that repeat an id, or an id and a vector, are
    rows of their own, of which a query leaves out itself alone. Fewer than ``k`` other rows give all of them. Other
    columns are not looked at; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = saved(whole_vectors(vectors, key, column))
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    # of equal vectors the k + 1 least rows can be in an answer, which leaves out one
    first = Window.partitionBy("v", "asks").orderBy(F.col("id").asc_nulls_last(), "no")
    kept = rows.withColumn("asks", asks).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    listed = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("last"), "id", "no")))
    points = saved(kept.groupBy("v").agg(F.slice(listed, 1, k + 1).alias("rows"), F.bool_or("asks").alias("asks")).withColumn("key", F.monotonically_increasing_id()))
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], max(1, size["width"] or 0)
    shard_rows = shard_rows or min(SHARD_ROWS, max(LEAST_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))
    levels = min((max(1, -(-n // shard_rows)) - 1).bit_length(), (SAMPLE // 8).bit_length() - 1)
    sample = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow().combine_chunks() if levels else None
    sides, cuts = planes(_dense(sample.column("v").combine_chunks(), width), levels) if levels else (np.zeros(0, np.int64),) * 2
    placed = points.mapInArrow(_place(sides, cuts, levels, width), "v array<long>, rows array<struct<last: boolean, id: long, no: long>>, asks boolean, key long, cell long")
    # a cell that holds more than its share (coordinates with few values) is dealt out by number
    shares = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * shard_rows)).alias("shares"))
    in_cell = F.pmod(F.xxhash64("key"), F.col("shares"))
    points = saved(placed.join(shares, "cell").select(F.shiftleft("cell", 32).bitwiseOR(in_cell).alias("shard"), "key", "v", "rows", "asks"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_rows))
    tree_rows = points.select("shard", F.lit(0).alias("kind"), "key", "v", "rows", F.lit(None).cast("long").alias("kth"))

    def walk(asked: DataFrame, shares: DataFrame | None) -> DataFrame:
        """(key, hits) of the queries ``asked`` (shard, key, v, kth); a shard is built once for each of its shares."""
        asked = asked.select("shard", F.lit(1).alias("kind"), "key", "v", F.lit(None).cast(points.schema["rows"].dataType).alias("rows"), "kth")
        if shares is None:
            both = tree_rows.unionByName(asked).withColumn("share", F.lit(0))
        else:
            each = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
            trees = tree_rows.join(shares, "shard").select(*tree_rows.columns, each)
            both = trees.unionByName(asked.join(shares, "shard").select(*asked.columns, F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share")))
        both = both.repartition(parts, "shard", "share").sortWithinPartitions("shard", "share", "kind")
        return both.mapInArrow(_visit(width, k + 1), f"key long, hits {_HIT}")

    asking = points.filter("asks").select("shard", "key", "v", F.lit(None).cast("long").alias("kth"))
    home = saved(walk(asking, None))
    kth = F.when(F.size("hits") == k + 1, F.element_at("hits", -1)["score"])
    carried = asking.drop("kth").join(home.select("key", kth.alias("kth")), "key").select("shard", "key", "v", "kth")
    boxes = points.select("shard", "v").mapInArrow(_boxes(width), "shard long, low array<long>, high array<long>")
    boxes = saved(boxes.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_joined, "shard long, low array<long>, high array<long>"))
    found = home
    passes = -(-boxes.count() // BOXES)
    for i in range(passes):
        some = boxes.filter(F.pmod(F.xxhash64("shard"), F.lit(passes)) == i).toArrow().combine_chunks()
        if some.num_rows:
            names, low, high = some.column("shard").to_numpy(), *(_dense(some.column(c).combine_chunks(), width) for c in ("low", "high"))
            asked = saved(carried.mapInArrow(_further(names, low, high, width), "shard long, key long, v array<long>, kth long"))
            shares = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shares"))
            found = found.unionByName(walk(asked, shares))
    hits = found.select("key", F.inline("hits"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "no")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id", "no"))).alias("hits"))
    of_vector = points.filter("asks").select("key", "v").join(best, "key").select("v", "hits")
    queries = rows.filter(asks).select(F.col("id").alias("query_id"), F.col("no").alias("own"), "v").join(of_vector, "v")
    others = F.slice(F.filter("hits", lambda h: h["no"] != F.col("own")), 1, k)
    out = queries.select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
