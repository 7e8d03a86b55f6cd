"""The trie of all prefixes of conversations, held as succinct level-order tries.

Every prefix has a 128-bit mark: the exclusive or of hashes of its (place, role, text), a running value that an ordered
scan works out however long a conversation is. Rows with equal marks are one node, counted before and after the exchange.

Nodes with many members form the upper levels; each node below them belongs to the subtree under the first such
node of its path, and a path begins a new subtree every so many levels. Subtrees are dealt to shards, in which
numpy builds a LOUDS trie: level by level, a bit for each child and a zero behind each node's children, labels in the
same order. Parents are read from the bits, and sums go up in reverse level order with ``np.add.at``. The upper levels,
bounded in number, take the totals of the subtrees that hang on them and are rolled up as a trie of their own. Where
paths are so long that subtrees hang on subtrees, these totals go back to the nodes above and their tries are rolled
up again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import saved, spread
from docsieve.operators.scan import ordered_scan, position, running_xor

#: Conversations whose ids have the same quotient by this share their first turns with the first of them.
FAMILY, HEAD = 20, 4
#: Upper nodes at most (and rows over this give the least size of a node or path that is split), and that size at least.
UPPER, LEAST = 100_000, 1_024
#: Nodes of one shard, about.
SHARD_NODES = 50_000
#: Characters of joined ids that one row holds.
CHUNK = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


class Louds:
    """A forest in level order: ``bits`` has a one for each child and a zero behind each node's children, a root of
    all first; ``labels`` and other arrays of a caller follow ``order``, the rows in level order."""

    def __init__(self, parent: np.ndarray, labels: np.ndarray):
        """``parent``: the row of each row's parent, -1 for roots; children are ordered by their label."""
        n = len(parent)
        by_parent = np.lexsort((*labels.T[::-1], parent))
        degree = np.bincount(parent + 1, minlength=n + 1)  # of the root of all, then of each row
        first = np.cumsum(degree) - degree
        order, levels, now = [], [0], by_parent[: degree[0]]
        while len(now):
            order.append(now)
            levels.append(levels[-1] + len(now))
            many = degree[now + 1]
            ends = np.cumsum(many)
            now = by_parent[np.arange(int(ends[-1])) + np.repeat(first[now + 1] - ends + many, many)]
        self.order, self.levels = np.concatenate(order) if order else np.empty(0, np.int64), levels
        size = np.concatenate((degree[:1], degree[self.order + 1]))
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(size + 1) - 1] = False
        self.labels = labels[self.order]

    def parents(self) -> np.ndarray:
        """Of each node in level order its parent's place; -1 for roots: the zeros before a node's own one, less one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self, node: int) -> range:
        """Places of a node's children (-1: of the root of all)."""
        zeros = np.flatnonzero(~self.bits)
        start = 0 if node < 0 else int(zeros[node]) + 1
        return range(start - node - 1, int(zeros[node + 1]) - node - 1)

    def add_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtree of each node, of values in level order (one row a node)."""
        out, parent = values.copy(), self.parents()
        for start, stop in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(out, parent[start:stop], out[start:stop])
        return out


_NODE = "depth long, p1 long, p2 long, q1 long, q2 long, l1 long, l2 long, n long, conv long, words long, shard long, root boolean, outer long, outer_leaves long, outer_saved long"
_DONE = "depth long, p1 long, p2 long, q1 long, q2 long, n long, conv long, shard long, root boolean, parent_conv long, children long, leaves long, saved long"


def _trie(rows: pa.Table) -> tuple[Louds, np.ndarray, dict[str, np.ndarray]]:
    c = {name: rows.column(name).to_numpy() for name in rows.column_names}
    at = {k: i for i, k in enumerate(zip(c["p1"].tolist(), c["p2"].tolist(), strict=True))}
    parent = np.fromiter((-1 if r else at.get(k, -1) for r, k in zip(c["root"].tolist(), zip(c["q1"].tolist(), c["q2"].tolist(), strict=True), strict=True)), np.int64, len(at))
    return Louds(parent, np.stack((c["l1"], c["l2"]), axis=1)), parent, c


def roll_up(rows: pa.Table) -> pa.Table:
    """The nodes of a shard with the sums of their subtrees. ``outer``: children in other shards, whose leaves and saved
    tokens are ``outer_leaves`` and ``outer_saved``; those of a root are the rows whose parent is elsewhere."""
    trie, _, c = _trie(rows)
    order, parent = trie.order, trie.parents()
    own = np.bincount(parent[parent >= 0], minlength=len(order))
    children = own + c["outer"][order]
    sums = np.stack((np.where(children == 0, 1, 0) + c["outer_leaves"][order], (c["n"][order] - 1) * c["words"][order] + c["outer_saved"][order]), axis=1)
    leaves, saved_ = trie.add_up(sums).T
    above = pa.array(c["conv"][order][parent], mask=parent < 0)
    names = ["depth", "p1", "p2", "q1", "q2", "n", "conv", "shard", "root"]
    return pa.table([*(pa.array(c[x][order]) for x in names), above, pa.array(children), pa.array(leaves.copy()), pa.array(saved_.copy())], [*names, "parent_conv", "children", "leaves", "saved"])


def _pack(rows: pa.Table) -> pa.Table:
    trie, _, c = _trie(rows)
    return pa.table({"shard": [int(c["shard"][0])], "nodes": [len(trie.order)], "bits": [np.packbits(trie.bits).tobytes()], "labels": [trie.labels.astype("<i8").tobytes()], "members": [c["n"][trie.order].astype("<i8").tobytes()]}, pa.schema([("shard", pa.int64()), ("nodes", pa.int64()), ("bits", pa.binary()), ("labels", pa.binary()), ("members", pa.binary())]))


def _own(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def rebuilt(conversations: DataFrame, chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((conv, at, l1, l2, words), (conv)): the turns of every rebuilt conversation, a turn as a label of 128 bits and the
    number of its words, and all conversations, those without turns among them."""
    more = {"chunk_rows": chunk_rows} if chunk_rows else {}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = spread(conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text")))
    label = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    turns = saved(turns.select("conv", "turn", label(1).alias("l1"), label(2).alias("l2"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")))
    own = saved(ordered_scan(turns, ["conv"], ["turn", "l1", "l2"], {"at": position()}, **more).drop("turn"))
    convs = own.select("conv").distinct()
    family = lambda: (F.col("conv") - F.col("conv") % FAMILY).alias("family")
    heads = own.filter((F.col("conv") % FAMILY == 0) & (F.col("at") < HEAD)).withColumnRenamed("conv", "family")
    borrowed = convs.select("conv", family()).join(heads, "family").filter(F.col("at") <= _own(F.col("conv"))).select("conv", "at", "l1", "l2", "words")
    lengths = heads.groupBy("family").agg(F.count("*").alias("there"))
    rest = own.filter(F.col("at") > _own(F.col("conv"))).select("*", family()).join(lengths, "family", "left")
    had = F.least(_own(F.col("conv")), F.coalesce("there", F.lit(0)))
    rest = rest.select("conv", (F.col("at") - _own(F.col("conv")) + had).alias("at"), "l1", "l2", "words")
    return borrowed.unionByName(rest), convs


def _digests(ends: DataFrame, parts: int) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of nodes at which conversations end. Ids are sorted by range, over all tasks, and
    joined to long pieces there; only these go through the digest of a node, one behind the other."""
    key = ["depth", "p1", "p2"]

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, n = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*now, ids[0])), pa.array([",".join(map(str, ids))])], [*key, "first", "ids"])

        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv")), strict=True):
                if node != now or n > CHUNK:
                    if ids:
                        yield out()
                    now, ids, n = node, [], 0
                ids.append(conv)
                n += len(str(conv)) + 1
        if ids:
            yield out()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([state.hexdigest()])], [*key, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if node != now:
                    if now:
                        yield out()
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now:
            yield out()

    long = "depth long, p1 long, p2 long"
    pieces = ends.select(*key, "conv").repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(join, f"{long}, first long, ids string")
    return pieces.repartition(parts, *key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{long}, ends_sha256 string")


def _below(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """``nodes`` with what hangs on them from elsewhere: rows (q1, q2, leaves, saved) of other shards' roots."""
    sums = outer.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("outer"), F.sum("leaves").alias("outer_leaves"), F.sum("saved").alias("outer_saved"))
    names = ("outer", "outer_leaves", "outer_saved")
    return nodes.drop(*names).join(sums, ["p1", "p2"], "left").fillna(0, list(names))


class Forest:
    """The nodes of all rebuilt conversations: the upper ones, and the others in shards of subtrees."""

    def __init__(self, conversations: DataFrame, upper: int = UPPER, least: int = LEAST, shard_nodes: int = SHARD_NODES, chunk_rows: int | None = None):
        spark = conversations.sparkSession
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        turns, convs = rebuilt(conversations, chunk_rows)
        turns, self.convs = saved(turns), saved(convs)
        rows = turns.count()
        self.least = max(least, -(-rows // upper))
        term = lambda seed: F.xxhash64(F.lit(seed), "at", "l1", "l2")
        more = {"chunk_rows": chunk_rows} if chunk_rows else {}
        marked = ordered_scan(turns, ["conv"], ["at"], {"p1": running_xor(term(3)), "p2": running_xor(term(4))}, **more)
        self.prefixes = saved(marked.select("conv", F.col("at").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(term(3)).alias("q1"), F.col("p2").bitwiseXOR(term(4)).alias("q2"), "l1", "l2", "words"))
        one = lambda c: F.min(c).alias(c)
        nodes = saved(self.prefixes.groupBy("depth", "p1", "p2").agg(one("q1"), one("q2"), one("l1"), one("l2"), F.count("*").alias("n"), one("conv"), one("words")))
        zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "l1", "l2")]
        top = self.convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).filter("n > 0").select(*zero, "n", "conv", F.lit(0).cast("long").alias("words"))
        large = F.col("n") > self.least
        self.upper = saved(nodes.filter(large).unionByName(top))  # upper + 1 rows at most
        marks = F.broadcast(self.upper.select("p1", "p2"))
        band = F.floor(F.col("depth") / self.least).alias("band")
        roots = self.prefixes.join(marks, ["p1", "p2"], "left_anti").groupBy("conv", band).agg(F.min_by(F.struct("p1", "p2"), "depth").alias("r"))
        light = nodes.filter(~large).select("*", band).join(roots, ["conv", "band"]).drop("band")
        shards = max(2 * spark.sparkContext.defaultParallelism, -(-nodes.count() // shard_nodes))
        nothing = [F.lit(0).cast("long").alias(c) for c in ("outer", "outer_leaves", "outer_saved")]
        light = light.select("*", F.pmod(F.xxhash64("r"), F.lit(shards)).alias("shard"), ((F.col("r.p1") == F.col("p1")) & (F.col("r.p2") == F.col("p2"))).alias("root"), *nothing)
        self.light = saved(light)
        #: roots of subtrees that hang on other subtrees
        self.hung = self.light.filter("root").join(marks, (F.col("q1") == marks["p1"]) & (F.col("q2") == marks["p2"]), "left_anti")
        self.long_paths = bool(self.hung.take(1))

    def _rolled(self, nodes: DataFrame) -> DataFrame:
        plain = [x.split()[0] for x in _NODE.split(", ")]
        return saved(nodes.select(*plain).groupBy("shard").applyInArrow(roll_up, _DONE))

    def _upper_sums(self, roots: DataFrame, light: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The upper nodes rolled up, and the totals of subtrees that hang on subtrees (none without long paths).
        ``roots``: the roots of subtrees with their own sums."""
        none = [F.lit(0).cast("long").alias(c) for c in ("outer", "outer_leaves", "outer_saved")]
        upper = self.upper.select("*", F.lit(0).cast("long").alias("shard"), (F.col("depth") == 0).alias("root"), *none)
        if self.long_paths:
            # subtrees that hang on others, and those they hang on, are nodes here: their parent is the other's root
            ids = light.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("r.p1").alias("u1"), F.col("r.p2").alias("u2"))
            hung = self.hung.select("p1", "p2", "q1", "q2").join(ids, ["q1", "q2"]).select("p1", "p2", "u1", "u2")
            hosts = hung.select(F.col("u1").alias("p1"), F.col("u2").alias("p2")).distinct()
            known = hung.select("p1", "p2").unionByName(hosts).distinct()
            own = roots.join(known, ["p1", "p2"]).join(hung, ["p1", "p2"], "left")
            # sums come in as those of a child elsewhere: the subtree itself adds nothing more
            own = own.select("depth", "p1", "p2", F.coalesce("u1", "q1").alias("q1"), F.coalesce("u2", "q2").alias("q2"), F.col("p1").alias("l1"), F.col("p2").alias("l2"), F.lit(1).cast("long").alias("n"), "conv", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("shard"), F.lit(False).alias("root"), F.lit(1).cast("long").alias("outer"), F.col("leaves").alias("outer_leaves"), F.col("saved").alias("outer_saved"))
            roots = roots.join(known, ["p1", "p2"], "left_anti")
            upper = _below(upper, roots).unionByName(own)
        else:
            upper = _below(upper, roots)
        done = self._rolled(upper)
        if not self.long_paths:
            return done, done.limit(0)
        small = done.join(self.upper.select("p1", "p2"), ["p1", "p2"], "left_anti")
        totals = small.select("p1", "p2", "leaves", "saved").join(self.hung.select("p1", "p2", "q1", "q2"), ["p1", "p2"])
        return done.join(self.upper.select("p1", "p2"), ["p1", "p2"], "left_semi"), totals

    def nodes(self) -> DataFrame:
        """(depth, p1, p2, n, conv, parent_conv, children, leaves, saved) of every node."""
        light = self.light
        if self.long_paths:  # a node whose children all lie elsewhere is no leaf
            light = saved(_below(light, self.hung.select("q1", "q2", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))))
        done = self._rolled(light)
        upper, totals = self._upper_sums(done.filter("root"), light)
        if self.long_paths:
            done = self._rolled(_below(light, totals))
        every = self.light.select("p1", "p2", "conv").unionByName(self.upper.select("p1", "p2", "conv"))
        apart = done.filter("root").drop("parent_conv").unionByName(upper.drop("parent_conv"))
        above = every.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent_conv"))
        apart = apart.join(above, ["q1", "q2"], "left").withColumn("parent_conv", F.when(F.col("depth") > 0, F.col("parent_conv")))
        return done.filter("not root").unionByName(apart).select("depth", "p1", "p2", "n", "conv", "parent_conv", "children", "leaves", "saved")

    def ends(self) -> DataFrame:
        """(conv, depth, p1, p2): where each conversation ends."""
        last = self.prefixes.groupBy("conv").agg(F.max_by(F.struct("depth", "p1", "p2"), "depth").alias("e"))
        zero = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(0)).alias(c)
        return self.convs.join(last, "conv", "left").select("conv", zero("depth"), zero("p1"), zero("p2"))

    def packed(self) -> DataFrame:
        """(shard, nodes, bits, labels, members): the shards of subtrees as LOUDS bits, labels of 16 bytes, and counts."""
        plain = [x.split()[0] for x in _NODE.split(", ")]
        return self.light.select(*plain).groupBy("shard").applyInArrow(_pack, "shard long, nodes long, bits binary, labels binary, members binary")


def prefix_nodes(conversations: DataFrame, **sizes: int) -> DataFrame:
    """Per node of the trie of all rebuilt conversations: conv_id (the least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are taken by ``turn`` (null first; turns of equal number in a fixed order of their contents); a null role or
    text is empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation. Texts and
    conversations may be of any length. Other columns are not looked at; an empty table gives an empty table.
    """
    forest = Forest(conversations, **sizes)
    done = forest.nodes().join(_digests(forest.ends(), forest.parts), ["depth", "p1", "p2"], "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return done.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest)
