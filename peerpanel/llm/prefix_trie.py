"""Prefix trie of conversations, from padded matrices of turn ids.

A conversation is its path: the ids of its turns in order.  Paths are range-sharded, in the order of path and
key, so the members of every trie node are neighbours and many copies of one path still spread over
shards.  A task turns its shard into matrices of turn ids, padded with zeros, ``PANEL`` columns at a time (long
conversations don't widen the others), and sorts the rows by numpy's ``lexsort``.  A mask tells where
a column changes from one row to the next; accumulated from left to right by OR it marks the row at which
a node of each depth begins, and ``reduceat`` adds up every node of a depth at once.

Whatever is added up belongs to rows: a node counts in the row that begins it, a leaf in its last
row.  So the parts of a node that several shards share simply add.  Only these boundary nodes,
those on the common path of a shard's first or last row and its neighbour, are shuffled: at most
two paths a shard.  What a conversation needs must fit in a task, all conversations of a node need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, words

PANEL = 16
#: Keys in a piece of the list that is hashed, and boundary nodes that are broadcast (at most).
PIECE, HELD_NODES = 512, 100_000
TURN = "struct<a:bigint,b:bigint,words:int>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What tasks emit: whole nodes, whole nodes whose parent is a boundary node, parts of boundary nodes, pieces of key lists.
WHOLE, HANGING, PART, KEYS = range(4)
_EMITTED = f"kind int, node binary, parent binary, {NODE}, piece string"


def paths_of(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, path): each conversation with its turns in order, null turns first, ties by the hash of role and text.

    A turn is two 64-bit hashes of role and text, and the number of words.  A null role or text is empty; rows
    with a null key belong to no conversation; repeated rows are turns of their own."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = conversations.where(F.col(key).isNotNull()).select(
        F.col(key), F.struct(F.col(turn).alias("turn"), F.xxhash64(r, t).alias("a"), F.xxhash64(F.lit(1), r, t).alias("b"), F.size(words(t)).alias("words")).alias("turn_"))
    whole = turns.groupBy(key).agg(F.sort_array(F.collect_list("turn_")).alias("path"))  # one conversation's turns
    return whole.select(key, F.transform("path", lambda x: F.struct(x["a"], x["b"], x["words"])).cast(f"array<{TURN}>").alias("path"))


class Shard:
    """The rows of a shard, sorted, with what its neighbours share: ``before`` turns of the first row's path with the last row
    of the shard before, ``after`` turns of the last row's path with the next shard (-1: no such shard)."""

    def __init__(self, conv: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, before: int, after: int) -> None:
        start = np.cumsum(lengths) - lengths
        by = np.lexsort((b, a))
        change = np.ones(len(a), bool)
        change[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
        codes = np.zeros(len(a), np.int32)
        codes[by] = np.cumsum(change)  # in the order of the ids, from one
        longest = int(lengths.max(initial=0))
        self.panels = range(0, longest, PANEL)

        def cells(flat: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
            """The panel that begins at column ``at``, padded with zeros."""
            there = np.arange(at, at + PANEL)[None, :] < lengths[rows][:, None]
            out = np.zeros(there.shape, flat.dtype)
            out[there] = flat[(start[rows][:, None] + np.arange(at, at + PANEL)[None, :])[there]]
            return out

        # panels from the last to the first: the rank of what follows breaks the ties of a panel
        rank = np.zeros(len(conv), np.int64)
        for at in reversed(self.panels):
            rows = np.flatnonzero(lengths > at)
            m = cells(codes, rows, at)
            by = np.lexsort((rank[rows], *m.T[::-1]))
            m, follows = m[by], rank[rows][by]
            new = np.ones(len(rows), np.int64)
            new[1:] = (m[1:] != m[:-1]).any(axis=1) | (follows[1:] != follows[:-1])
            rank = np.zeros(len(conv), np.int64)
            rank[rows[by]] = np.cumsum(new)
        order = np.lexsort((conv, rank))
        self.conv, lengths, start = conv[order], lengths[order], start[order]
        self.lengths, self.before, self.after = lengths, before, after
        self.first, self.last = (np.stack([x[s:s + n] for x in (a, b)], axis=1) if n else np.zeros((0, 2), np.int64)
                                 for s, n in ((start[0], lengths[0]), (start[-1], lengths[-1])))

        # masks: where a node of each depth begins, as far as the shard sees (fresh) and at all (begins)
        n = len(conv)
        self.rows, self.fresh, self.begins, self.weight = [], [], [], []
        carried = np.zeros(n, bool)
        carried[0] = True
        self.going_on = np.zeros(n, bool)  # whether the next row has this whole path, or goes on from it
        self.going_on[:-1] = lengths[:-1] == 0
        for at in self.panels:
            rows = np.flatnonzero(lengths > at)
            m = cells(codes, rows, at)
            change = np.ones(m.shape, bool)
            change[1:] = m[1:] != m[:-1]
            change[1:] |= (np.diff(rows) > 1)[:, None]
            change[:, 0] |= carried[rows]
            fresh = np.logical_or.accumulate(change, axis=1)
            carried = np.zeros(n, bool)
            carried[rows] = fresh[:, -1]
            begins = fresh & (np.arange(at, at + PANEL)[None, :] < lengths[rows][:, None])
            if rows[0] == 0:
                begins[0] &= np.arange(at + 1, at + PANEL + 1) > before
            self.rows.append(rows), self.fresh.append(fresh), self.begins.append(begins), self.weight.append(cells(weight, rows, at).astype(np.int64))
            ends = np.flatnonzero(lengths[rows] <= at + PANEL)
            ends = ends[ends < len(rows) - 1]
            follows = (rows[ends + 1] == rows[ends] + 1) & (lengths[rows[ends + 1]] >= lengths[rows[ends]])
            self.going_on[rows[ends]] = follows & ~fresh[ends + 1, lengths[rows[ends]] - at - 1]
        self.going_on[-1] = after >= lengths[-1]

    def digests(self, path: np.ndarray, deepest: int) -> list[bytes]:
        """Names of the nodes on a path down to a depth."""
        h, out = hashlib.blake2b(digest_size=16), []
        for depth in range(deepest + 1):
            if depth:
                h.update(path[depth - 1].tobytes())
            out.append(h.copy().digest())
        return out

    def nodes(self) -> Iterator[tuple]:
        """What the task emits, a tuple for each row of its output."""
        n = len(self.conv)
        names = self.digests(self.first, self.before), self.digests(self.last, self.after)
        # tokens saved from a depth on, less those of depths that are done; in the row that begins a node its words count nothing
        saved = np.zeros(n, np.int64)
        for rows, begins, weight in zip(self.rows, self.begins, self.weight, strict=True):
            saved[rows] += (weight * ~begins).sum(axis=1)
        leaf = ~self.going_on
        top = np.zeros(n, np.int64)  # the key of the node above each row
        chain = np.zeros(n, np.int8)  # 1 and 2: it is a boundary node on the first or last row's path

        def one_depth(depth: int, rows: np.ndarray, starts: np.ndarray, children: np.ndarray) -> Iterator[tuple]:
            count = np.diff([*starts, len(rows)])
            total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
            least = np.minimum.reduceat(self.conv[rows], starts)
            shared = np.zeros(len(starts), np.int8)
            if rows[-1] == n - 1 and depth <= self.after:
                shared[-1] = 2
            if rows[0] == 0 and depth <= self.before:
                shared[0] = 1
            head = rows[starts]
            ends = total(self.lengths[rows] == depth)
            columns = zip(head.tolist(), least.tolist(), count.tolist(), total(children).tolist(), total(leaf[rows]).tolist(), total(saved[rows]).tolist(),
                          ends.tolist(), shared.tolist(), top[head].tolist(), chain[head].tolist(), strict=True)
            for h, low, c, kids, leaves, kept, e, own, above, hang in columns:
                name = names[own - 1][depth] if own else None
                parent = names[hang - 1][depth - 1] if hang and depth else None
                figures = (low, depth, above if depth and not hang else None, c, kids, leaves, kept)
                keys = self.conv[h:h + e].tolist()
                if own:
                    yield (PART, name, parent, *figures, None, None)
                    for at in range(0, e, PIECE):
                        yield (KEYS, name, None, keys[at], *[None] * 7, ",".join(map(str, keys[at:at + PIECE])))
                else:
                    yield (HANGING if parent else WHOLE, None, parent, *figures, hashlib.sha256(",".join(map(str, keys)).encode()).hexdigest(), None)
            top[rows], chain[rows] = np.repeat(least, count), np.repeat(shared, count)

        everyone = np.arange(n)
        first = np.zeros(n, bool)
        if self.rows:
            first[self.rows[0]] = self.begins[0][:, 0]
        yield from one_depth(0, everyone, np.zeros(1, int), first)
        for k, at in enumerate(self.panels):
            rows, fresh, begins, weight = self.rows[k], self.fresh[k], self.begins[k], self.weight[k]
            following = np.zeros(n, bool)
            if k + 1 < len(self.rows):
                following[self.rows[k + 1]] = self.begins[k + 1][:, 0]
            for j in range(PANEL):
                deep = np.flatnonzero(self.lengths[rows] > at + j)
                if not len(deep):
                    break
                here = rows[deep]
                children = begins[deep, j + 1] if j + 1 < PANEL else following[here]
                yield from one_depth(at + j + 1, here, np.flatnonzero(fresh[deep, j]), children)
                saved[here] -= weight[deep, j] * ~begins[deep, j]


def common(one: list, two: list) -> int:
    """Turns that two paths begin with in common."""
    n = 0
    while n < min(len(one), len(two)) and one[n] == two[n]:
        n += 1
    return n


def trie(paths: DataFrame, key: str = "conv_id", path: str = "path") -> DataFrame:
    """A row for each distinct prefix of a path, the empty one included: ``NODE``.

    conv_id is the smallest key of the members (the rows whose path begins so), parent_conv_id that of the prefix
    one turn shorter; n_children, n_leaves and saved_tokens (words of its last turn for each member but
    one) are those of the node's subtree; ends_sha256 hashes the members that end there.
    Rows with a null key or path take no part, repeated rows are members each; no rows give no nodes."""
    spark = paths.sparkSession
    rows = paths.where(F.col(key).isNotNull() & F.col(path).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(path).alias("path"))
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(n_shards, "path", "key").withColumn("shard", F.spark_partition_id()))
    # two paths a shard; the driver keeps how much of them neighbours share
    edges = sorted(dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")).toLocalIterator())
    shared: dict[int, tuple[int, int]] = {}
    for k, (shard, low, high) in enumerate(edges):
        shared[shard] = (common(edges[k - 1]["high"], low) if k else -1, common(high, edges[k + 1]["low"]) if k + 1 < len(edges) else -1)
    sent = spark.sparkContext.broadcast(shared)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column("path").combine_chunks()
        flat = lists.flatten()
        a, b, weight = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        shard = Shard(t.column("key").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), a, b, weight,
                      *sent.value[t.column("shard")[0].as_py()])
        kinds = (pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.string())
        names = [x.split()[0] for x in _EMITTED.split(", ")]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for row in shard.nodes():
            out.append(row)
            if len(out) == 5000:
                yield batch()
                out = []
        if out:
            yield batch()

    found = materialise(dealt.mapInArrow(emit, _EMITTED))
    columns = [x.split()[0] for x in NODE.split(", ")]
    whole = found.where(F.col("kind") == WHOLE).select(columns)
    if len(edges) < 2:
        return whole
    # the parts of boundary nodes, put together
    parts = found.where(F.col("kind") == PART).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent").alias("parent"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    hashed = (found.where(F.col("kind") == KEYS).select("node", "conv_id", "piece").repartition(n_shards, "node").sortWithinPartitions("node", "conv_id")
              .mapInArrow(list_hashes, "of binary, ends_sha256 string"))
    boundary = materialise(parts.join(hashed, F.col("node") == F.col("of"), "left")
                           .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("of"))
    above = boundary.select(F.col("node").alias("above"), F.col("conv_id").alias("above_id"))
    if sum(x + 1 for pair in shared.values() for x in pair) <= HELD_NODES:  # no more boundary nodes than this
        above = F.broadcast(above)
    hanging = found.where(F.col("kind") == HANGING).select("parent", *(c for c in columns if c != "parent_conv_id"))
    under = hanging.unionByName(boundary.drop("node")).join(above, F.col("parent") == F.col("above"), "left")
    return whole.unionByName(under.withColumn("parent_conv_id", F.col("above_id")).select(columns))


def list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hash of its keys) from rows (node, first key, piece of the list) in this order; a piece at a time is held."""
    node, h, done = None, None, []
    for batch in batches:
        for name, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if name != node:
                if h:
                    done.append((node, h.hexdigest()))
                node, h = name, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
    if h:
        done.append((node, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["of", "ends_sha256"])
