"""Hard negatives by exact integer scores, multiplied in a residue number system.

A score is the inner product of two integer vectors.  It is computed exactly in float32: each
component is taken modulo several small primes, the matrices of residues are multiplied (the primes
are so small that no sum leaves the integers float32 holds), and the signed score is
rebuilt from its residues by Chinese remaindering with balanced digits.  There are as many primes as the
longest vector of the table asks for, since no score exceeds its squared length.

The anchors are searched in blocks against all rows; each block is broadcast and takes two passes.  The first finds an
anchor's positives, the second, for each positive, the best rows of other labels within a window
below the positive's score: a block's scores are sorted once, and every window is a run of them.
A task carries on only the rows that can still be among the first, and Spark ranks what the tasks found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Anchors of a block (the number of blocks makes twice as many improbable), and rows that are multiplied at once.
ANCHORS, ROWS = 1024, 4096
#: Components multiplied before the sums are reduced, and the first integer float32 can't tell apart.
CHUNK, EXACT = 1024, 1 << 24
_PAIRS = "slot int, id long, score long"


def choose_primes(width: int, bound: int) -> list[int]:
    """The largest primes with exact sums over ``width`` components, enough for scores of at most ``bound``."""
    half = isqrt((EXACT - 1) // max(1, min(width, CHUNK)))
    out, product, p = [], 1, 2 * min(half, 1023) + 1
    while product <= 2 * bound + 1:
        if p < 3:
            raise ValueError("scores are too large for the primes")
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the components modulo it, between -p / 2 and p / 2."""
    return [(np.mod(vectors + p // 2, p) - p // 2).astype(np.float32) for p in primes]


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows of two matrices, from their residues."""
    total, modulus = None, 1
    for a, b, p in zip(left, right, primes, strict=True):
        part = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], CHUNK):
            part = (part + (a[:, at:at + CHUNK] @ b[:, at:at + CHUNK].T).astype(np.int64)) % p
        if total is None:
            digit = part
        else:
            digit = (part - total) % p * pow(modulus, -1, p) % p
        digit = np.where(digit > p // 2, digit - p, digit)  # balanced, so the sum is the signed score
        total = digit if total is None else total + digit * np.int64(modulus % (1 << 64) - (1 << 64) * (modulus % (1 << 64) >> 63))
        modulus *= p
    return total


def padded(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class Rows:
    """Some rows in the order of their ids, null ids last."""

    def __init__(self, table: pa.Table, width: int) -> None:
        table = table.combine_chunks()
        ids = table.column("id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        label = table.column("label").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.lexsort((label, value, null))
        self.null, self.id, self.label = null[order], value[order], label[order]
        vector = table.column("vector").combine_chunks()
        self.vectors = padded(vector, width)[order].astype(np.int64)

    def __len__(self) -> int:
        return len(self.id)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    """The rows of a task, ``ROWS`` at a time."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            held.append(part)
            n += part.num_rows
            if n >= ROWS:
                yield Rows(pa.Table.from_batches(held), width)
                held, n = [], 0
    if n:
        yield Rows(pa.Table.from_batches(held), width)


class Best:
    """The first ``most`` (id, score) of each slot among all that were added: higher scores, then smaller ids, null last."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.slot, self.null, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, null: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        slot, null, id_, score = (np.concatenate(x) for x in ((self.slot, slot), (self.null, null), (self.id, id_), (self.score, score)))
        order = np.lexsort((id_, null, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff([*first, len(slot)]))
        keep = order[rank < self.most]
        self.slot, self.null, self.id, self.score = slot[rank < self.most], null[keep], id_[keep], score[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.slot, pa.int32()), pa.array(self.id, mask=self.null), pa.array(self.score)], ["slot", "id", "score"])


def descending(s: np.ndarray, allowed: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``s``, whose columns are in the order of their ids: the columns by falling score,
    then id; the scores in this order; and how many columns are allowed (the others come last)."""
    n = s.shape[1]
    shift = max(1, (n - 1).bit_length())
    count = allowed.sum(axis=1)
    if bound >> (61 - shift) == 0:  # score and column fit into one integer, which sorts faster
        packed = np.where(allowed, (-s << shift) | np.arange(n), np.iinfo(np.int64).max)
        packed.sort(axis=1)
        return packed & ((1 << shift) - 1), -(packed >> shift), count
    order = np.argsort(np.where(allowed, -s, np.iinfo(np.int64).max), axis=1, kind="stable")
    return order, np.take_along_axis(s, order, axis=1), count


def mine(rows: DataFrame, anchors: Column, key: str, label: str, vector: str, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector`` holds integers.  For each row of ``anchors`` its first ``n_positives`` other rows of its label are
    positives; for each of them the first ``n_negatives`` rows of other labels follow whose score is
    between ``low`` and ``high`` percent of the positive's.  Higher scores come first, ties by smaller
    key, a null key last.

    Rows with a null label, a null vector or a null component take no part; a row with a null key is
    no anchor.  A row with the anchor's key is the anchor itself.  An anchor that is repeated as a whole is searched
    once; repeated rows otherwise count each.  Of vectors of different lengths the shorter one ends in zeros.  Scores of 62 bits and more
    raise ``ValueError``.  No rows give no rows."""
    spark = rows.sparkSession
    part = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    own = part.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"))
    heads = materialise(part.where(anchors & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector")).distinct())
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    seen = own.agg(F.max(F.size("vector")).alias("width"), F.max(square).alias("square")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n_heads = heads.count()
    if not n_heads:
        return spark.createDataFrame([], schema)
    width, bound = max(1, seen["width"]), int(seen["square"] * (1 + 1e-9)) + 1
    if bound >> 62:
        raise ValueError("scores do not fit into 62 bits")
    primes = choose_primes(width, bound)
    n_blocks = -(-n_heads // ANCHORS)
    out = None
    for number in range(n_blocks):
        block = Rows(heads.where(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n_blocks)) == number).toArrow(), width)
        if not len(block):
            continue
        found = materialise(_block(own, block, primes, width, bound, n_positives, n_negatives, low, high))
        out = found if out is None else out.unionByName(found)
    return out


def _first(found: DataFrame, most: int) -> DataFrame:
    """The tasks' finds ranked within their slot."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))  # at most ``most`` rows a slot and task
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _block(own: DataFrame, block: Rows, primes: list[int], width: int, bound: int, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    context = own.sparkSession.sparkContext
    shared = context.broadcast((block.id, block.label, residues(block.vectors, primes)))

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, right = shared.value
        best = Best(n_positives)
        for rows in blocks(batches, width):
            for value in np.unique(labels):
                mine_, here = np.flatnonzero(labels == value), np.flatnonzero(rows.label == value)
                if not len(here):
                    continue
                s = scores([r[mine_] for r in right], residues(rows.vectors[here], primes), primes)
                other = rows.null[here] | (rows.id[here][None, :] != ids[mine_][:, None])
                order, sorted_, count = descending(s, other, bound)
                take = np.arange(order.shape[1])[None, :n_positives] < count[:, None]
                anchor, at = np.nonzero(take)
                chosen = here[order[anchor, at]]
                best.add(mine_[anchor], rows.null[chosen], rows.id[chosen], sorted_[anchor, at])
        yield best.batch()

    ranked = _first(own.mapInArrow(positives, _PAIRS), n_positives).orderBy("slot", "rank").collect()  # a block's positives
    if not ranked:
        return own.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    windows = [(r["slot"], r["id"], r["score"], -(-low * r["score"] // 100), high * r["score"] // 100) for r in ranked]
    tried = context.broadcast(windows)

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, right = shared.value
        best = Best(n_negatives)
        for rows in blocks(batches, width):
            s = scores(right, residues(rows.vectors, primes), primes)
            order, sorted_, count = descending(s, labels[:, None] != rows.label[None, :], bound)
            slot, anchor, start, stop = [], [], [], []
            for k, (a, _, _, least, most) in enumerate(tried.value):
                falling = -sorted_[a, :count[a]]
                first = int(np.searchsorted(falling, -most, "left"))
                last = min(int(np.searchsorted(falling, -least, "right")), first + n_negatives)
                if last > first:
                    slot.append(k), anchor.append(a), start.append(first), stop.append(last)
            n = np.array(stop, int) - np.array(start, int)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.array(start, int), n)
            a = np.repeat(np.array(anchor, int), n)
            chosen = order[a, at]
            best.add(np.repeat(np.array(slot, int), n), rows.null[chosen], rows.id[chosen], sorted_[a, at])
        yield best.batch()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[0]
        for batch in batches:
            of = [tried.value[k] for k in batch.column("slot").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[w[0]] for w in of], pa.int64()), pa.array([w[1] for w in of], pa.int64()), batch.column("rank").cast(pa.int32()), batch.column("id"),
                 pa.array([w[2] for w in of], pa.int64()), batch.column("score")],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    ranked_ = _first(own.mapInArrow(negatives, _PAIRS), n_negatives)
    return ranked_.mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
