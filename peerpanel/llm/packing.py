"""Packing of documents into sequences of bounded length by linear grouping.

A document's tokens, with the end id, are one piece if they fit and are cut otherwise.  How
pieces are packed depends on their lengths only, and there are at most ``capacity`` of
those, so the plan is made from the histogram of lengths whatever the number of pieces:

1. large lengths are sorted and dealt into groups of equal cardinality, each rounded up to
   its largest length;
2. for these few sizes the best mix of configurations (which sizes share a sequence) is
   found by column generation, and each configuration is used as many whole times as
   the solution says;
3. the groups' real pieces are put in the place of the rounded sizes, longest first;
4. large pieces left over by the whole numbers, then the small ones, go by best fit in order
   of falling length into the space that remains, or into new sequences.

This is done for each of ``SCHEMES`` (from which share of the capacity a length is large, and
the number of groups): few small groups suit pieces that share a sequence in threes and
more, many groups suit pairs.  The plan with the fewest sequences is used.

The plan is a list of runs: the pieces of a length with ranks ``first`` and up go to
consecutive sequences at the same offset.  Each piece finds its run by its length and its
rank among the pieces of that length.  Ranks are counted by task and completed with the
counts of the tasks before, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 1024
END_ID = 2
SCHEMES = ((0.45, 300), (1 / 8, 96))
#: Column generation ends when the solution is within this share of its lower bound.
GAP = 5e-4
MAX_COLUMNS = 1500
PIECES = "piece int, start long, length long, ids_crc32 long, _part int, _nth long"


def group_lengths(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) runs of each group, longest first; groups have equal cardinality."""
    total = sum(counts.values())
    target, out, room = max(1, -(-total // groups)), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = target
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that has the largest value.

    One more member a round: ``best[c]`` is the largest value of at most so many members
    within ``c``, ``choice`` the member that was added (or none)."""
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, before = room >= 0, np.where(room >= 0, room, 0)
    best, choices = np.zeros(capacity + 1), []
    while True:
        got = np.where(fits, best[before] + values[:, None], -1.0)
        k = got.argmax(axis=0)
        new = got[k, np.arange(capacity + 1)]
        better = new > best + 1e-12
        if not better.any():
            break
        choices.append(np.where(better, k, -1))
        best = np.where(better, new, best)
    used, c = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[c] >= 0:
            used[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), used


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the rounded sizes and how many whole times each is used.

    Column generation on the covering linear program, in its basis form: start with one size
    a configuration, and add the best configuration at the present prices until no further
    one helps or the gap to the bound of the prices is small."""
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    inverse, amount = np.diag(1 / np.diag(basis)), d / np.diag(basis)
    for turn in range(1, MAX_COLUMNS):
        value, column = best_configuration(s, inverse.sum(axis=0), capacity)
        if 1 - 1 / value <= GAP:
            break
        direction = inverse @ column
        rising = direction > 1e-9
        if not rising.any():
            break
        leaves = int(np.argmin(np.where(rising, amount / np.where(rising, direction, 1), np.inf)))
        basis[:, leaves] = column
        if turn % 50:  # the inverse after the exchange of one column
            row = inverse[leaves] / direction[leaves]
            inverse -= np.outer(direction, row)
            inverse[leaves] = row
        else:
            inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ d, 0)
    return [(basis[:, k].astype(int), int(amount[k] + 1e-6)) for k in range(len(s)) if amount[k] + 1e-6 >= 1]


class Plan:
    """Runs of pieces and the space left, both run-length coded."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sequences = 0
        self.rank: dict[int, int] = defaultdict(int)  # next rank of a length
        self.runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.space: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def place(self, length: int, first: int, count: int, offset: int) -> None:
        """``count`` pieces into the sequences from ``first``, one each."""
        self.runs.append((length, self.rank[length], first, offset))
        self.rank[length] += count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            rooms = [r for r in self.space if r >= length]
            if not rooms:
                each = self.capacity // length
                full = max(1, count // each)
                self.space[self.capacity].append((self.open(full), full))
                rooms = [self.capacity]
            room = min(rooms)
            first, bins = self.space[room].pop()
            if not self.space[room]:
                del self.space[room]
            took = min(bins, count)
            self.place(length, first, took, self.capacity - room)
            if took < bins:
                self.space[room].append((first + took, bins - took))
            if room > length:
                self.space[room - length].append((first, took))
            count -= took


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, schemes: tuple = SCHEMES) -> Plan:
    """Pack pieces with the given histogram of lengths (1 to ``capacity``): the best scheme's plan."""
    return min((scheme_plan(counts, capacity, *s) for s in schemes), key=lambda p: p.sequences)


def scheme_plan(counts: dict[int, int], capacity: int, large_from: float, groups: int) -> Plan:
    """Linear grouping of the lengths above ``capacity * large_from``, best fit of the others."""
    plan = Plan(capacity)
    large = {k: v for k, v in counts.items() if capacity * large_from < k < capacity}
    small = {k: v for k, v in counts.items() if k <= capacity * large_from}
    if whole := counts.get(capacity):
        plan.place(capacity, plan.open(whole), whole, 0)
    grouped = group_lengths(large, groups)
    by_size: dict[int, list[tuple[int, int]]] = {}  # groups rounded to the same size are one
    for g in grouped:
        by_size.setdefault(g[0][0], []).extend(g)
    left: dict[int, int] = defaultdict(int, small)
    if by_size:
        sizes = list(by_size)
        queues = [by_size[s][::-1] for s in sizes]  # the longest last, to be popped
        for used, times in configurations(sizes, [sum(n for _, n in by_size[s]) for s in sizes], capacity):
            parts = [(plan.open(times), times, 0)]
            for k in np.repeat(np.arange(len(sizes)), used):
                after = []
                for first, bins, offset in parts:
                    while bins and queues[k]:
                        length, n = queues[k].pop()
                        took = min(n, bins)
                        plan.place(length, first, took, offset)
                        after.append((first, took, offset + length))
                        if took < n:
                            queues[k].append((length, n - took))
                        first, bins = first + took, bins - took
                    if bins:  # a group gave out: covering may ask for more than there is
                        after.append((first, bins, offset))
                parts = after
            for first, bins, offset in parts:
                if offset < capacity:
                    plan.space[capacity - offset].append((first, bins))
        for q in queues:
            for length, n in q:
                left[length] += n
    for length in sorted(left, reverse=True):
        plan.best_fit(length, left[length])
    return plan


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``n`` ids; only the first may be short."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def encoder(tokenizer: str):
    """A function from a text to its ids as the ``tokenizers`` library gives them.

    Texts of plain Latin characters go to ``tiktoken`` when the same vocabulary is there as ranks,
    which gives the same ids about five times as fast; texts with other characters or a
    special string go to ``tokenizers`` itself.  Ranks of another vocabulary raise."""
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
    slow = Tokenizer.from_file(path)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks_path = re.sub(r"\.json$", ".tiktoken", path)
    if not os.path.exists(ranks_path):
        return exact
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the .json writes as they are
    letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = slow.get_vocab(with_added_tokens=False)
    if any(vocabulary.get("".join(map(letters.__getitem__, token))) != rank for token, rank in ranks.items()):
        raise ValueError(f"{ranks_path} does not belong to {path}")
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = "|".join(re.escape(t.content) for t in slow.get_added_tokens_decoder().values())
    odd = re.compile("[^\n\\x20-\\x7e\\xa1-\\u017f]" + (f"|{special}" if special else "")).search
    return lambda text: exact(text) if odd(text) else fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, tokenizer: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document, with their task and their rank among the task's pieces of
    the same length."""
    keep = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), PIECES])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows, out = [], [[], [], [], [], [], []]
                for k, t in enumerate(some.column(text).to_pylist()):
                    ids = np.array([*encode(t or ""), end_id], "<u4")
                    for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                        rows.append(k)
                        crc = zlib.crc32(ids[start:start + length].tobytes())
                        for column, value in zip(out, (piece, start, length, crc, part, seen[length]), strict=True):
                            column.append(value)
                        seen[length] += 1
                kept = some.select(names).take(pa.array(rows, pa.int64()))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True))],
                    [*names, "piece", "start", "length", "ids_crc32", "_part", "_nth"])

    return docs.select(*names, text).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: the columns of ``docs`` without the text, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``.

    A null or empty text is the end id alone.  Repeated rows are packed each.  No documents give
    no rows.  Columns of ``docs`` with the new names are replaced.
    """
    spark = docs.sparkSession
    new = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_part", "_nth"]
    pieces = materialise(token_pieces(docs.drop(*(c for c in new if c != text)), tokenizer, text, capacity, end_id))
    in_task = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity
    plan = make_plan(histogram, capacity)
    runs = np.array(sorted(plan.runs) or np.empty((0, 4)), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(runs)  # its size follows the number of lengths, not of pieces

    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = in_task.select(F.col("length").alias("_length"), F.col("_part").alias("_task"),
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = (pieces.join(before, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_task")))
              .withColumn("_rank", F.col("_nth") + F.col("_before"))
              .drop("_length", "_task", "_before", "_nth", "_part"))
    out = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "sequence_id long, offset long"])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # a length's ranks are below 2 ** 48
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            run = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, side="right") - 1
            sequence = table[run, 2] + rank - table[run, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in out), pa.array(sequence, pa.int64()), pa.array(table[run, 3], pa.int64())],
                [*(f.name for f in out), "sequence_id", "offset"])

    return ranked.mapInArrow(seat, schema)
