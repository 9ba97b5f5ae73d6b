"""Lines repeated across documents, found by sharded minimal perfect hashes.

Every line's key has two 64-bit hashes.  Spark counts the documents of each hash pair; pairs in
fewer than the wanted number of documents can't lose their lines and take no slot.  The others
are dealt into shards of about ``SHARD_KEYS`` by their first hash.  A task turns a shard into a minimal
perfect hash (bit arrays, one level after the other, in which a key owns the position that no other key
of its level has) and two arrays in the order of that hash: the fingerprint, which is the second hash, and the
count.  Documents probe these arrays: a line that is none of the keys ends at no slot or at one with
another fingerprint.

The shards of at most ``HELD_KEYS`` keys, the most frequent ones, are broadcast, and documents are never
shuffled.  Keys beyond that are less frequent; their lines' hashes are dealt out by shard and
stream past the array of their shard, so no line is gathered anywhere, however often it is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialise

#: Keys of a shard (about), and keys whose arrays are broadcast (at most; 13 bytes each).
SHARD_KEYS, HELD_KEYS = 1 << 18, 4_000_000
#: Bits of a level for each key that is left.
GAMMA = 2
LINE_SPACE = " \t\n\x0b\x0c\r"
_SHARD = "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary"


def line_keys(lines: Column) -> Column:
    """The lines without white space around them, A to Z in lower case."""
    return F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(LINE_SPACE))))


def place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    """The positions of hash pairs in a level of ``size`` bits."""
    x = first.astype(np.uint64) ^ (second.astype(np.uint64) * np.uint64(2 * level + 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct hash pairs; ``bits`` are the levels one after the other, 64 a word."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.arange(len(first))
        while len(left):
            size = -(-GAMMA * len(left) // 64) * 64
            at = place(first[left], second[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, np.uint8)
            level[at[alone]] = 1
            sizes.append(size)
            levels.append(np.packbits(level, bitorder="little").view(np.uint64))
            left = left[~alone]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each pair; of a pair that is no key, any slot or -1."""
        out, todo, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            at = place(first[todo], second[todo], level, size) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            under = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(under)
            todo, base = todo[~hit], base + size
        return out


class Shard:
    """The arrays of a shard, ready to be probed."""

    def __init__(self, sizes: list[int], bits: bytes, fingerprints: bytes, counts: bytes) -> None:
        self.hash = PerfectHash(sizes, np.frombuffer(bits, np.uint64))
        self.fingerprints, self.counts = np.frombuffer(fingerprints, np.int64), np.frombuffer(counts, np.uint32)

    def documents(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many documents hold each pair (2 ** 32 - 1: as many or more); 0 for a pair that is no key."""
        slot = self.hash.slots(first, second)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == second[known]
        out = np.zeros(len(first), np.int64)
        out[known] = self.counts[slot[known]]
        return out


def shards_of(keys: DataFrame, n_shards: int) -> DataFrame:
    """A row per shard with its arrays, from (first, second, n) in distinct rows."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = rows["first"].to_numpy(np.int64), rows["second"].to_numpy(np.int64)
        made = PerfectHash.build(first, second)
        slot = made.slots(first, second)
        fingerprints, counts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.uint32)
        fingerprints[slot], counts[slot] = second, np.minimum(rows["n"].to_numpy(np.int64), 2**32 - 1)
        return pd.DataFrame({"shard": rows["shard"][:1], "sizes": [made.sizes], "bits": [made.bits.tobytes()],
                             "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()]})

    dealt = keys.select(F.pmod("first", F.lit(n_shards)).cast("int").alias("shard"), "first", "second", "n")
    return dealt.groupBy("shard").applyInPandas(build, _SHARD)


def held_probe(keys: DataFrame, n_keys: int, min_docs: int):
    """A function (first hashes, second hashes) -> which of them are keys, over broadcast arrays."""
    n_shards = max(1, -(-n_keys // SHARD_KEYS))
    rows = shards_of(keys, n_shards).collect()  # at most HELD_KEYS keys
    shared = keys.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shards = {number: Shard(*arrays) for number, *arrays in shared.value}
        for a, b in batches:
            first, second = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
            gone = np.zeros(len(first), bool)
            own = np.mod(first, n_shards)
            for number, shard in shards.items():
                here = np.flatnonzero(own == number) if n_shards > 1 else slice(None)
                gone[here] = shard.documents(first[here], second[here]) >= min_docs
            lengths = np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(gone))

    return probe


def streamed_hits(lines: DataFrame, keys: DataFrame, n_keys: int, min_docs: int) -> DataFrame:
    """The rows of ``lines`` (row, first, second) whose hashes are keys.

    Arrays and lines are dealt out by shard together; in each shard the array comes first."""
    n_shards = max(1, -(-n_keys // SHARD_KEYS))
    arrays = shards_of(keys, n_shards).withColumns({c: F.lit(None).cast("long") for c in ("row", "first", "second")})
    dealt = lines.select(F.pmod("first", F.lit(n_shards)).cast("int").alias("shard"), "row", "first", "second")
    both = arrays.unionByName(dealt, allowMissingColumns=True)
    tasks = max(n_shards, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = both.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("bits").isNull())

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            shards, bits = batch.column("shard").to_numpy(), batch.column("bits")
            marks = [*np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False)), batch.num_rows]
            spans = [(0, marks[0]), *((m + 1, marks[k + 1]) for k, m in enumerate(marks[:-1]))]
            for k, (low, high) in enumerate(spans):
                if k:
                    at = marks[k - 1]
                    number = shards[at]
                    shard = Shard(*(batch.column(c)[int(at)].as_py() for c in ("sizes", "bits", "fingerprints", "counts")))
                part = batch.slice(low, high - low)
                mine = np.flatnonzero(shards[low:high] == number) if shard else np.zeros(0, int)  # a shard without keys has no array
                part = part.select(["row", "first", "second"]).take(pa.array(mine))
                first, second = (part.column(c).to_numpy() for c in ("first", "second"))
                if shard and len(first):
                    yield part.filter(pa.array(shard.documents(first, second) >= min_docs))

    return ordered.mapInArrow(hits, "row long, first long, second long")


def drop_repeated_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, text: str = "text", held_keys: int = HELD_KEYS) -> DataFrame:
    """``docs`` whose ``text`` has lost every line whose key has at least ``min_chars`` code points and is
    found in at least ``min_docs`` rows of ``docs``; with ``n_lines`` (before) and ``n_dropped``.

    A null or empty text is one empty line, so the new text is never null.  Repeated rows count and come back each.
    Columns of ``docs`` with the new names are replaced.  With more than ``held_keys`` keys, rows are told
    apart by their place in ``docs``, which must then read the same twice (a table does).
    """
    own = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped") or c == text))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    split = own.select(F.struct("*").alias("doc"), lines.alias("lines"), F.monotonically_increasing_id().alias("row"))
    long_enough = F.filter(line_keys(F.col("lines")), lambda k: F.char_length(k) >= min_chars)
    each = split.select(F.explode(F.array_distinct(long_enough)).alias("key"))
    counted = each.select(F.xxhash64("key").alias("first"), F.xxhash64(F.lit(1), F.col("key")).alias("second"))
    keys = materialise(counted.groupBy("first", "second").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs))

    # the most frequent keys, by powers of two of their count, as many as may be held
    sizes = {r["power"]: r["keys"] for r in keys.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("keys")).collect()}
    power, n_held, n_keys = max(sizes, default=0) + 1, 0, sum(sizes.values())
    while power and n_held + sizes.get(power - 1, 0) <= held_keys:
        power -= 1
        n_held += sizes.get(power, 0)
    frequent = F.floor(F.log2("n")) >= power
    probe = held_probe(keys.where(frequent), n_held, min_docs)

    hashes = split.withColumn("keys", line_keys(F.col("lines"))).select(
        "doc", "lines", "row", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("first"),
        F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)).alias("second"))
    found = hashes.withColumn("gone", probe("first", "second"))
    if n_held < n_keys:
        pair = lambda k: F.struct(found["first"][k].alias("first"), found["second"][k].alias("second"))
        unsure = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda k: ~F.col("gone")[k])
        rest = found.select("row", F.inline(F.array_distinct(F.transform(unsure, pair))))
        hits = streamed_hits(rest, keys.where(~frequent), n_keys - n_held, min_docs)
        more = hits.groupBy(F.col("row").alias("of")).agg(F.collect_set(F.struct("first", "second")).alias("pairs"))  # at most a row's lines
        found = found.join(more, F.col("row") == F.col("of"), "left").withColumn("gone", F.when(F.col("pairs").isNull(), F.col("gone")).otherwise(
            F.transform(F.col("gone"), lambda g, k: g | F.array_contains(F.col("pairs"), pair(k)))))
    kept = F.filter("lines", lambda x, k: ~(F.col("gone")[k] & (F.char_length(F.col("keys")[k]) >= min_chars)))
    done = found.select("doc", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    keep = [F.array_join("kept", "\n").alias(c) if c == text else F.col("doc")[c].alias(c) for c in own.columns]
    return done.select(*keep, "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
