"""SimHash near-duplicates by ball hashing from both sides.

Every distinct fingerprint emits all variants within half the largest distance.  Two
fingerprints share a variant exactly if they are within that distance of each other: a
variant half-way on the bits that differ.  Rows with the same variant meet in a shuffle.

For a distance ``r`` the inner ball has radius ``r // 2`` and the outer ball the rest.  A
fingerprint whose inner ball holds a variant is within ``r`` of every one whose outer
ball holds it, so it is enough to link all outer ones to the smallest inner one, and all inner
ones to the smallest outer one: the same components as all pairs, without emitting pairs.
A variant has at most as many rows as a ball has members, whatever the data.  Links are
made distinct and their distance is verified.

Copies share one fingerprint, so they are one vertex, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_places, free_name, materialise
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The 64-bit SimHash of a text as an unsigned integer; zero for a text without words.

    A bit is set if it is set in over half of the XXH64 values (seed 42) of the shingles, repeats
    included.  A text of fewer words than a shingle is one shingle."""
    import xxhash

    # lower() and split() of bytes know ASCII letters and white space only
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle_words:
        return digest(join(words), 42)
    hashes = np.array([digest(join(x), 42) for x in zip(*(words[k:] for k in range(shingle_words)), strict=False)], "<u8")
    set_in = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k:k + 4096].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * set_in > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``_fp``: the fingerprint as a signed 64-bit integer."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "_fp")]
    names = [f.name for f in keep]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                fp = np.array([fingerprint(t, shingle_words) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(fp)], [*names, "_fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "_fp long"])
    return docs.select(*names, text).mapInArrow(hashed, schema)


def ball(value: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` bits of ``value``, with the number of bits changed."""
    def masks(r: int, low: int = 0) -> list[tuple[int, int]]:
        return [(0, 0)] if r == 0 else [(0, 0), *((1 << k | m, n + 1) for k in range(low, BITS) for m, n in masks(r - 1, k + 1))]

    signed = lambda m: m - (1 << 64) if m >> 63 else m
    distinct = sorted(set(masks(radius)))
    if len(distinct) > 3000:
        raise ValueError("a ball of radius 2 is the largest that is emitted")
    table = F.array(*(F.struct(F.lit(signed(m)).alias("mask"), F.lit(n).alias("changed")) for m, n in distinct))
    return F.transform(table, lambda x: F.struct(value.bitwiseXOR(x["mask"]).alias("variant"), x["changed"].alias("changed")))


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in ``_fp`` that connect what is within
    ``max_bits``; each link is within ``max_bits`` itself."""
    inner, outer = max_bits // 2, max_bits - max_bits // 2
    emitted = distinct.select("_fp", F.inline(ball(F.col("_fp"), outer)))
    member = F.struct(F.col("_fp"), (F.col("changed") <= inner).alias("inner"))
    met = (emitted.groupBy("variant")
           .agg(F.collect_list(member).alias("members"))  # at most the members of a ball
           .where((F.size("members") > 1) & F.exists("members", lambda x: x["inner"])))
    least = met.select(
        "members", F.array_min("members._fp").alias("first_outer"),
        F.array_min(F.transform(F.filter("members", lambda x: x["inner"]), lambda x: x["_fp"])).alias("first_inner"))
    each = F.transform("members", lambda x: F.when(x["inner"], F.array(F.col("first_inner"), F.col("first_outer")))
                       .otherwise(F.array(F.col("first_inner"))))
    links = (least.select(F.explode(F.arrays_zip(F.col("members._fp").alias("b"), each.alias("to"))).alias("x"))
             .select(F.explode("x.to").alias("a"), F.col("x.b").alias("b")))
    return links.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).distinct()


def components_of(hashed: DataFrame, max_bits: int, key: Column) -> DataFrame:
    """(_vertex, component): for each fingerprint in ``hashed`` (column ``_fp``) the smallest ``key`` of its component."""
    vertices = materialise(hashed.groupBy("_fp").agg(F.min(key).alias("_least")))
    roots = connected_components(fingerprint_links(vertices, max_bits))
    rooted = materialise(vertices.join(roots, F.col("_fp") == F.col("vertex"), "left")
                         .select("_fp", "_least", F.coalesce("root", "_fp").alias("_root")))
    smallest = materialise(rooted.groupBy("_root").agg(F.min("_least").alias("component")))
    return materialise(rooted.join(smallest, "_root").select(F.col("_fp").alias("_vertex"), "component"))


def near_duplicates(docs: DataFrame, shingle_words: int, max_bits: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` (16 hex digits) and ``component_id``: the smallest
    ``key`` of the documents that links of at most ``max_bits`` differing bits reach.

    A null or empty text, or one without words, has the fingerprint zero and is linked like any
    other.  A null key is never the smallest unless all keys of the component are null.  Repeated
    rows all come back.  Columns of ``docs`` with the new names are replaced.
    """
    own = docs.drop(*(c for c in ("fingerprint", "component_id") if c not in (key, text)))
    hashed = materialise(fingerprints(own, shingle_words, text))
    of = components_of(hashed, max_bits, F.col(key)).withColumnRenamed("component", "component_id")
    return (hashed.join(of, F.col("_fp") == F.col("_vertex"))
            .withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0")))
            .drop("_fp", "_vertex"))


def one_of_each(docs: DataFrame, shingle_words: int, max_bits: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, as it is in ``docs``: the one with the smallest ``key`` (null last).

    Rows that share this key are told apart by their place in ``docs``, which must read the same
    twice (a table does).  Only fingerprints and places are shuffled; the texts are read again."""
    row = free_name(docs, "_row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    hashed = materialise(fingerprints(placed.select(F.col(key).alias("_key"), F.col(row).alias("_place"), text), shingle_words, text))
    first = F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("k"), F.col("_place").alias("row"))
    chosen = materialise(components_of(hashed, max_bits, first).select(F.col("component.row").alias("place")).distinct())
    return at_places(placed, row, chosen).select(docs.columns)
