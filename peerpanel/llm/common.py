"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerpanel.session import cut_lineage, ensure_checkpoint_dir

#: The white space that separates words: space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so that
    lost executors do not repeat what stands before it."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for files of an operator, below the folder all executors share."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bitmaps of 4 KB, for 32,768 places each, that are broadcast at most.
MAX_BITMAPS = 16_384


def at_places(placed: DataFrame, row: str, places: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose ``row`` (a place from ``monotonically_increasing_id``) is in column ``place`` of
    ``places``; the columns are those of ``placed``.

    The places are folded into bitmaps, an eighth of a byte a row, so the rows themselves (with their texts) are not shuffled
    as long as the bitmaps may be broadcast; beyond that rows and places are joined."""
    bits, bucket = free_name(placed, "_bits"), free_name(placed, "_bucket")
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    bit = F.col("place").bitwiseAND(F.lit(32767))
    maps = materialise(places.groupBy(F.shiftright("place", 15).alias(bucket)).agg(F.bitmap_construct_agg(bit).alias(bits)))
    at = placed[quoted(row)]
    if maps.count() > MAX_BITMAPS:
        return placed.join(places, at == places["place"], "left_semi")
    byte = f"conv(hex(substring({bits}, int(({quoted(row)} & 32767) >> 3) + 1, 1)), 16, 10)"
    joined = placed.join(F.broadcast(maps), F.shiftright(at, 15) == maps[bucket])
    return joined.where(F.expr(f"(int({byte}) >> int({quoted(row)} & 7)) & 1 = 1")).select(*(placed[quoted(c)] for c in placed.columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it
    (also inside lambdas, where an expression would be computed once per element)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of values the driver holds, as literals of the plan (Spark knows its size)."""
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, schema.split(","))))
    fields = [tuple(x.split()) for x in schema.split(",")]
    structs = [F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
