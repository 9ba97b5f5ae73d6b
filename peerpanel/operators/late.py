"""First and latest rows by late fetch.

``dedupe`` and ``latest`` carry values through the aggregate; strings there mean that every task sorts its
rows, texts included.  Here the aggregate sees the keys, the order and the place of a row only, all of fixed
width (a hash aggregate over a scan of two or three columns), and the chosen rows are fetched by a second
scan that tests places against bitmaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._names import as_list, col
from ..session import cut_lineage

#: Bitmaps of 4 KB, for 32,768 places each, that are broadcast at most (64 MB).
MAX_BITMAPS = 16_384
_BITS = {T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.DateType: 32, T.LongType: 64,
         T.TimestampType: 64}
#: What a decimal(38, 0) holds.
MAX_BITS = 126


def packed_order(df: DataFrame, order: str | Sequence[str]) -> Column:
    """One decimal that sorts as the columns do one after the other, NULL before every value.

    Booleans, whole numbers, dates and timestamps, up to 126 bits together (a bit a column is for NULL); others raise."""
    packed, used = None, 0

    def wide(x) -> Column:  # a whole number of any size as a decimal
        return (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(38,0)")

    for c in as_list(order):
        kind = df.schema[c].dataType
        bits = _BITS.get(type(kind))
        if bits is None:
            raise ValueError(f"{c!r} of type {kind.simpleString()} has no fixed-width order")
        used += bits + 1
        x = col(c)
        if isinstance(kind, T.DateType):
            x = F.unix_date(x)
        elif isinstance(kind, T.TimestampType):
            x = F.unix_micros(x)
        elif isinstance(kind, T.BooleanType):
            x = x.cast("int")
        lowest = 0 if bits == 1 else -(2 ** (bits - 1))
        digit = F.coalesce(wide(wide(x) - wide(lowest - 1)), wide(0))
        packed = digit if packed is None else wide(wide(packed * wide(2 ** (bits + 1))) + digit)
    if packed is None:
        raise ValueError("no order columns")
    if used > MAX_BITS:
        raise ValueError(f"the order takes {used} bits, {MAX_BITS} are held")
    return packed


def pick_rows(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], descending: bool = False) -> DataFrame:
    """The whole row of each key that comes first by ``order`` (NULL first), or last if ``descending``; one row
    per key, NULL keys too, columns as in ``df``.  Any one of tied rows is kept, as in ``dedupe``.

    ``df`` is read twice and must read the same twice: scans, filters and projections of files or a checkpoint do, a
    shuffle or a random value before does not (cut its lineage first).  Places go to the second scan as bitmaps, an
    eighth of a byte a row, broadcast up to 64 MB; beyond that they join by place."""
    place, best = _free(df, "_place"), packed_order(df, order)
    placed = df.withColumn(place, F.monotonically_increasing_id())
    pick = F.max_by if descending else F.min_by
    chosen = placed.groupBy(*[col(k) for k in as_list(key)]).agg(pick(col(place), best).alias("place")).select("place")
    return rows_at(placed, place, chosen).drop(place)


def latest_rows(df: DataFrame, keys: str | Sequence[str], columns: str | Sequence[str],
                by: str | Sequence[str] = "year") -> DataFrame:
    """A2 by late fetch: the values of the row with the latest ``by``, NULL if they are NULL there.  As in ``latest``, a
    key that has no ``by`` at all (one column) has NULL values."""
    keys, by = as_list(keys), as_list(by)
    rows = pick_rows(df, keys, by, descending=True)
    known = col(by[0]).isNotNull() if len(by) == 1 else F.lit(True)
    return rows.select(*[col(k) for k in keys], *[F.when(known, col(c)).alias(c) for c in as_list(columns)])


def rows_at(placed: DataFrame, place: str, places: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose column ``place`` (from ``monotonically_increasing_id``) is among ``places`` (one
    column, no value twice).  The rows are not shuffled as long as the bitmaps of places may be broadcast."""
    bits, bucket = _free(placed, "_bits"), _free(placed, "_bucket")
    found = places.columns[0]
    maps = cut_lineage(places.groupBy(F.shiftright(col(found), 15).alias(bucket))
                       .agg(F.bitmap_construct_agg(col(found).bitwiseAND(F.lit(32767))).alias(bits)))
    if maps.count() > MAX_BITMAPS:
        return placed.join(places, placed[f"`{place}`"] == places[f"`{found}`"], "left_semi")
    at = col(place).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), at.bitwiseAND(F.lit(7)) + 1)
    near = placed.join(F.broadcast(maps), F.shiftright(placed[f"`{place}`"], 15) == maps[bucket])
    return near.where(byte.bitwiseAND(mask) != 0).select(*[col(c) for c in placed.columns])


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
