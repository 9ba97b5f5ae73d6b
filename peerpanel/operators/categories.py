"""Category dictionaries and sparse indicators for columns with many values.

``one_hot`` makes a column per value, so its list of values is a plan-time fact.  Here the list stays a
distributed table: ids come from a range-partitioned table of distinct values with an offset per partition,
and go back to the rows by joins.  The driver holds one size per column.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._names import as_list, col
from ..session import cut_lineage, scratch_path
from .joins import bounded

#: A value of more than a thousandth of a column's rows is joined by broadcast: fewer than a thousand values a column.
HOT_PART = 1000
#: Rows that have no value left to look up are spread over so many keys.
SALTS = 4096
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _text(df: DataFrame, c: str) -> Column:
    """A category as text; both zeros of a floating-point column are one category."""
    kind = df.schema[c].dataType
    x = col(c) + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else col(c)
    return x.cast("string")


def category_dictionary(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """(variable, value, id, count) for every distinct non-NULL value of the columns: ``id`` counts from 0
    within a variable, in the order of ``one_hot`` (text by code point, numbers by size); ``value`` is text.

    Counts are aggregated before they move, so a hot value is one row per task.  The distinct values are
    dealt by ranges and written once; an id is the place in its range plus the values of the ranges before.
    A column of NULLs, and an empty table, give no rows.
    """
    cols = as_list(columns)
    numeric = [c for c in cols if not isinstance(df.schema[c].dataType, T.StringType)]
    whole = [c for c in cols if isinstance(df.schema[c].dataType, _WHOLE)]
    counts = (df.select(*[_text(df, c).alias(c) for c in cols])
              .unpivot([], [col(c) for c in cols], "variable", "value").where(F.col("value").isNotNull())
              .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count")))
    of = F.col("variable")
    size = F.when(of.isin(numeric), F.expr("try_cast(value AS double)"))
    exact = F.when(of.isin(whole), F.expr("try_cast(value AS decimal(20,0))"))  # beyond 2^53 a double is no order
    order = ["variable", "_size", "_exact", "value"]
    dealt = counts.select("*", size.alias("_size"), exact.alias("_exact")).repartitionByRange(*order)
    dealt = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("variable").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("variable", "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per variable and range
               .select("variable", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    place = F.row_number().over(Window.partitionBy("variable", "_range").orderBy("_size", "_exact", "value"))
    return (dealt.withColumn("_place", place).join(offsets, ["variable", "_range"])
            .select("variable", "value", (F.col("_offset") + F.col("_place") - 1).alias("id"), "count"))


def _look_up(df: DataFrame, c: str, dictionary: DataFrame, out: str) -> DataFrame:
    """``df`` with the id of ``c`` as ``out`` (NULL if the dictionary has no such value).

    Hot values are found by broadcast.  The other rows look up by a shuffle join in which rows that need
    nothing more are dealt by a salt, so neither a hot value nor NULL is one task."""
    own = dictionary.where(F.col("variable") == c)
    total = own.agg(F.sum("count").alias("n")).scalar()
    is_hot = F.col("count") * HOT_PART > total
    hot = own.where(is_hot).select(F.col("value").alias("__hv"), F.col("id").alias("__hid"))
    cold = own.where(~is_hot).select(F.col("value").alias("__cv"), F.col("id").alias("__cid"), F.lit(0).alias("__cs"))
    salt = F.pmod(F.xxhash64(*[col(x) for x in df.columns]), F.lit(SALTS)).cast("int")
    near = df.join(bounded(hot), _text(df, c) == F.col("__hv"), "left")
    open_value = F.when(F.col("__hid").isNull(), _text(df, c))
    near = near.withColumn("__ov", open_value).withColumn("__os", F.when(F.col("__ov").isNull(), salt).otherwise(F.lit(0)))
    far = near.join(cold, (F.col("__ov") == F.col("__cv")) & (F.col("__os") == F.col("__cs")), "left")
    return far.select(*[col(x) for x in df.columns], F.coalesce("__hid", "__cid").alias(out))


def one_hot_places(df: DataFrame, columns: str | Sequence[str], dictionary: DataFrame | None = None, out: str = "places",
                   first: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """Rows of ``df`` without ``columns``, with the ascending places of their ones as ``out`` (array of int), and the
    number of values of each column.

    The columns are blocks in their given order, from place ``first`` on; a place is the block's begin plus the id.
    NULL, and a value that a given ``dictionary`` does not have, give no one.  Repeated rows all come back.
    """
    cols = as_list(columns)
    known = dictionary if dictionary is not None else cut_lineage(category_dictionary(df, cols))
    found = {r["variable"]: r["n"] for r in known.groupBy("variable").agg((F.max("id") + 1).alias("n")).where(F.col("variable").isin(cols)).collect()}
    sizes = {c: found.get(c, 0) for c in cols}
    if first + sum(sizes.values()) >= 1 << 31:
        raise ValueError("more values than places of a vector")
    ids, place = [], first
    for k, c in enumerate(cols):
        df = _look_up(df, c, known, f"__id{k}")
        ids.append((F.col(f"__id{k}") + F.lit(place)).cast("int"))
        place += sizes[c]
    ones = F.array_compact(F.array(*ids))
    return df.select(*[col(x) for x in df.columns if x not in cols and not x.startswith("__id")], ones.alias(out)), sizes


def features_sparse(df: DataFrame, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
                    out: str = "features", dictionary: DataFrame | None = None) -> DataFrame:
    """M2 for columns with many values: key and one sparse vector, the numeric columns (as they are; NULL is NaN) followed
    by one place per category value.  Every categorical column is encoded, codes too.

    Vectors are written once to the shared scratch folder and read back as such, so no row passes Python.
    """
    keys, num, cat = as_list(key), as_list(numeric), as_list(categorical)
    base = df.select(*[col(k) for k in keys], *[col(c).cast("double").alias(f"__n{i}") for i, c in enumerate(num)],
                     *[col(c).alias(f"__c{i}") for i, c in enumerate(cat)])
    named = [f"__c{i}" for i in range(len(cat))]
    if dictionary is not None:
        names = F.create_map(*[F.lit(x) for i, c in enumerate(cat) for x in (c, f"__c{i}")])
        dictionary = dictionary.where(F.col("variable").isin(cat)).withColumn("variable", names[F.col("variable")])
    placed, sizes = one_hot_places(base, named, dictionary, out="__places", first=len(num))
    numbers = F.array(*[F.struct(F.lit(i).alias("at"), F.coalesce(f"__n{i}", F.lit(float("nan"))).alias("x")) for i in range(len(num))])
    told = F.filter(numbers, lambda s: s["x"] != 0) if num else F.array().cast("array<struct<at:int,x:double>>")
    ones = F.transform("__places", lambda p: F.struct(p.alias("at"), F.lit(1.0).alias("x")))
    entries = F.concat(told, ones)
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(num) + sum(sizes.values())).cast("int").alias("size"),
                      F.col("__e")["at"].alias("indices"), F.col("__e")["x"].alias("values"))
    rows = placed.withColumn("__e", entries).select(*[col(k) for k in keys], vector.alias(out))
    path = scratch_path(df.sparkSession, f"features-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    kept = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return df.sparkSession.read.schema(T.StructType([*kept, T.StructField(out, VectorUDT())])).parquet(path)
