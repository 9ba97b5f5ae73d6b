"""Joins (J1-J7).

Strategy: joins on the entity key are left to the planner.  With AQE on, a
side whose *measured* size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
is broadcast at run time and everything else stays a shuffle join, so no side
is broadcast on trust.  An explicit hint (:func:`bounded`) is used only for
sides whose row count is bounded by construction: one-row statistics, and
dimension tables grouped by a bounded category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._names import as_list, col


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast hint for a side whose size is bounded by construction (one row, or one row
    per category of a closed list).  Never use it on a side that grows with the data."""
    return F.broadcast(df)


def left_join_suffix(left: DataFrame, right: DataFrame, on: str | Sequence[str], suffix: str = "_right",
                     how: str = "left") -> DataFrame:
    """Equi-join on shared key names; right columns that clash get ``suffix``."""
    keys = as_list(on)
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    r = right.withColumnsRenamed(clash) if clash else right
    return left.join(r, on=keys, how=how)


def left_join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 how: str = "left", drop_right_key: bool = True) -> DataFrame:
    """Equi-join on differently named keys; the right key is dropped."""
    r = right.withColumnRenamed(right_key, "__rk")
    out = left.join(r, col(left_key) == F.col("__rk"), how)
    return out.drop("__rk") if drop_right_key else out.withColumnRenamed("__rk", right_key)


def panel_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
               suffix: str = "_right", how: str = "inner") -> DataFrame:
    """Join on a two-column (entity, year) key; clashing right columns keep a suffix,
    right key columns are dropped (they equal the left ones)."""
    lk, rk = as_list(left_keys), as_list(right_keys)
    tmp = {c: f"__rk{i}" for i, c in enumerate(rk)}
    r = right.withColumnsRenamed(tmp)
    clash = {c: c + suffix for c in r.columns if c in left.columns}
    r = r.withColumnsRenamed(clash) if clash else r
    cond = None
    for i, l in enumerate(lk):
        c = col(l) == F.col(f"__rk{i}")
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*tmp.values())


def attach_dimension(agg: DataFrame, dim: DataFrame, agg_key: str, dim_key: str,
                     dim_bounded: bool = False) -> DataFrame:
    """Inner join of an aggregate to a dimension: groups absent from the dimension vanish.
    ``dim_bounded`` is for a caller that knows the dimension to be a closed list; else Spark
    decides by its measured size."""
    d = bounded(dim) if dim_bounded else dim
    if agg_key == dim_key:
        return agg.join(d, on=agg_key, how="inner")
    return agg.join(d, col(agg_key) == col(dim_key), "inner")


def member_ids(df: DataFrame, members: DataFrame, name_col: str, key: str,
               member_name_col: str | None = None) -> DataFrame:
    """Distinct ids whose name appears in the member list (the J5/J6 lookup), as a table."""
    mn = member_name_col or members.columns[0]
    names = members.select(col(mn).alias("__name")).where(F.col("__name").isNotNull()).distinct()
    hits = df.join(names, col(name_col) == F.col("__name"), "left_semi")
    return hits.select(col(key).alias("__member_id")).where(F.col("__member_id").isNotNull()).distinct()


def flag_members(df: DataFrame, members: DataFrame, name_col: str, key: str, out: str = "member",
                 member_name_col: str | None = None) -> DataFrame:
    """A list of names -> the distinct ids carrying any of them -> TRUE on every row of
    those ids (in every year), FALSE elsewhere.  An existence join; nothing is collected."""
    ids = member_ids(df, members, name_col, key, member_name_col)
    joined = df.join(ids, col(key) == F.col("__member_id"), "left")
    return joined.withColumn(out, F.col("__member_id").isNotNull()).drop("__member_id")


def keep_members(df: DataFrame, members: DataFrame, name_col: str, key: str,
                 member_name_col: str | None = None) -> DataFrame:
    """Members only (semi join on the member ids)."""
    ids = member_ids(df, members, name_col, key, member_name_col)
    return df.join(ids, col(key) == F.col("__member_id"), "left_semi")


def attach(df: DataFrame, side: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Attach columns computed on the side to the same rows, aligned on the key
    (never on row position)."""
    return df.join(side, on=as_list(key), how=how)
