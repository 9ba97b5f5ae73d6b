"""Filters and predicates.

Plain predicates on the key, so Catalyst pushes them into the Parquet scan.
Long value lists are joined as tables instead of inlined as IN lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._names import as_list, col
from .._names import value as as_value


def require_key(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """keep rows whose key is present."""
    cond = None
    for k in as_list(key):
        c = col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """drop rows with any NULL (in ``subset`` when given)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def split_target(df: DataFrame, key: str, target) -> tuple[DataFrame, DataFrame]:
    """(the target's rows, everyone else).  NULL keys belong to neither."""
    return df.where(col(key) == as_value(target)), df.where(col(key) != as_value(target))


def cohort_with_target(df: DataFrame, flag: str, key: str | None = None, target=None) -> DataFrame:
    """rows of the cohort flag, alone or ``OR key = target``."""
    cond = F.coalesce(col(flag), F.lit(False))
    if key is not None and target is not None:
        cond = cond | F.coalesce(col(key) == as_value(target), F.lit(False))
    return df.where(cond)


def in_values(df: DataFrame, column: str, values: Sequence, negate: bool = False) -> DataFrame:
    """F5 for short literal lists (pushed into the scan as an IN filter).  NOT IN keeps
    NULL-valued rows out, as SQL does."""
    cond = col(column).isin(list(values))
    return df.where(~cond if negate else cond)


def in_table(df: DataFrame, column: str, values: DataFrame, value_col: str | None = None,
             negate: bool = False) -> DataFrame:
    """F5 for lists of any length: semi (or anti) join against a one-column table.
    The join strategy is left to AQE, which broadcasts the list only when its
    measured size is under the broadcast threshold."""
    vc = value_col or values.columns[0]
    right = values.select(col(vc).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    how = "left_anti" if negate else "left_semi"
    out = df.join(right, col(column) == F.col("__v"), how)
    if negate:
        out = out.where(col(column).isNotNull())
    return out


def lookup(df: DataFrame, column: str, value, columns: Sequence[str] | None = None) -> DataFrame:
    """rows where a string attribute equals ``value``, projected to ``columns``."""
    out = df.where(col(column) == as_value(value))
    return out.select(*[col(c) for c in columns]) if columns else out


def exclude(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """leave-one-out; drop the named outliers before averaging."""
    if isinstance(ids, Column):  # one id found from the data (a scalar subquery)
        return df.where((col(key) != ids) | col(key).isNull() | ids.isNull())
    ids = as_list(ids) if not isinstance(ids, (list, tuple)) else list(ids)
    if not ids:
        return df
    return df.where(~col(key).isin(ids) | col(key).isNull())
