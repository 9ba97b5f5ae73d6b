"""Projection and column operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import drop_incomplete
from .._names import as_list, col


def order_columns(df: DataFrame, first: Sequence[str], rest: Sequence[str] | None = None) -> DataFrame:
    """Keys first, then the named rest (default: every other column in its current order)."""
    first = as_list(first)
    tail = list(rest) if rest is not None else [c for c in df.columns if c not in first]
    return df.select(*[col(c) for c in first + tail])


def strip_suffix(df: DataFrame, pattern: str = r"\s*\(HD\d{4}\)$") -> DataFrame:
    """Rename every column whose name matches ``pattern`` by removing the match.
    Names are plan-time facts, so this costs no job."""
    rx = re.compile(pattern)
    mapping = {c: rx.sub("", c) for c in df.columns if rx.search(c)}
    return df.withColumnsRenamed(mapping) if mapping else df


def add_literal(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column (year of a block, cohort label)."""
    return df.withColumn(name, F.lit(value))


def recode_binary(df: DataFrame, column: str, match, yes, no, out: str | None = None) -> DataFrame:
    """P5: ``yes`` where ``column == match``, otherwise ``no``.  A NULL column value goes to
    ``no`` (a missing designation counts as the other class), as in the reference."""
    cond = col(column) == F.lit(match)
    return df.withColumn(out or column, F.when(cond, F.lit(yes)).otherwise(F.lit(no)))


def override_key(df: DataFrame, overrides: DataFrame, on: str, key: str,
                 override_key_col: str | None = None) -> DataFrame:
    """P6 + J1: left join on ``on``; the override's key wins, the original stays when there is none.

    Override rows with a NULL in any column are ignored (F2).  A name listed twice in the
    overrides multiplies its rows, the same as the plain left join it models.
    """
    ok = override_key_col or key
    ov = drop_incomplete(overrides).select(col(on).alias(on), col(ok).alias("__override_key"))
    joined = df.join(ov, on=on, how="left")
    return joined.withColumn(key, F.coalesce(F.col("__override_key"), col(key))).drop("__override_key")


def row_total(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Sum of the named columns with NULL counted as 0; all-NULL gives 0."""
    cols = as_list(columns)
    expr = F.lit(0.0)
    for c in cols:
        expr = expr + F.coalesce(col(c).cast("double"), F.lit(0.0))
    return df.withColumn(name, expr)


def rescale(df: DataFrame, columns: Sequence[str], factor: float, divide: bool = False) -> DataFrame:
    """Multiply (or divide) many columns by one unit factor in one projection."""
    f = F.lit(float(factor))
    return df.withColumns({c: (col(c) / f) if divide else (col(c) * f) for c in as_list(columns)})


def label_cohort(df: DataFrame, source: str, label: str = "cohort", drop: Sequence[str] = ()) -> DataFrame:
    """Copy ``source`` under the cohort label name and drop the source columns."""
    out = df.withColumn(label, col(source))
    to_drop = [c for c in as_list(drop) if c != label]
    return out.drop(*to_drop) if to_drop else out


def short_labels(df: DataFrame, column: str, mapping: Mapping[str, str], out: str | None = None) -> DataFrame:
    """P10: long value to short label through a literal map; values not in the map are kept."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return df.withColumn(out or column, F.coalesce(F.element_at(m, col(column)), col(column)))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P10 on column names: long metric names to short labels."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df
