"""Sort, top-k, category order, preview (O1-O4) and the cohort union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._names import as_list, col


def sort_by(df: DataFrame, keys: Sequence[str], descending: Sequence[bool] | bool = False,
            nulls_last: bool = True) -> DataFrame:
    """O1: multi-key sort with mixed directions; NULLs last in every key (stated)."""
    keys = as_list(keys)
    desc = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
    order = []
    for k, d in zip(keys, desc):
        c = col(k)
        if d:
            order.append(c.desc_nulls_last() if nulls_last else c.desc_nulls_first())
        else:
            order.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    return df.orderBy(*order)


def top_k(df: DataFrame, by: str, k: int = 5, descending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """O2: the first ``k`` rows by ``by`` (tie broken by ``tie`` keys): a TakeOrderedAndProject,
    which keeps ``k`` rows per task instead of sorting everything."""
    c = col(by)
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last()] + [col(t).asc() for t in as_list(tie)]
    return df.orderBy(*order).limit(k)


def category_rank(column: str | Column, order: Sequence) -> Column:
    """Position of the value in the declared order (0-based); a value outside it is NULL."""
    pairs = []
    for i, v in enumerate(order):
        pairs += [F.lit(v), F.lit(i)]
    return F.element_at(F.create_map(*pairs), col(column) if isinstance(column, str) else column)


def order_by_category(df: DataFrame, column: str, order: Sequence, rank_col: str | None = "category_rank",
                      null_unlisted: bool = True) -> DataFrame:
    """O3: sort by a declared category order.  A value outside the list becomes NULL (as the
    reference's categorical cast does) and sorts last; the rank is kept as a column."""
    r = category_rank(column, order)
    out = df.withColumn("__rank", r)
    if null_unlisted:
        out = out.withColumn(column, F.when(F.col("__rank").isNull(), F.lit(None)).otherwise(col(column)))
    out = out.orderBy(F.col("__rank").asc_nulls_last())
    return out.withColumnRenamed("__rank", rank_col) if rank_col else out.drop("__rank")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows (no order promised, as ``head`` on an unsorted table)."""
    return df.limit(n)


def stack_cohorts(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name (overlapping cohorts count a row once per cohort)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
