"""Aggregations.

Every aggregate here is decomposable (sum, count, min/max, min_by/max_by,
collect_set of a bounded set), so Spark runs a partial aggregate before the
shuffle: a key holding a third of all rows is reduced to one row per map task
before it moves.  Shares and modes are computed from pre-aggregated counts and
joined back, never with a window over raw rows of a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._names import as_list, col, others


def club(df: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), values: Sequence[str] | None = None,
         as_double: bool = False) -> DataFrame:
    """A1: sum every value column by key; a group whose values are all NULL sums to 0.

    ``carry`` columns (the entity name) keep their smallest value, a stated and
    deterministic choice where the reference keeps the first in file order.
    ``values`` defaults to every column that is neither a key nor carried,
    resolved from the schema at plan time.
    """
    keys, carry = as_list(keys), as_list(carry)
    vals = list(values) if values is not None else others(df.columns, keys + carry)
    aggs = [F.min(col(c)).alias(c) for c in carry]
    for v in vals:
        s = F.sum(col(v))
        if as_double:
            s = s.cast("double")
        aggs.append(F.coalesce(s, F.lit(0)).alias(v))
    return df.groupBy(*[col(k) for k in keys]).agg(*aggs)


def latest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], by: str | Sequence[str] = "year") -> DataFrame:
    """A2: per group, the value from the latest ``by`` (NULL if the latest value is NULL).
    ``by`` may be several columns; later ones break ties."""
    order = _order_key(by)
    return df.groupBy(*[col(k) for k in as_list(keys)]).agg(
        *[F.max_by(col(c), order).alias(c) for c in as_list(columns)])


def _order_key(by: str | Sequence[str]) -> Column:
    b = as_list(by)
    return col(b[0]) if len(b) == 1 else F.struct(*[col(x) for x in b])


def entity_profile(df: DataFrame, key: str | Sequence[str], attrs: Sequence[str], metrics: Sequence[str],
                   order: str | Sequence[str] = "year", carry_order: bool = True) -> DataFrame:
    """A4: one row per entity: latest value of each attribute (A2) and mean of each metric
    (A3, NULLs skipped), in one aggregate.  ``carry_order`` also returns the latest ``order``."""
    ok = _order_key(order)
    aggs = []
    if carry_order:
        aggs += [F.max(col(o)).alias(o) for o in as_list(order)[:1]]
    aggs += [F.max_by(col(a), ok).alias(a) for a in as_list(attrs)]
    aggs += [mean_of(m).alias(m) for m in as_list(metrics)]
    return df.groupBy(*[col(k) for k in as_list(key)]).agg(*aggs)


def mean_of(c: str) -> Column:
    """A3: mean with NULLs skipped, as a double: ``sum / count``.  On decimal input the sum
    is exact, so the mean does not depend on row order."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)))


def change_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                  skip: Sequence[str] = ("year",), suffix: str = "_unique_count") -> DataFrame:
    """A5: per entity, number of distinct non-NULL values of every attribute.

    ``size(collect_set(c))`` keeps one small set per attribute (its values over the
    years) and skips NULLs, and runs as one aggregate however many columns there
    are; ``count(DISTINCT)`` on k columns would expand every row k times.
    Output columns follow the declared order (P1).
    """
    keys = as_list(keys)
    cols = list(columns) if columns is not None else others(df.columns, keys + list(skip))
    return df.groupBy(*[col(k) for k in keys]).agg(
        *[F.size(F.collect_set(col(c))).cast("long").alias(f"{c}{suffix}") for c in cols])


def count_by(df: DataFrame, keys: Sequence[str], dropna: bool = False, name: str = "count") -> DataFrame:
    """A6 (NULL group kept) and A7 (``dropna=True``: rows with a NULL key dropped)."""
    keys = as_list(keys)
    src = df.dropna(how="any", subset=keys) if dropna else df
    return src.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Counts of each non-NULL value, largest first (value breaks ties)."""
    return (df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.col(name).desc(), col(column).asc()))


def _long_values(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Unpivot attribute columns into (group..., variable, value) as text, NULLs dropped."""
    group = as_list(group)
    cols = as_list(columns)
    return (df.select(*[col(g) for g in group], *[col(c).cast("string").alias(c) for c in cols])
            .unpivot([col(g) for g in group] if group else [], [col(c) for c in cols], "variable", "value")
            .where(F.col("value").isNotNull()))


def value_shares(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Proportion of each value among the non-NULL rows of each column.

    Counts per (variable, value) are aggregated first; totals per variable come
    from a second aggregate over those counts and are joined back on the
    variable, so no task ever holds the rows of a whole column.
    """
    group = as_list(group)
    long = _long_values(df, columns, group)
    counts = long.groupBy(*group, "variable", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*group, "variable").agg(F.sum("count").alias("total"))
    return (counts.join(totals, on=[*group, "variable"])
            .withColumn("share", F.col("count") / F.col("total")))


def modal_value(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mode of each column (per group), with its count and share.

    Tie rule (the reference leaves it unspecified): highest count, then the
    smallest value as text.  Built from pre-aggregated counts with ``min_by``
    over ``(-count, value)``, so a hot value is one row before it moves.
    """
    group = as_list(group)
    shares = value_shares(df, columns, group)
    rank = F.struct((-F.col("count")).alias("n"), F.col("value").alias("v"))
    return shares.groupBy(*group, "variable").agg(
        F.min_by("value", rank).alias("mode"),
        F.max("count").alias("mode_count"),
        F.max("total").alias("total"),
    ).withColumn("mode_share", F.col("mode_count") / F.col("total"))


def modal_by_group(df: DataFrame, group: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mode of every attribute per group, wide: one row per group, one column per attribute."""
    group = as_list(group)
    long = modal_value(df, columns, group)
    return long.groupBy(*group).pivot("variable", list(columns)).agg(F.first("mode"))


def cohort_means(df: DataFrame, metrics: Sequence[str], cohort: str | Sequence[str] | None = None) -> DataFrame:
    """Mean of many columns, per cohort (all cohorts in one pass) or over everything."""
    aggs = [mean_of(m).alias(m) for m in as_list(metrics)]
    if cohort is None:
        return df.agg(*aggs)
    return df.groupBy(*[col(c) for c in as_list(cohort)]).agg(*aggs)


def rollup_by(df: DataFrame, key: str | Sequence[str], metrics: Sequence[str], how: str = "mean") -> DataFrame:
    """Group mean or sum by parameter; rows with a NULL group key are dropped."""
    keys = as_list(key)
    if how not in ("mean", "sum", "total"):
        raise ValueError(f"unknown rollup method {how!r}")
    def fn(m):
        return mean_of(m) if how == "mean" else F.sum(col(m))
    return df.dropna(how="any", subset=keys).groupBy(*[col(k) for k in keys]).agg(
        *[fn(m).alias(m) for m in as_list(metrics)])


def cluster_profile(df: DataFrame, metrics: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean profile per cluster."""
    return cohort_means(df, metrics, cluster)


def distinct_values(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """A15."""
    return df.select(*[col(c) for c in as_list(columns)]).distinct()


def dedupe(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column] | None = None,
           descending: bool = False) -> DataFrame:
    """Keep one row per key: the first by ``order`` (ascending, or all descending).

    Written as ``min_by``/``max_by`` of the whole row, which is partially
    aggregated: a key with millions of rows never lands whole in one task (a
    ``row_number`` window would sort them all there).
    """
    keys = as_list(key)
    rest = [c for c in df.columns if c not in keys]
    order = list(order) if order else rest
    ord_key = F.struct(*[col(o) if isinstance(o, str) else o for o in order])
    pick = F.max_by if descending else F.min_by
    row = F.struct(*[col(c) for c in rest])
    out = df.groupBy(*[col(k) for k in keys]).agg(pick(row, ord_key).alias("__row"))
    return out.select(*[col(k) for k in keys], *[F.col("__row")[c].alias(c) for c in rest])


def row_count(df: DataFrame, group: str | Sequence[str] | None = None, name: str = "n") -> DataFrame:
    """Number of rows in the table or per group, as a DataFrame (no action)."""
    if group is None:
        return df.agg(F.count(F.lit(1)).alias(name))
    return df.groupBy(*[col(g) for g in as_list(group)]).agg(F.count(F.lit(1)).alias(name))
