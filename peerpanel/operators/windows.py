"""Per-group transforms.

Group statistics are computed as an aggregate and joined back instead of a
window over raw rows: a window puts every row of a group in one task, while
the aggregate is combined map-side and the join back is either broadcast (a
bounded statistics table) or a shuffle join that AQE splits when one group is
hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._names import as_list, col
from .joins import bounded


def share_within(df: DataFrame, group: str | Sequence[str], value: str, out: str = "share",
                 group_bounded: bool = False) -> DataFrame:
    """Value / sum of the value in its group, rows kept.  A group summing to 0 gives NULL
    (``try_divide``; a plain ``/`` raises under ANSI mode)."""
    g = as_list(group)
    sums = df.groupBy(*[col(x).alias(f"__g{i}") for i, x in enumerate(g)]).agg(
        F.sum(col(value)).alias("__group_sum"))
    if group_bounded:
        sums = bounded(sums)
    # null-safe: a NULL group key is a group of its own, as in the reference
    cond = None
    for i, x in enumerate(g):
        c = col(x).eqNullSafe(F.col(f"__g{i}"))
        cond = c if cond is None else cond & c
    joined = df.join(sums, cond, "left").drop(*[f"__g{i}" for i in range(len(g))])
    return (joined.withColumn(out, F.try_divide(col(value).cast("double"), F.col("__group_sum").cast("double")))
            .drop("__group_sum"))


def standardize(df: DataFrame, columns: Sequence[str], by: str | Sequence[str] | None = None,
                suffix: str = "", ddof: int = 0) -> DataFrame:
    """(x - mean) / std with the population std (ddof 0), as scikit-learn's scaler; a
    constant column (std 0) gives 0.  NULLs are skipped in the statistics and stay NULL.

    Statistics are one aggregate (one row, or one row per ``by`` group), joined
    back by broadcast: never a window over the whole frame.
    """
    cols = as_list(columns)
    stdf = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(col(c)).alias(f"__m_{c}"), stdf(col(c)).alias(f"__s_{c}")]
    if by is None:
        stats = df.agg(*aggs)
        out = df.crossJoin(bounded(stats))
    else:
        keys = as_list(by)
        stats = df.groupBy(*[col(k) for k in keys]).agg(*aggs)
        out = df.join(stats, on=keys, how="left")
    new = {}
    for c in cols:
        s = F.col(f"__s_{c}")
        scale = F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
        new[f"{c}{suffix}"] = (col(c) - F.col(f"__m_{c}")) / scale
    out = out.withColumns(new)
    return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


def rank_within(df: DataFrame, group: str | Sequence[str], order: Sequence[Column | str], out: str = "rank",
                top: int | None = None) -> DataFrame:
    """Row number within a group by a stated order (ties broken by the later order keys).

    With ``top`` only the first rows of each group are kept; Spark then plans a
    partial group limit before the shuffle, so a hot group sends at most ``top``
    rows per map task.

    Without ``top`` a window would put a hot group in one task, so the rows are
    range-partitioned on (group, order) -- which splits a hot group across tasks --
    and each row's rank is its position within its partition plus the rows of its
    group in earlier partitions (a small table of per-partition counts).
    """
    groups = [col(g) for g in as_list(group)]
    order_cols = [col(o) if isinstance(o, str) else o for o in order]
    if top is not None:
        w = Window.partitionBy(*groups).orderBy(*order_cols)
        return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= top)
    return _rank_by_sorted_partitions(df, as_list(group), order_cols, out)


def _rank_by_sorted_partitions(df: DataFrame, group: list[str], order_cols: list[Column], out: str) -> DataFrame:
    from ..session import cut_lineage

    gcols = {g: f"__g{i}" for i, g in enumerate(group)}
    keyed = df.withColumns({v: col(g) for g, v in gcols.items()})
    ordered = keyed.orderBy(*[F.col(v).asc_nulls_first() for v in gcols.values()], *order_cols)
    # Partition ids and positions must be those of one materialised sort: checkpoint it.
    tagged = cut_lineage(ordered.withColumn("__pid", F.spark_partition_id())
                         .withColumn("__mid", F.monotonically_increasing_id()))
    per_part = tagged.groupBy("__pid", *gcols.values()).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    w = Window.partitionBy(*gcols.values()).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    cond = F.col("t.__pid") == F.col("p.__pid")
    for v in gcols.values():
        cond = cond & F.col(f"t.{v}").eqNullSafe(F.col(f"p.{v}"))
    joined = tagged.alias("t").join(per_part.alias("p"), cond)
    rank = F.col("p.__before") + (F.col("t.__mid") - F.col("p.__first")) + 1
    return joined.select(*[F.col(f"t.`{c}`") for c in df.columns], rank.alias(out))
