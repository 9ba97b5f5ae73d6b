"""Modes of columns with many values (A10, A11) by candidates.

``modal_value`` counts every distinct value.  Here one aggregate keeps a bounded number of counters per
column (Spark's frequent-items sketch), a second one counts only the values that hold a counter, and a
column whose mode the counters cannot prove is counted in full.  The result is that of ``modal_value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._names import as_list, col
from ..session import cut_lineage

#: Counters per column and group.
COUNTERS = 1024
#: Candidates are broadcast up to so many bytes; beyond that every value is counted.
MAX_BYTES = 64 << 20


def _best(counts: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Per key the largest count, then the smallest value, from counts per value."""
    rank = F.struct((-F.col("count")).alias("n"), F.col("value").alias("v"))
    return counts.groupBy(*[col(k) for k in keys]).agg(
        F.min_by("value", rank).alias("mode"), F.max("count").alias("mode_count"), F.sum("count").alias("seen"), *more)


def modes_by_candidates(df: DataFrame, columns: str | Sequence[str], group: str | Sequence[str] = (),
                        counters: int = COUNTERS) -> DataFrame:
    """(group..., variable, mode, mode_count, total, mode_share), equal to ``modal_value``: highest count, then the
    smallest value as text; NULL values and NULL groups take no part; a column without values has no row.

    A sketch's estimate is never below the true count, and a value that is not returned has at most the
    smallest estimate returned.  So a candidate counted more often than that is the mode, and so is the best
    candidate when the candidates cover every row.  Other columns (flat ones, such as keys) are counted in full.
    A task sends at most ``counters`` values per column and group; ``df`` is read twice, three times with a fallback.
    """
    cols, group = as_list(columns), as_list(group)
    keys = [*group, "variable"]
    texts = df.select(*[col(g) for g in group], *[col(c).cast("string").alias(c) for c in cols])
    if group:
        texts = texts.dropna(how="any", subset=[f"`{g}`" for g in group])

    def quoted(c: str) -> str:
        return "`" + c.replace("`", "``") + "`"

    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.expr(f"approx_top_k({quoted(c)}, {int(counters)}, {int(counters)}) "
                        f"FILTER (WHERE {quoted(c)} IS NOT NULL)").alias(f"__top{i}"),
                 F.count(col(c)).alias(f"__n{i}")]
    sketches = texts.groupBy(*[col(g) for g in group]).agg(*aggs)
    per_column = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"__top{i}").alias("top"),
                                    F.col(f"__n{i}").alias("total")) for i, c in enumerate(cols)])
    tops = cut_lineage(sketches.select(*[col(g) for g in group], F.inline(per_column)).where("total > 0"))

    def long_of(some: Sequence[str]) -> DataFrame:
        return texts.unpivot([col(g) for g in group], [col(c) for c in some], "variable", "value").where("value IS NOT NULL")

    key_bytes = sum((F.octet_length(col(k).cast("string")) for k in keys), F.lit(0))
    size = tops.agg(F.sum((key_bytes + 64) * (F.size("top") + 1) + F.aggregate(
        "top", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["item"])))).first()[0] or 0
    if size > MAX_BYTES:
        counts = long_of(cols).groupBy(*[col(k) for k in keys], "value").agg(F.count(F.lit(1)).alias("count"))
        return _shares(_best(counts, keys).withColumnRenamed("seen", "total"), keys)

    candidates = tops.select(*[col(k) for k in keys], F.explode("top").alias("top")).select(
        *[col(k) for k in keys], F.col("top")["item"].alias("value"), F.col("top")["count"].alias("estimate"))
    counts = (long_of(cols).join(F.broadcast(candidates), on=[*keys, "value"])
              .groupBy(*[col(k) for k in keys], "value")
              .agg(F.count(F.lit(1)).alias("count"), F.max("estimate").alias("estimate")))
    best = _best(counts, keys, F.max(F.col("count") > F.col("estimate")).alias("exceeded"))
    floor = F.array_min(F.transform("top", lambda x: x["count"])).alias("floor")
    judged = cut_lineage(tops.select(*[col(k) for k in keys], "total", floor).join(best, on=keys, how="left").withColumn(
        "proven", F.coalesce((F.col("seen") == F.col("total"))
                             | ((F.col("mode_count") > F.col("floor")) & ~F.col("exceeded")), F.lit(False))))
    found = judged.where("proven").select(*[col(k) for k in keys], "mode", "mode_count", "total")
    unproven = judged.where("NOT proven").select(*[col(k) for k in keys])
    rest = [r["variable"] for r in unproven.select("variable").distinct().collect()]  # at most the columns asked for
    if rest:
        open_rows = long_of(rest).join(F.broadcast(unproven), on=keys, how="left_semi")
        counts = open_rows.groupBy(*[col(k) for k in keys], "value").agg(F.count(F.lit(1)).alias("count"))
        found = found.unionByName(_best(counts, keys).withColumnRenamed("seen", "total"))
    return _shares(found, keys)


def _shares(modes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return modes.select(*[col(k) for k in keys], "mode", "mode_count", "total",
                        (F.col("mode_count") / F.col("total")).alias("mode_share"))
