"""Exact quantiles, quantile bins, box statistics, median fill.

Exact linear-interpolation quantiles (numpy's default rule) by radix selection, one method at
every size, without sorting, sampling or writing the values:

1. Every value becomes a 64-bit integer of the same order (:func:`with_order_bits`).
2. A pass counts the values by the leading bits of these integers, for every (group, column) at once; the
   counts add up before the shuffle, so a value repeated a billion times is one counter.
3. The running count tells which prefix holds each wanted rank.  The next pass counts only
   the values with such a prefix, by more bits, until the last pass has all of them.

What is shuffled is counters: at most 2 ** 22 for each chosen prefix of a pass.  Groups are joined
null-safe: a NULL group is a group of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._names import as_list, col
from ..constants import QUARTILE_LABELS
from ..session import cut_lineage
from .joins import bounded


def _same(keys: Sequence[str], a: str, b: str):
    """Null-safe equality of the keys of two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return cond


def _wide_numeric(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    cols = as_list(columns)
    sel = [col(b).alias(b) for b in as_list(by)]
    for c in cols:
        v = col(c).cast("double")
        sel.append(F.when(F.isnan(v), F.lit(None)).otherwise(v).alias(c))
    return df.select(*sel)


def _unpivot(wide: DataFrame, columns: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    by = as_list(by)
    long = wide.unpivot([F.col(f"`{b}`") for b in by] if by else [], [F.col(f"`{c}`") for c in columns], "variable", value)
    return long.where(F.col(value).isNotNull())


#: Bits that the passes leave away: the first counts by the 22 leading ones, the last by all 64.
SHIFTS = (42, 21, 0)


def with_order_bits(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every double column of ``columns`` (no NaN) as a long of the same order: exponent and mantissa, the
    sign in front.

    Powers of two divide exactly, so no bit is lost; the logarithm is only a first guess at
    the exponent."""
    def quoted(c: str) -> str:
        return "`" + c.replace("`", "``") + "`"

    def bits(c: str, size: str, guess: str, power: str) -> str:
        return f"""
            bigint(sign({c})) * CASE
              WHEN abs({c}) = double('inf') THEN {2047 << 52}L
              WHEN abs({c}) < {2.0**-1022!r}D THEN bigint(abs({c}) / {2.0**-1074!r}D)
              WHEN {power} > {size} THEN shiftleft(bigint({guess} + 1022), 52) + bigint(({size} / {power} * 2 - 1) * {2.0**52!r}D)
              WHEN {power} * 2 <= {size} THEN shiftleft(bigint({guess} + 1024), 52) + bigint(({size} / {power} / 2 - 1) * {2.0**52!r}D)
              ELSE shiftleft(bigint({guess} + 1023), 52) + bigint(({size} / {power} - 1) * {2.0**52!r}D) END"""

    rest = [quoted(c) for c in df.columns if c not in columns]
    own = [quoted(c) for c in columns]
    df = df.selectExpr(*rest, *own, *(f"least(greatest(abs({c}), {2.0**-1022!r}D), {sys.float_info.max!r}D) AS __s{i}" for i, c in enumerate(own)))
    df = df.selectExpr("*", *(f"least(int(floor(log2(__s{i}))), 1023) AS __g{i}" for i in range(len(own))))
    df = df.selectExpr("*", *(f"pow(2D, __g{i}) AS __p{i}" for i in range(len(own))))
    return df.selectExpr(*rest, *(f"{bits(c, f'__s{i}', f'__g{i}', f'__p{i}')} AS {c}" for i, c in enumerate(own)))


def from_order_bits(bits: str) -> Column:
    """The doubles of :func:`with_order_bits`."""
    mantissa = f"double(abs({bits}) & {(1 << 52) - 1}L)"
    exponent = f"shiftright(abs({bits}), 52)"
    return F.expr(f"""CASE WHEN {bits} < 0 THEN -1D ELSE 1D END * CASE
        WHEN {exponent} = 2047 THEN double('inf')
        WHEN {exponent} = 0 THEN {mantissa} * {2.0**-1074!r}D
        ELSE (1 + {mantissa} / {2.0**52!r}D) * pow(2D, {exponent} - 1023) END""")


def quantiles_long(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                   write: bool = True) -> DataFrame:
    """Exact quantiles, one row per (by..., variable, prob) with ``value`` and ``n``.

    Linear interpolation between the order statistics at ``floor(p*(n-1))`` and the
    next one (numpy's default rule).  NULL and NaN are skipped; infinities count; a
    column (or group) with no values gives no row.

    The passes read ``df`` three times.  By default the wanted columns are computed once and
    written to the shared checkpoint folder; pass ``write=False`` for a plain scan, which is read
    again more cheaply.
    """
    by = as_list(by)
    probs = [float(p) for p in probs]
    if any(p < 0 or p > 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    keys = [*by, "variable"]
    wide = with_order_bits(_wide_numeric(df, columns, by), as_list(columns))
    values = _unpivot(cut_lineage(wide) if write else wide, as_list(columns), by, "__bits")

    picked = None  # keys, __at (a prefix), n, __wanted (the ranks it holds, counted from its first value)
    for k, shift in enumerate(SHIFTS):
        group = [*keys, "__of", "n", "__wanted"] if k else keys
        step = values
        if k:  # every value with a wanted prefix takes the prefix' ranks along; they are part of the counters' key
            of = picked.withColumnRenamed("__at", "__of")
            same = _same(keys, "v", "p") & (F.shiftright("__bits", SHIFTS[k - 1]) == F.col("p.__of"))
            step = values.alias("v").join((of if by else bounded(of)).alias("p"), same).select("v.*", "p.__of", "p.n", "p.__wanted")
        counts = step.groupBy(*group, F.shiftright("__bits", shift).alias("__at")).agg(F.count(F.lit(1)).alias("c"))
        own = Window.partitionBy(*group[:len(keys) + 1])
        counts = counts.withColumn("__end", F.sum("c").over(own.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if not k:
            counts = counts.withColumn("n", F.sum("c").over(own))
            ranks = [(f"bigint(floor({p!r}D * (n - 1)))", i) for i, p in enumerate(probs)]
            counts = counts.withColumn("__wanted", F.expr("array(" + ", ".join(
                f"struct({2 * i} AS id, {r} AS r), struct({2 * i + 1} AS id, least({r} + 1, n - 1) AS r)" for r, i in ranks) + ")"))
        mine = F.expr("transform(filter(__wanted, w -> w.r >= __end - c AND w.r < __end), w -> struct(w.id AS id, w.r - (__end - c) AS r))")
        picked = counts.select(*keys, "__at", "n", mine.alias("__wanted")).where("size(__wanted) > 0")

    found = picked.select(*keys, "n", from_order_bits("__at").alias("x"), F.inline("__wanted"))
    pid = F.shiftright("id", 1)
    ends = found.groupBy(*keys, pid.alias("pid"), "n").agg(F.max(F.when(F.col("id") % 2 == 0, F.col("x"))).alias("lo"),
                                                           F.max(F.when(F.col("id") % 2 == 1, F.col("x"))).alias("hi"))
    prob = F.array(*[F.lit(p) for p in probs])[F.col("pid")]
    frac = prob * (F.col("n") - 1) - F.floor(prob * (F.col("n") - 1))
    value = F.when((F.col("lo") == F.col("hi")) | (frac == 0), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * frac)
    return ends.select(*keys, prob.alias("prob"), value.alias("value"), "n")


def cut_points(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
               names: Sequence[str] | None = None) -> DataFrame:
    """A17 wide: one row (per group) with a column ``{column}_{name}`` per probability."""
    by = as_list(by)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"p{round(p * 100, 6):g}" for p in probs]
    long = quantiles_long(df, columns, probs, by)
    aggs = []
    for c in as_list(columns):
        for p, nm in zip(probs, names):
            aggs.append(F.max(F.when((F.col("variable") == c) & (F.col("prob") == p), F.col("value")))
                        .alias(f"{c}_{nm}"))
    return long.groupBy(*by).agg(*aggs) if by else long.agg(*aggs)


def median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact median per column, NULLs skipped; columns keep their names."""
    cols = as_list(columns)
    wide = cut_points(df, cols, [0.5], by, names=["median"])
    return wide.select(*as_list(by), *[F.col(f"{c}_median").alias(c) for c in cols])


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULLs with the column's exact median (one-row statistic, broadcast).  An
    integral column becomes double, since its median need not be whole."""
    cols = as_list(columns)
    med = cut_points(df, cols, [0.5], names=["__median"])
    out = df.crossJoin(bounded(med))
    kind = {c: T.DoubleType() if isinstance(df.schema[c].dataType, T.IntegralType) else df.schema[c].dataType for c in cols}
    out = out.withColumns({c: F.coalesce(col(c).cast(kind[c]), F.col(f"{c}___median").cast(kind[c])) for c in cols})
    return out.drop(*[f"{c}___median" for c in cols])




def quantile_bin(df: DataFrame, columns: Sequence[str], q: int = 4, labels: Sequence[str] | None = None,
                 suffix: str = "_quartile", index: bool = False) -> DataFrame:
    """Bin each value by the column's own quantiles (pandas ``qcut``): edges are the exact
    interpolated quantiles at 0, 1/q, .., 1; bins are closed on the right, the lowest
    edge included.  NULL gives NULL.  Equal edges raise when the job runs.
    With ``index=True`` the bin number 1..q is returned instead of the label."""
    cols = as_list(columns)
    labels = list(labels) if labels is not None else (QUARTILE_LABELS if q == 4 else [f"Q{i + 1}" for i in range(q)])
    if len(labels) != q:
        raise ValueError("need one label per bin")
    probs = [i / q for i in range(q + 1)]
    names = [f"e{i}" for i in range(q + 1)]
    edges = cut_points(df, cols, probs, names=[f"_{n}" for n in names])
    out = df.crossJoin(bounded(edges))
    new = {}
    for c in cols:
        e = [F.col(f"{c}__{n}") for n in names]
        v = col(c).cast("double")
        dup = None
        for i in range(q):
            d = e[i] == e[i + 1]
            dup = d if dup is None else dup | d
        pick = None
        for i in range(q):
            hit = (v <= e[i + 1]) if i > 0 else (v >= e[0]) & (v <= e[1])
            if i > 0:
                hit = hit & (v > e[i])
            val = F.lit(i + 1) if index else F.lit(labels[i])
            pick = F.when(hit, val) if pick is None else pick.when(hit, val)
        err = F.raise_error(F.lit(f"quantile_bin: bin edges must be unique for {c}"))
        # no values at all: every edge is NULL, which qcut also rejects as non-unique edges
        empty = F.raise_error(F.lit(f"quantile_bin: bin edges must be unique for {c} (no values)"))
        new[f"{c}{suffix}"] = (F.when(e[0].isNull(), empty).when(v.isNull(), F.lit(None))
                               .when(dup, err).otherwise(pick))
    out = out.withColumns(new)
    return out.drop(*[f"{c}__{n}" for c in cols for n in names])


def box_stats(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), whisker: float = 1.5) -> DataFrame:
    """Per (group, metric): n, mean, min, q1, median, q3, max, the whisker ends (most
    extreme values within ``whisker`` x IQR of the box) and the number of outlying points."""
    by = as_list(by)
    keys = [*by, "variable"]
    wide = cut_lineage(_wide_numeric(df, metrics, by))  # read by the passes and once more below
    qs = quantiles_long(wide, metrics, [0.25, 0.5, 0.75], by)
    quart = qs.groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    quart = quart.withColumn("lo_fence", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))) \
                 .withColumn("hi_fence", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    long = _unpivot(wide, as_list(metrics), by, "v")
    v = F.col("v")
    # metrics rows (one-row statistics per metric) are broadcast; per-group statistics are
    # left to the planner, which broadcasts them only when measured small.
    side = bounded(quart) if not by else quart
    joined = long.alias("l").join(side.alias("q"), _same(keys, "l", "q"))
    # the quartiles are the group's own, so they go along as part of its key
    stats = joined.groupBy(*[F.col(f"l.`{k}`").alias(k) for k in keys], "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.min(F.when(v >= F.col("lo_fence"), v)).alias("lower_whisker"),
        F.max(F.when(v <= F.col("hi_fence"), v)).alias("upper_whisker"),
        F.count(F.when((v < F.col("lo_fence")) | (v > F.col("hi_fence")), F.lit(1))).alias("n_outliers"))
    figures = ["n", "mean", "min", "max", "lower_whisker", "upper_whisker", "n_outliers", "q1", "median", "q3"]
    return stats.select(*[F.col(f"`{k}`") for k in keys], *figures).withColumnRenamed("variable", "metric")


def box_outliers(df: DataFrame, key: str, metrics: Sequence[str], by: Sequence[str] = (),
                 whisker: float = 1.5) -> DataFrame:
    """A19 points: the rows lying outside the whiskers, per metric (key, metric, value)."""
    by = as_list(by)
    keys = [*by, "variable"]
    stats = box_stats(df, metrics, by, whisker).withColumnRenamed("metric", "variable")
    lim = stats.select(*keys, (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("lo"),
                       (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("hi"))
    cols = as_list(metrics)
    wide = df.select(col(key).alias(key), *[col(b).alias(b) for b in by],
                     *[col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot([F.col(key), *[F.col(b) for b in by]], [F.col(c) for c in cols], "variable", "value")
    return (long.alias("l").join((bounded(lim) if not by else lim).alias("b"), _same(keys, "l", "b"))
            .where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
            .select(F.col(f"l.`{key}`"), *[F.col(f"l.`{k}`") for k in by], F.col("l.variable").alias("metric"), "value"))
