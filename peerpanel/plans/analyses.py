"""Composite analyses (C1-C19): what a user of the panel calls.

Each is a composition of the operators: DataFrame in, DataFrame out.  Targets,
outliers, member lists, column lists and k are arguments.  The only values that
reach the driver are plan-time facts (category lists, cut points, model
centres), never rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._names import as_list, col, value
from ..constants import ABSENT, UNKNOWN
from ..functions.scalar import fill_unknown, last_of, match_flag, match_int, money_text, percent_text, target_value
from ..operators.aggregates import (change_counts, cluster_profile, club, count_by, mean_of, modal_value,
                                    value_shares)
from ..operators.cluster import kmeans, pca_project
from ..operators.columns import order_columns, override_key, recode_binary, rescale, row_total
from ..operators.features import features_mixed, features_numeric
from ..operators.filters import require_key
from ..operators.joins import attach_dimension, bounded, flag_members, left_join_on, panel_join
from ..operators.ordering import category_rank, stack_cohorts
from ..operators.quantiles import QUARTILE_LABELS, box_stats, quantile_bin
from ..operators.reshape import melt, pivot_counts, pivot_strict, wide_years_to_long
from ..operators.windows import rank_within, share_within, standardize
from ..session import cut_lineage
from ..sources.files import cast_lenient


# C1 / C2 -------------------------------------------------------------------

def build_panel(funding: DataFrame, overrides: DataFrame, registry: DataFrame, classes: DataFrame,
                members: DataFrame, *, id_raw: str = "entity_id_raw", key: str = "entity_id",
                name: str = "entity_name", year: str = "year", source: str = "source", amount: str = "amount",
                sources: Sequence[str] | None = None, registry_key: str = "entity_id",
                registry_name: str = "entity_name", class_key: str = "unitid",
                class_drop: Sequence[str] = ("name", "city", "state"), member_col: str = "member",
                sort: bool = True, materialize: bool = True) -> DataFrame:
    """The entity x year panel.

    lenient key cast (S2) -> key overrides (P6, J1) -> keyless rows dropped (F1)
    -> strict pivot of sources (R1) -> club rows sharing a key (A1, materialised) -> member flag
    (J5) -> registry wide to long (R3) -> classification (J2) -> panel join on
    (key, year) (J3) -> sorted by key, newest year first (O1).
    """
    f = cast_lenient(funding, id_raw, "bigint", out=key)
    if id_raw != key:
        f = f.drop(id_raw)
    f = override_key(f, overrides, on=name, key=key)
    f = require_key(f, key)
    wide = pivot_strict(f, [year, name, key], source, amount, categories=sources)
    clubbed = club(wide, [key, year], carry=[name])
    if materialize:
        # entity x year rows, far fewer than the funding rows: written once, so the member
        # lookup and the panel join read it instead of recomputing the pivot.
        clubbed = cut_lineage(clubbed)
    flagged = flag_members(clubbed, members, name, key, out=member_col)
    long = wide_years_to_long(registry, [registry_key, registry_name], year_col=year)
    inst = left_join_on(long, classes.drop(*[c for c in class_drop if c in classes.columns]),
                        registry_key, class_key)
    panel = panel_join(inst, flagged, [registry_key, year], [key, year], suffix="_funding")
    if sort:
        panel = panel.orderBy(col(registry_key).asc(), col(year).desc())
    return panel


def attribute_stability(registry_long: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                        skip: Sequence[str] = ("year",)) -> DataFrame:
    """Distinct non-NULL values of each attribute per entity, keys first, then the
    attributes in their declared order."""
    keys = as_list(keys)
    counts = change_counts(registry_long, keys, columns, skip)
    return order_columns(counts, keys)


# The target against its peers ------------------------

def target_vs_box(profile: DataFrame, key: str, target, metrics: Sequence[str]) -> DataFrame:
    """Per metric, the peers' box statistics (target excluded) beside the target's value
    (NULL when the target is absent) and the short label (X2)."""
    peers = profile.where(col(key) != value(target))
    box = box_stats(peers, metrics)
    tv = target_long(profile, key, target, metrics)
    return (box.join(tv, on="metric", how="left")
            .withColumn("label", last_of(F.col("metric"))))


def target_long(profile: DataFrame, key: str, target, metrics: Sequence[str], name: str = "target_value") -> DataFrame:
    """The target's value of each metric as (metric, value) rows; one row per metric even
    when the target is absent (value NULL).  A one-row aggregate, melted."""
    one = target_value(profile, key, target, metrics, prefix="")
    one = one.select(*[col(m).cast("double").alias(m) for m in metrics])
    return melt(one, [], list(metrics), "metric", name)


def quartile_distribution(profile: DataFrame, metrics: Sequence[str], key: str, target,
                          labels: Sequence[str] = QUARTILE_LABELS, default: str = UNKNOWN) -> DataFrame:
    """C4: per metric, how many entities fall in each quartile (W2 over the whole profile,
    target included as in the reference), in label order, with the target's own quartile
    (``default`` when the target is absent)."""
    binned = quantile_bin(profile, metrics)
    qcols = [f"{m}_quartile" for m in metrics]
    long = melt(binned.select(col(key), *[col(q) for q in qcols]), [key], qcols, "metric", "quartile")
    long = long.withColumn("metric", F.regexp_replace("metric", "_quartile$", ""))
    counts = long.where(F.col("quartile").isNotNull()).groupBy("metric", "quartile").agg(
        F.count(F.lit(1)).alias("count"))
    tq = melt(target_value(binned, key, target, qcols, default, prefix=""), [], qcols, "metric", "target_quartile")
    tq = tq.withColumn("metric", F.regexp_replace("metric", "_quartile$", ""))
    return (counts.join(tq, on="metric")
            .withColumn("quartile_rank", category_rank("quartile", list(labels)))
            .orderBy("metric", "quartile_rank"))


def target_vs_means(profile: DataFrame, key: str, target, outlier, metrics: Sequence[str]) -> DataFrame:
    """Per metric, the target's mean, the peers' mean (target excluded) and the peers'
    mean without the outlier.  One aggregate with conditional means."""
    is_t = col(key) == value(target)
    is_o = col(key) == value(outlier)
    aggs = []
    for m in metrics:
        x = col(m).cast("double")
        aggs += [F.avg(F.when(is_t, x)).alias(f"t__{m}"),
                 F.avg(F.when(~is_t, x)).alias(f"w__{m}"),
                 F.avg(F.when(~is_t & ~is_o, x)).alias(f"wo__{m}")]
    one = profile.agg(*aggs)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"t__{m}").alias("target"),
                     F.col(f"w__{m}").alias("mean_with_outlier"),
                     F.col(f"wo__{m}").alias("mean_without_outlier")) for m in metrics]
    return one.select(F.inline(F.array(*rows)))


def compare_categorical(profile: DataFrame, key: str, target, columns: Sequence[str],
                        default: str = ABSENT) -> DataFrame:
    """Per attribute, the target's value (``default`` if absent) and the peers'
    distribution (target excluded, NULLs excluded) as share and percent text."""
    peers = profile.where(col(key) != value(target))
    shares = value_shares(peers, columns)
    tv = target_text(profile, key, target, columns, default)
    return (shares.join(tv, on="variable", how="left")
            .withColumn("percent", percent_text(F.col("share"))))


def target_text(profile: DataFrame, key: str, target, columns: Sequence[str], default: str = ABSENT) -> DataFrame:
    one = target_value(profile, key, target, columns, default, prefix="")
    return melt(one, [], list(columns), "variable", "target_value")


def modal_match(profile: DataFrame, key: str, target, columns: Sequence[str], fill: str = UNKNOWN) -> DataFrame:
    """Per attribute, the target's value, the peers' mode (NULLs counted as ``fill``,
    since the reference fills them first) and its share, and whether they match."""
    # compared as text (the mode table is text): cast first, then fill
    filled = fill_unknown(profile.withColumns({c: col(c).cast("string") for c in columns}), list(columns), fill)
    peers = filled.where(col(key) != value(target))
    modes = modal_value(peers, columns)
    tv = _target_plain(filled, key, target, columns)
    return (modes.join(tv, on="variable", how="left")
            .withColumn("match", match_flag(F.col("target_value"), F.col("mode")))
            .withColumn("match_code", match_int(F.col("target_value"), F.col("mode")))
            .withColumn("mode_percent", percent_text(F.col("mode_share"))))


def _target_plain(df: DataFrame, key: str, target, columns: Sequence[str]) -> DataFrame:
    one = target_value(df, key, target, columns, prefix="")
    one = one.select(*[col(c).cast("string").alias(c) for c in columns])
    return melt(one, [], list(columns), "variable", "target_value")


# C5 ------------------------------------------------------------------------

def rollup_by_state(profile: DataFrame, dim: DataFrame, group: str, dim_key: str, metrics: Sequence[str],
                    key: str, outlier) -> DataFrame:
    """Mean and total per group, with and without the outlier (the four variants in one
    result), joined to the dimension so groups absent from it vanish (J4).  NULL groups
    are dropped.  ``exclude`` really excludes (the reference's version did not).

    One aggregate computes all four variants with conditional sums and means; the
    variants are then unstacked into rows, so the profile is read once.
    """
    base = profile.where(col(group).isNotNull())
    keep = (col(key) != value(outlier)) | col(key).isNull() | value(outlier).isNull()
    aggs = [F.count(F.lit(1)).alias("__n_with"), F.count(F.when(keep, F.lit(1))).alias("__n_without")]
    for m in metrics:
        x = col(m).cast("double")
        aggs += [F.avg(x).alias(f"__mean_with__{m}"), F.sum(x).alias(f"__total_with__{m}"),
                 F.avg(F.when(keep, x)).alias(f"__mean_without__{m}"),
                 F.sum(F.when(keep, x)).alias(f"__total_without__{m}")]
    wide = base.groupBy(col(group).alias(group)).agg(*aggs)
    variants = []
    for inc in ("with", "without"):
        for method, tag in (("mean", "mean"), ("total", "total")):
            variants.append(F.struct(F.lit(inc).alias("outlier"), F.lit(method).alias("method"),
                                     (F.col(f"__n_{inc}") > 0).alias("__present"),
                                     *[F.col(f"__{tag}_{inc}__{m}").alias(m) for m in metrics]))
    out = wide.select(col(group), F.inline(F.array(*variants))).where("__present").drop("__present")
    return attach_dimension(out, dim, group, dim_key)


# Name of the pivoted column of the NULL category.
NULL_NAME = "\x00null"


# Cohorts ---------------------------------------------------------

def designations(profile: DataFrame, member_col: str, member_label: str, designation_col: str,
                 keep: Sequence[str]) -> DataFrame:
    """U1 input: the member cohort and every entity under its own designation, stacked
    (a member is counted in both), with a ``designation`` column (P9)."""
    cols = [col(c) for c in keep]
    members = profile.where(F.coalesce(col(member_col), F.lit(False))).select(
        F.lit(member_label).alias("designation"), *cols)
    everyone = profile.select(col(designation_col).alias("designation"), *cols)
    return stack_cohorts(everyone, members)


def cohort_shares(stacked: DataFrame, column: str, fill_zero: bool = False, order: Sequence | None = None,
                  codes: Mapping | None = None, categories: Sequence | None = None) -> DataFrame:
    """Count per (designation, value) with the NULL value kept as a group (A6), share
    within the designation (W1); with ``fill_zero`` every (designation, value) pair is
    present, zero counts included (R2 then R5); ``order`` adds the declared rank of the
    value (O3); ``codes`` maps codes to labels after the shares (X6)."""
    if fill_zero:
        with_null = not stacked.where(col(column).isNull()).isEmpty()  # a NULL category is a category
        wide = pivot_counts(stacked, ["designation"], column, categories=categories, null_name=NULL_NAME if with_null else None)
        value_cols = [c for c in wide.columns if c != "designation"]
        counts = melt(wide, ["designation"], value_cols, column, "count")
        counts = counts.withColumn(column, F.when(col(column) != NULL_NAME, col(column)))
    else:
        counts = count_by(stacked, ["designation", column], name="count")
    out = share_within(counts, "designation", "count", out="share")
    if order is not None:
        # declared order (O3): the rank as a column; a value outside the list becomes NULL
        out = out.withColumn("category_rank", category_rank(column, list(order)))
        out = out.withColumn(column, F.when(F.col("category_rank").isNull(), F.lit(None)).otherwise(col(column)))
    if codes is not None:
        from ..functions.scalar import code_labels
        out = out.withColumn(column, code_labels(col(column), codes))
    return out


def cohort_funding(stacked: DataFrame, metrics: Sequence[str], factor: float = 1000.0) -> DataFrame:
    """Mean of each metric per cohort (overlapping cohorts, one aggregate), rescaled."""
    means = stacked.groupBy("designation").agg(*[mean_of(m).alias(m) for m in metrics])
    return rescale(means, metrics, factor)


# Clusters ---------------------------------------------------------

def cluster_members(clustered: DataFrame, key: str, name: str, total: str, factor: float = 1000.0,
                    cluster: str = "cluster") -> DataFrame:
    """C11: one row per entity (deduplicated on the key), sorted by cluster and name, the
    total divided by ``factor``."""
    one = clustered.groupBy(col(key)).agg(F.min_by(F.struct(col(cluster).alias(cluster), col(name).alias(name),
                                                            col(total).alias(total)), col(name)).alias("r"))
    out = one.select(F.col("r")[cluster].alias(cluster), col(key), F.col("r")[name].alias(name),
                     (F.col("r")[total] / F.lit(factor)).alias(total))
    return out.orderBy(cluster, name, key)


def cluster_summary(clustered: DataFrame, key: str, name: str, metric: str, quartile: str,
                    cluster: str = "cluster", shown: str | None = None) -> DataFrame:
    """Cluster, entity, money text of the metric (or of ``shown``), its quartile; sorted by
    cluster and the metric descending, with the rank within the cluster (W4)."""
    ranked = rank_within(clustered, cluster, [col(metric).desc_nulls_last(), col(key).asc()], out="rank_in_cluster")
    return (ranked.select(col(cluster), col(key), col(name),
                          money_text(col(shown or metric)).alias("total_funding"),
                          col(quartile).alias("funding_quartile"), "rank_in_cluster")
            .orderBy(cluster, "rank_in_cluster"))


def cluster_radar(clustered: DataFrame, metrics: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean profile per cluster (A14), then standardised across the clusters (W3 over a
    k-row table)."""
    prof = cluster_profile(clustered, metrics, cluster)
    return standardize(prof, metrics)


def cluster_sizes(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    return clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("size")).orderBy(cluster)


def target_cluster(clustered: DataFrame, key: str, target, name: str, by: str = "pc1", n: int = 5,
                   cluster: str = "cluster") -> DataFrame:
    """C14: the target's cluster with its size and its first ``n`` members by ``by``
    (ascending, key breaks ties).  Empty when the target is absent."""
    tc = clustered.where(col(key) == value(target)).select(col(cluster).alias("__tc")).distinct()
    inside = clustered.join(bounded(tc), col(cluster) == F.col("__tc"), "left_semi")
    size = inside.groupBy(col(cluster)).agg(F.count(F.lit(1)).alias("cluster_size"))
    top = rank_within(inside, cluster, [col(by).asc(), col(key).asc()], out="position", top=n)
    return top.join(size, on=cluster).select(cluster, "cluster_size", "position", key, name, by)


def nested_counts(profile: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Two-level counts for each column pair, rows with a NULL in the pair dropped (A7),
    stacked as text.  The profile is read once: rows are counted per distinct combination of all
    the columns, and these counts are added up for each pair."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    combos = profile.groupBy(*[col(c).cast("string").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("count"))
    levels = F.array(*[F.struct(F.lit(a).alias("level1"), col(a).alias("value1"), F.lit(b).alias("level2"), col(b).alias("value2"))
                       for a, b in pairs])
    long = combos.select(F.inline(levels), "count").where("value1 IS NOT NULL AND value2 IS NOT NULL")
    return long.groupBy("level1", "value1", "level2", "value2").agg(F.sum("count").alias("count"))


def cluster_card(clustered: DataFrame, key: str, target, attrs: Sequence[str], metrics: Sequence[str],
                 cluster: str = "cluster") -> DataFrame:
    """For the target's cluster, the modal value of each attribute and the mean of each
    metric (one row)."""
    tc = clustered.where(col(key) == value(target)).select(col(cluster).alias("__tc")).distinct()
    inside = clustered.join(bounded(tc), col(cluster) == F.col("__tc"), "left_semi")
    modes = modal_value(inside, attrs, [cluster]).groupBy(cluster).pivot("variable", list(attrs)).agg(
        F.first("mode"))
    means = inside.groupBy(cluster).agg(*[mean_of(m).alias(m) for m in metrics])
    return modes.join(means, on=cluster)


def cluster_box(clustered: DataFrame, metric: str, key: str, target, cluster: str = "cluster") -> DataFrame:
    """C17: box statistics of one metric per cluster, with the target's cluster and value."""
    box = box_stats(clustered, [metric], by=[cluster])
    t = clustered.where(col(key) == value(target)).agg(F.max(col(cluster)).alias("target_cluster"),
                                                       F.max(col(metric).cast("double")).alias("target_value"))
    return box.crossJoin(bounded(t))


def cluster_scatter(clustered: DataFrame, key: str, name: str, total: str, cluster: str = "cluster",
                    pcs: Sequence[str] = ("pc1", "pc2")) -> DataFrame:
    """Entity, both components, cluster and total: the table behind the scatter."""
    return clustered.select(col(key), col(name), *[col(p) for p in pcs], col(cluster), col(total))


def vectors_once(feats: DataFrame, key: str) -> DataFrame:
    """The key and the vector of each row, written once: the fit, the projection and the result read them again
    and again, and would each time compute medians, means and deviations anew."""
    return cut_lineage(feats.select(col(key), "features"))


def cluster_profile_table(profile: DataFrame, key: str, metrics: Sequence[str], k: int, seed: int = 42,
                          restarts: int = 10, project: bool = True) -> DataFrame:
    """M1 + M3 (+ M5) on a profile: standardised metrics, k-means labels and, when
    ``project``, the two components."""
    feats = vectors_once(features_numeric(profile, key, metrics, keep=[]), key)
    clustered = kmeans(feats, k, seed=seed, restarts=restarts)
    if project:
        side = pca_project(clustered, 2).select(col(key), "cluster", "pc1", "pc2")
    else:
        side = clustered.select(col(key), "cluster")
    return profile.join(side, on=key)


def cohort_features(profile: DataFrame, designation_col: str, label: str, key: str, metrics: Sequence[str],
                    totals: Mapping[str, Sequence[str]], categorical: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """C19 up to the fit: the rows of one designation with their totals (P7), and their mixed features (M2)."""
    cohort = profile.where(col(designation_col) == F.lit(label))
    for tname, cols in totals.items():
        cohort = row_total(cohort, tname, cols)
    return cohort, features_mixed(cohort, key, list(metrics) + list(totals), categorical)


def analyse_cohort(profile: DataFrame, designation_col: str, label: str, key: str, name: str,
                   metrics: Sequence[str], totals: Mapping[str, Sequence[str]], categorical: Sequence[str],
                   k: int = 3, seed: int = 42, restarts: int = 1) -> DataFrame:
    """One designation cohort: totals (P7), mixed features (M2), k-means (M3) and the
    projection (M5), returned as the scatter table (C18)."""
    cohort, feats = cohort_features(profile, designation_col, label, key, metrics, totals, categorical)
    clustered = kmeans(vectors_once(feats, key), k, seed=seed, restarts=restarts)
    projected = pca_project(clustered, 2).select(col(key), "cluster", "pc1", "pc2")
    first_total = list(totals)[0]
    return cluster_scatter(cohort.join(projected, on=key), key, name, first_total)


def recode_designation(profile: DataFrame, column: str, match, yes: str = "R1", no: str = "R2",
                       out: str = "designation") -> DataFrame:
    """P5 applied to the designation attribute (a NULL designation becomes ``no``)."""
    return recode_binary(profile, column, match, yes, no, out=out)
