"""peerpanel: panel analytics over entity x year data on Spark.

Operators are plain functions: DataFrame in, DataFrame out.  Sub-packages:

* :mod:`peerpanel.sources` - scans and sinks (S1-S5)
* :mod:`peerpanel.operators` - column, filter, join, aggregate, quantile, reshape,
  window, ordering, feature and clustering operators
* :mod:`peerpanel.functions` - scalar column functions (X1-X10)
* :mod:`peerpanel.plans` - composite analyses (C1-C19) and the registered queries
"""

from .functions.scalar import (code_labels, fill_unknown, last_of, match_flag, match_int, money_text,
                               percent_text, suffix_year, target_value, zero_pad)
from .operators.aggregates import (change_counts, club, cluster_profile, cohort_means, count_by, dedupe,
                                   distinct_values, entity_profile, latest, mean_of, modal_by_group, modal_value,
                                   rollup_by, row_count, value_counts, value_shares)
from .operators.cluster import (assign_nearest, elbow, fit_kmeans, inertia_k1, kmeans, pca_explained,
                                pca_project)
from .operators.columns import (add_literal, label_cohort, order_columns, override_key, recode_binary,
                                rename_columns, rescale, row_total, short_labels, strip_suffix)
from .operators.features import assemble, features_mixed, features_numeric
from .operators.filters import (cohort_with_target, drop_incomplete, exclude, in_table, in_values, lookup,
                                require_key, split_target)
from .operators.joins import (attach, attach_dimension, bounded, flag_members, keep_members, left_join_on,
                              left_join_suffix, panel_join)
from .operators.ordering import order_by_category, preview, sort_by, stack_cohorts, top_k
from .operators.quantiles import (box_outliers, box_stats, cut_points, median, median_impute, quantile_bin,
                                  quantiles_long)
from .operators.reshape import concat_diagonal, melt, one_hot, pivot_counts, pivot_strict, wide_years_to_long
from .operators.windows import rank_within, share_within, standardize
from .plans import analyses
from .sources.files import cast_lenient, read_headerless, read_panel, read_table, write_panel

__all__ = [n for n in dir() if not n.startswith("_")]
