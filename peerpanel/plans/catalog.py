"""Registered queries: each operator of the inventory run on the driver's tables.

``QUERIES[name](spark, sf_dir)`` builds the Spark plan with the library;
``ORACLE[name]`` is an independent SQL statement over the same tables
(DuckDB dialect) returning the same columns.  Queries with no SQL form (model
fits) have no oracle entry and are checked by invariants in the tests.

Every query reads whole tables.  Targets and outliers are found from the data
(one scalar each, a plan-time fact) and the SQL finds them the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._names import col
from ..session import cut_lineage, scratch_path
from ..functions.scalar import (code_labels, fill_unknown, last_of, money_text, percent_text, target_value,
                                zero_pad)
from ..operators.aggregates import (club, cohort_means, count_by, dedupe, distinct_values, latest, modal_by_group,
                                    rollup_by, row_count, value_counts, value_shares)
from ..operators.categories import category_dictionary, one_hot_places
from ..operators.cluster import Fit, assign_nearest, elbow, inertia_k1, kmeans, lloyd, pca_explained, pca_project
from ..operators.columns import (add_literal, label_cohort, order_columns, override_key, recode_binary, rescale, row_total,
                                 short_labels, strip_suffix)
from ..operators.features import feature_columns, features_mixed, features_numeric
from ..operators.filters import cohort_with_target, exclude, in_table, in_values, lookup, require_key, split_target
from ..operators.joins import attach, flag_members, keep_members, left_join_suffix, panel_join
from ..operators.late import latest_rows, pick_rows
from ..operators.modes import modes_by_candidates
from ..operators.ordering import order_by_category, preview, sort_by, top_k
from ..operators.quantiles import (box_outliers, box_stats, cut_points, median, median_impute, quantile_bin,
                                   quantiles_long)
from ..operators.reshape import concat_diagonal, one_hot, pivot_strict, wide_years_to_long, year_blocks
from ..operators.windows import rank_within, standardize
from ..sources.files import cast_lenient, read_headerless, read_panel
from . import analyses as C
from . import fixtures as fx
from .upkeep import refresh_panel

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r4(c, n: int = 4):
    return F.round(col(c) if isinstance(c, str) else c, n)


# Shared oracle fragments ------------------------------------------------------

O_PROFILE_SQL = """
op AS (
  SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS year,
    coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS urgent,
    coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '2-HIGH'), 0) AS high,
    coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '3-MEDIUM'), 0) AS medium,
    coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED'), 0)
      AS not_specified,
    coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '5-LOW'), 0) AS low,
    arg_max_null(o_orderstatus, o_orderkey) AS status
  FROM orders GROUP BY o_custkey, CAST(year(o_orderdate) AS INTEGER)),
cust AS (
  SELECT c_custkey AS entity_id, c_name AS entity_name, c_mktsegment AS segment, n_name AS nation,
         r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
panel0 AS (SELECT op.*, cust.entity_name, cust.segment, cust.nation, cust.region
           FROM op JOIN cust ON op.entity_id = cust.entity_id),
panel AS (
  SELECT *, entity_id IN (SELECT entity_id FROM panel0
                          WHERE entity_name IN (SELECT entity_name FROM cust WHERE region = 'AMERICA')) AS member
  FROM panel0),
prof AS (
  SELECT entity_id, max(year) AS year,
    arg_max_null(entity_name, year) AS entity_name, arg_max_null(segment, year) AS segment,
    arg_max_null(nation, year) AS nation, arg_max_null(region, year) AS region,
    arg_max_null(status, year) AS status, arg_max_null(member, year) AS member,
    CAST(sum(urgent) AS DOUBLE) / count(urgent) AS urgent,
    CAST(sum(high) AS DOUBLE) / count(high) AS high,
    CAST(sum(medium) AS DOUBLE) / count(medium) AS medium,
    CAST(sum(not_specified) AS DOUBLE) / count(not_specified) AS not_specified,
    CAST(sum(low) AS DOUBLE) / count(low) AS low
  FROM panel GROUP BY entity_id),
profile AS (
  SELECT *,
    CAST(0 AS DOUBLE) + coalesce(urgent, 0) + coalesce(high, 0) + coalesce(medium, 0) + coalesce(low, 0)
      AS total_with,
    CAST(0 AS DOUBLE) + coalesce(urgent, 0) + coalesce(high, 0) + coalesce(medium, 0) AS total_without
  FROM prof),
target AS (SELECT min(entity_id) AS id FROM profile WHERE NOT member),
outlier AS (SELECT entity_id AS id FROM profile ORDER BY total_with DESC, entity_id LIMIT 1),
peers AS (SELECT * FROM profile WHERE member OR entity_id = (SELECT id FROM target))
"""


def with_o(body: str) -> str:
    return "WITH " + O_PROFILE_SQL.strip() + "\n" + body.strip()


L_FUNDING_SQL = """
cells AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, p_type,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
funding AS (
  SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL
              WHEN s_suppkey % 11 = 5 THEN 'id-' || CAST(s_suppkey AS VARCHAR)
              ELSE CAST(s_suppkey AS VARCHAR) END AS entity_id_raw,
         s_name AS entity_name, year, p_type AS source, amount
  FROM cells JOIN supplier ON l_suppkey = s_suppkey),
overrides AS (SELECT s_name AS entity_name, s_suppkey AS entity_id FROM supplier WHERE s_suppkey % 14 = 0),
members AS (SELECT s_name AS entity_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
"""


def with_l(body: str) -> str:
    return "WITH " + L_FUNDING_SQL.strip() + ",\n" + body.strip()


def _types_filter(agg: str, value: str = "amount") -> str:
    return ",\n".join(f"    {agg}({value}) FILTER (WHERE source = '{t}') AS \"{t}\"" for t in fx.PART_TYPES)


# Plan-time facts ------------------------------------------------------------

def o_target(profile: DataFrame):
    """The target: the smallest key that is not a member, as a scalar subquery (it stays in
    the plan; no driver round trip)."""
    return profile.where(~F.col("member")).agg(F.min("entity_id")).scalar()


def o_outlier(profile: DataFrame):
    """The outlier: the largest ``total_with`` (smallest key on a tie), as a scalar subquery."""
    return (profile.orderBy(F.col("total_with").desc(), F.col("entity_id").asc()).limit(1)
            .select("entity_id").scalar())


def o_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer profile, materialised once (reliable checkpoint into the shared folder)
    for queries that pass over it several times: plan-time facts, scalar subqueries and
    the main plan then read one row per customer instead of re-aggregating the orders."""
    return cut_lineage(fx.profile_o(spark, sf_dir))


def o_peers(spark: SparkSession, sf_dir: str):
    prof = o_profile(spark, sf_dir)
    target = o_target(prof)
    return prof, cohort_with_target(prof, "member", "entity_id", target), target


def _double_metrics(df: DataFrame, metrics) -> DataFrame:
    return df.withColumns({m: col(m).cast("double") for m in metrics})


# 1. Flagship: entity profile with totals ([L]) -----------------------------------

L_TOTAL_WITH = ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]
L_TOTAL_WITHOUT = ["ECONOMY", "LARGE", "MEDIUM", "STANDARD"]


@query("profile_totals", with_l(f"""
yearly AS (
  SELECT l_suppkey AS entity_id, year,
{",".join(chr(10) + f"    coalesce(sum(amount) FILTER (WHERE p_type = '{t}'), 0) AS \"{t}\"" for t in fx.PART_TYPES)}
  FROM cells GROUP BY 1, 2),
prof AS (
  SELECT entity_id, max(year) AS year, arg_max_null(s_name, year) AS entity_name,
{",".join(chr(10) + f"    CAST(sum(\"{t}\") AS DOUBLE) / count(\"{t}\") AS \"{t}\"" for t in fx.PART_TYPES)}
  FROM yearly JOIN supplier ON s_suppkey = entity_id GROUP BY entity_id)
SELECT *,
  CAST(0 AS DOUBLE) {"".join(f' + coalesce("{t}", 0)' for t in L_TOTAL_WITH)} AS total_with,
  CAST(0 AS DOUBLE) {"".join(f' + coalesce("{t}", 0)' for t in L_TOTAL_WITHOUT)} AS total_without
FROM prof
"""))
def q_profile_totals(spark, sf_dir):
    """lineitem + part + supplier -> sum per (supplier, year, type) -> strict pivot (R1) ->
    club (A1: a type with no sales that year is 0) -> profile (A4) -> supplier name -> totals (P7)."""
    li = fx.lineitem_l(spark, sf_dir)
    cells = li.groupBy(F.col("l_suppkey").alias("entity_id"), "year", "p_type").agg(F.sum("amount").alias("amount"))
    wide = pivot_strict(cells, ["entity_id", "year"], "p_type", "amount", categories=fx.PART_TYPES)
    yearly = club(wide, ["entity_id", "year"])
    s = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"),
                                                   F.col("s_name").alias("entity_name"))
    from ..operators.aggregates import entity_profile
    # numeric-only profile (a hash aggregate), then the supplier name from the dimension
    prof = entity_profile(yearly, "entity_id", [], fx.PART_TYPES).join(s, "entity_id")
    prof = row_total(prof, "total_with", L_TOTAL_WITH)
    return row_total(prof, "total_without", L_TOTAL_WITHOUT)


# 2. Repair: lenient cast, overrides, pivot, club ----------------------------------

@query("lenient_cast", with_l("""
SELECT entity_id_raw, TRY_CAST(entity_id_raw AS BIGINT) AS entity_id, entity_name, year, source,
       CAST(amount AS DOUBLE) AS amount
FROM funding WHERE TRY_CAST(entity_id_raw AS BIGINT) IS NOT NULL
"""))
def q_lenient_cast(spark, sf_dir):
    f = cast_lenient(fx.funding_l(spark, sf_dir), "entity_id_raw", "bigint", out="entity_id")
    return require_key(f, "entity_id").withColumn("amount", F.col("amount").cast("double"))


@query("override_keys", with_l("""
fixed AS (
  SELECT coalesce(o.entity_id, TRY_CAST(f.entity_id_raw AS BIGINT)) AS entity_id, f.entity_name, f.year,
         f.source, CAST(f.amount AS DOUBLE) AS amount
  FROM funding f LEFT JOIN (SELECT * FROM overrides WHERE entity_name IS NOT NULL AND entity_id IS NOT NULL) o
    ON f.entity_name = o.entity_name)
SELECT * FROM fixed WHERE entity_id IS NOT NULL
"""))
def q_override_keys(spark, sf_dir):
    f = cast_lenient(fx.funding_l(spark, sf_dir), "entity_id_raw", "bigint", out="entity_id").drop("entity_id_raw")
    f = override_key(f, fx.overrides_l(spark, sf_dir), on="entity_name", key="entity_id")
    return require_key(f, "entity_id").withColumn("amount", F.col("amount").cast("double"))


@query("pivot_sources", with_l(f"""
clean AS (SELECT l_suppkey AS entity_id, s_name AS entity_name, year, p_type AS source, amount
          FROM cells JOIN supplier ON l_suppkey = s_suppkey)
SELECT entity_id, entity_name, year,
{",".join(chr(10) + f"  CAST(max(amount) FILTER (WHERE source = '{t}') AS DOUBLE) AS \"{t}\"" for t in fx.PART_TYPES)}
FROM clean GROUP BY entity_id, entity_name, year
"""))
def q_pivot_sources(spark, sf_dir):
    """R1 on funding cells already aggregated to (supplier, year, type)."""
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    cells = (fx.lineitem_l(spark, sf_dir).groupBy("l_suppkey", "year", "p_type").agg(F.sum("amount").alias("amount"))
             .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.col("l_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), "year",
                     F.col("p_type").alias("source"), "amount"))
    wide = pivot_strict(cells, ["entity_id", "entity_name", "year"], "source", "amount", categories=fx.PART_TYPES)
    return _double_metrics(wide, fx.PART_TYPES)


@query("club_rows", with_l(f"""
clean AS (SELECT l_suppkey // 2 AS entity_id, s_name AS entity_name, year, p_type AS source, amount
          FROM cells JOIN supplier ON l_suppkey = s_suppkey),
wide AS (
  SELECT entity_id, entity_name, year,
{",".join(chr(10) + f"  max(amount) FILTER (WHERE source = '{t}') AS \"{t}\"" for t in fx.PART_TYPES)}
  FROM clean GROUP BY entity_id, entity_name, year)
SELECT entity_id, year, min(entity_name) AS entity_name,
{",".join(chr(10) + f"  CAST(coalesce(sum(\"{t}\"), 0) AS DOUBLE) AS \"{t}\"" for t in fx.PART_TYPES)}
FROM wide GROUP BY entity_id, year
"""))
def q_club_rows(spark, sf_dir):
    """Campuses sharing one key: supplier keys folded in pairs (key div 2), then A1."""
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    cells = (fx.lineitem_l(spark, sf_dir).groupBy("l_suppkey", "year", "p_type").agg(F.sum("amount").alias("amount"))
             .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.expr("l_suppkey div 2").alias("entity_id"), F.col("s_name").alias("entity_name"), "year",
                     F.col("p_type").alias("source"), "amount"))
    wide = pivot_strict(cells, ["entity_id", "entity_name", "year"], "source", "amount", categories=fx.PART_TYPES)
    return _double_metrics(club(wide, ["entity_id", "year"], carry=["entity_name"]), fx.PART_TYPES)


# 3. Registry reshape and stability ------------------------------------------------

REGISTRY_LONG_SQL = """
li AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity, l_orderkey FROM lineitem),
yrs AS (SELECT DISTINCT year FROM li),
ents AS (SELECT DISTINCT l_suppkey FROM li),
agg AS (SELECT l_suppkey, year, sum(l_quantity) AS q, count(DISTINCT l_orderkey) AS n FROM li GROUP BY 1, 2),
reglong AS (
  SELECT e.l_suppkey AS entity_id, s_name AS entity_name, y.year, a.q AS "Quantity (units)",
         CASE WHEN y.year = (SELECT max(year) FROM yrs) THEN NULL ELSE coalesce(a.n, 0) END AS "Orders"
  FROM ents e CROSS JOIN yrs y JOIN supplier ON s_suppkey = e.l_suppkey
  LEFT JOIN agg a ON a.l_suppkey = e.l_suppkey AND a.year = y.year)
"""


@query("wide_years_to_long", "WITH " + REGISTRY_LONG_SQL.strip() + "\nSELECT * FROM reglong")
def q_wide_years_to_long(spark, sf_dir):
    return wide_years_to_long(fx.registry_wide_l(spark, sf_dir), ["entity_id", "entity_name"])


@query("change_counts", """
SELECT o_custkey AS entity_id,
       count(DISTINCT o_orderstatus) AS status_unique_count,
       count(DISTINCT o_orderpriority) AS priority_unique_count,
       count(DISTINCT CASE WHEN o_totalprice > 250000 THEN o_orderpriority END) AS large_priority_unique_count
FROM orders GROUP BY o_custkey
""")
def q_change_counts(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    long = o.select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("year"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                    F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority")).alias("large_priority"))
    return C.attribute_stability(long, ["entity_id"], ["status", "priority", "large_priority"])


# 4. Membership ---------------------------------------------------------------

L_YEARLY_SQL = """
yearly AS (SELECT l_suppkey AS entity_id, s_name AS entity_name, year, CAST(sum(amount) AS DOUBLE) AS amount
           FROM cells JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
"""


def _l_yearly(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    li = fx.lineitem_l(spark, sf_dir)
    y = li.groupBy("l_suppkey", "year").agg(F.sum("amount").cast("double").alias("amount"))
    return y.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), "year", "amount")


@query("flag_members", with_l(L_YEARLY_SQL.strip() + """
SELECT *, entity_id IN (SELECT entity_id FROM yearly WHERE entity_name IN (SELECT entity_name FROM members))
          AS member
FROM yearly
"""))
def q_flag_members(spark, sf_dir):
    return flag_members(_l_yearly(spark, sf_dir), fx.members_l(spark, sf_dir), "entity_name", "entity_id")


@query("keep_members", with_l(L_YEARLY_SQL.strip() + """
SELECT * FROM yearly
WHERE entity_id IN (SELECT entity_id FROM yearly WHERE entity_name IN (SELECT entity_name FROM members))
"""))
def q_keep_members(spark, sf_dir):
    return keep_members(_l_yearly(spark, sf_dir), fx.members_l(spark, sf_dir), "entity_name", "entity_id")


# 5. The panel (C1) --------------------------------------------------------------

@query("build_panel", with_l(REGISTRY_LONG_SQL.strip() + f""",
fixed AS (
  SELECT coalesce(o.entity_id, TRY_CAST(f.entity_id_raw AS BIGINT)) AS entity_id, f.entity_name, f.year,
         f.source, f.amount
  FROM funding f LEFT JOIN overrides o ON f.entity_name = o.entity_name),
wide AS (
  SELECT year, entity_name, entity_id,
{_types_filter("max")}
  FROM fixed WHERE entity_id IS NOT NULL GROUP BY year, entity_name, entity_id),
clubbed AS (
  SELECT entity_id, year, min(entity_name) AS entity_name,
{",".join(chr(10) + f"    coalesce(sum(\"{t}\"), 0) AS \"{t}\"" for t in fx.PART_TYPES)}
  FROM wide GROUP BY entity_id, year),
flagged AS (
  SELECT *, entity_id IN (SELECT entity_id FROM clubbed WHERE entity_name IN (SELECT entity_name FROM members))
            AS member
  FROM clubbed),
classes AS (SELECT s_suppkey AS unitid, n_name AS nation, r_name AS region
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
inst AS (SELECT r.*, c.nation, c.region FROM reglong r LEFT JOIN classes c ON r.entity_id = c.unitid)
SELECT inst.*, f.entity_name AS entity_name_funding,
{",".join(chr(10) + f"  CAST(f.\"{t}\" AS DOUBLE) AS \"{t}\"" for t in fx.PART_TYPES)},
  f.member
FROM inst JOIN flagged f ON inst.entity_id = f.entity_id AND inst.year = f.year
"""))
def q_build_panel(spark, sf_dir):
    panel = C.build_panel(fx.funding_l(spark, sf_dir), fx.overrides_l(spark, sf_dir), fx.registry_wide_l(spark, sf_dir),
                          fx.classes_l(spark, sf_dir), fx.members_l(spark, sf_dir), sources=fx.PART_TYPES)
    return _double_metrics(panel, fx.PART_TYPES)


# 6. Profile-level operators ([O]) ---------------------------------------------------

@query("latest_value", """
SELECT o_custkey AS entity_id,
       arg_max_null(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END,
                    (CAST(year(o_orderdate) AS INTEGER), o_orderkey)) AS status,
       max(CAST(year(o_orderdate) AS INTEGER)) AS year
FROM orders GROUP BY o_custkey
""")
def q_latest_value(spark, sf_dir):
    """A2 with a NULL latest value kept as NULL (statuses of low-priority orders blanked)."""
    o = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").cast("int").alias("year"), "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"))
    return latest(o, ["entity_id"], ["status", "year"], by=["year", "o_orderkey"])


@query("latest_by_late_fetch", ORACLE["latest_value"])
def q_latest_by_late_fetch(spark, sf_dir):
    """A2 as above, the aggregate seeing keys, order and places only."""
    o = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").cast("int").alias("year"), "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"))
    return latest_rows(o, "entity_id", ["status", "year"], by=["year", "o_orderkey"])


@query("cohort_or_target", with_o("""
SELECT entity_id, entity_name, member FROM peers
"""))
def q_cohort_or_target(spark, sf_dir):
    _, peers, _ = o_peers(spark, sf_dir)
    return peers.select("entity_id", "entity_name", "member")


@query("row_totals", with_o("SELECT entity_id, total_with, total_without FROM profile"))
def q_row_totals(spark, sf_dir):
    return fx.profile_o(spark, sf_dir).select("entity_id", "total_with", "total_without")


@query("rescale", with_o("""
SELECT entity_id, urgent * 1000.0 AS urgent, high * 1000.0 AS high, medium * 1000.0 AS medium,
       not_specified * 1000.0 AS not_specified, low * 1000.0 AS low FROM profile
"""))
def q_rescale(spark, sf_dir):
    return rescale(fx.profile_o(spark, sf_dir), fx.O_METRICS, 1000).select("entity_id", *fx.O_METRICS)


@query("recode_binary", with_o("""
SELECT entity_id, status, CASE WHEN status = 'F' THEN 'R1' ELSE 'R2' END AS designation FROM profile
"""))
def q_recode_binary(spark, sf_dir):
    p = fx.profile_o(spark, sf_dir)
    return recode_binary(p, "status", "F", "R1", "R2", out="designation").select("entity_id", "status", "designation")


# Example code lists (nation codes 1-3 and two order statuses are labelled;
# every other code is unlisted and must come out NULL).
NATION_CODE_LABELS = {1: "one", 2: "two", 3: "three"}
STATUS_LABELS = {"F": "finished", "O": "open"}


@query("code_labels", """
SELECT o_orderkey, c_nationkey,
  CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS nation_label,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status_label
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def q_code_labels(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("o_orderkey", "c_nationkey",
                    code_labels("c_nationkey", NATION_CODE_LABELS).alias("nation_label"),
                    code_labels("o_orderstatus", STATUS_LABELS).alias("status_label"))


SEG_NULL_SQL = """
seg AS (
  SELECT c_custkey, r_name AS region, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def _seg_null(spark, sf_dir):
    c = fx.customers_o(spark, sf_dir)
    bal = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), "c_acctbal")
    return c.join(bal, "entity_id").select(
        "entity_id", "region", F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("segment")).alias("segment"))


@query("count_by_keep_null", "WITH " + SEG_NULL_SQL.strip() + """
SELECT region, segment, count(*) AS count FROM seg GROUP BY region, segment
""")
def q_count_by_keep_null(spark, sf_dir):
    return count_by(_seg_null(spark, sf_dir), ["region", "segment"])


@query("count_by_drop_null", "WITH " + SEG_NULL_SQL.strip() + """
SELECT region, segment, count(*) AS count FROM seg WHERE region IS NOT NULL AND segment IS NOT NULL
GROUP BY region, segment
""")
def q_count_by_drop_null(spark, sf_dir):
    return count_by(_seg_null(spark, sf_dir), ["region", "segment"], dropna=True)


ATTRS3 = ["segment", "region", "status"]


def _long_attr_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS variable, CAST({a} AS VARCHAR) AS value FROM {src} WHERE {a} IS NOT NULL" for a in ATTRS3)


@query("value_shares", with_o(f"""
, lng AS ({_long_attr_sql('profile')}),
cnt AS (SELECT variable, value, count(*) AS count FROM lng GROUP BY 1, 2),
tot AS (SELECT variable, sum(count) AS total FROM cnt GROUP BY 1)
SELECT cnt.variable, value, count, CAST(total AS BIGINT) AS total, count / total AS share,
       printf('%.1f', round_even(count / total * 100, 1)) || '%' AS percent
FROM cnt JOIN tot ON cnt.variable = tot.variable
""".replace("\n, lng", ",\nlng", 1)))
def q_value_shares(spark, sf_dir):
    vs = value_shares(fx.profile_o(spark, sf_dir), ATTRS3)
    return vs.withColumn("percent", percent_text("share"))


MODE_SQL = """
lng AS ({long}),
cnt AS (SELECT variable, value, count(*) AS count FROM lng GROUP BY 1, 2),
tot AS (SELECT variable, sum(count) AS total FROM cnt GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY count DESC, value) AS rn FROM cnt),
modes AS (SELECT r.variable, r.value AS mode, r.count AS mode_count, CAST(t.total AS BIGINT) AS total,
                 r.count / t.total AS mode_share
          FROM ranked r JOIN tot t ON r.variable = t.variable WHERE rn = 1)
"""


@query("modal_match", with_o(""",
filled AS (SELECT entity_id, coalesce(segment, 'Unknown') AS segment, coalesce(region, 'Unknown') AS region,
                  coalesce(status, 'Unknown') AS status FROM peers),
""" + MODE_SQL.format(long=_long_attr_sql("(SELECT * FROM filled WHERE entity_id <> (SELECT id FROM target))")) + """,
tv AS (SELECT 'segment' AS variable, segment AS target_value FROM filled WHERE entity_id = (SELECT id FROM target)
       UNION ALL SELECT 'region', region FROM filled WHERE entity_id = (SELECT id FROM target)
       UNION ALL SELECT 'status', status FROM filled WHERE entity_id = (SELECT id FROM target))
SELECT m.*, tv.target_value, CASE WHEN tv.target_value = m.mode THEN 'Yes' ELSE 'No' END AS match,
       CASE WHEN tv.target_value = m.mode THEN 1 ELSE 0 END AS match_code,
       printf('%.1f', round_even(mode_share * 100, 1)) || '%' AS mode_percent
FROM modes m LEFT JOIN tv ON m.variable = tv.variable
""".replace("peers),\n,", "peers),", 1)).replace("FROM peers)\n,\nfilled", "FROM peers),\nfilled"))
def q_modal_match(spark, sf_dir):
    _, peers, target = o_peers(spark, sf_dir)
    return C.modal_match(peers, "entity_id", target, ATTRS3)


@query("modal_by_group", with_o("""
, lng AS (SELECT region, 'segment' AS variable, segment AS value FROM profile WHERE segment IS NOT NULL
        UNION ALL SELECT region, 'status', status FROM profile WHERE status IS NOT NULL),
cnt AS (SELECT region, variable, value, count(*) AS n FROM lng GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY region, variable ORDER BY n DESC, value) AS rn FROM cnt)
SELECT region, max(value) FILTER (WHERE variable = 'segment') AS segment,
       max(value) FILTER (WHERE variable = 'status') AS status
FROM ranked WHERE rn = 1 GROUP BY region
""".replace("\n, lng", ",\nlng", 1)))
def q_modal_by_group(spark, sf_dir):
    return modal_by_group(fx.profile_o(spark, sf_dir), "region", ["segment", "status"])


LINE_ATTRS = {"part": "l_partkey", "supplier": "l_suppkey", "quantity": "CAST(l_quantity AS INTEGER)", "status": "l_linestatus"}
LINE_SQL = " UNION ALL ".join(f"SELECT l_returnflag, '{k}' AS variable, CAST({v} AS VARCHAR) AS value FROM lineitem "
                              f"WHERE {v} IS NOT NULL" for k, v in LINE_ATTRS.items())


def _line_attrs(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.expr(v).alias(k) for k, v in LINE_ATTRS.items()])


@query("modes_by_candidates", "WITH " + MODE_SQL.format(long=LINE_SQL) + "SELECT * FROM modes")
def q_modes_by_candidates(spark, sf_dir):
    """A10 on columns of line items with many values (parts, suppliers) and with few."""
    return modes_by_candidates(_line_attrs(spark, sf_dir), list(LINE_ATTRS))


@query("modes_by_candidates_grouped", f"""
WITH lng AS ({LINE_SQL}),
cnt AS (SELECT l_returnflag, variable, value, count(*) AS n FROM lng WHERE l_returnflag IS NOT NULL GROUP BY 1, 2, 3),
tot AS (SELECT l_returnflag, variable, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, variable ORDER BY n DESC, value) AS rn FROM cnt)
SELECT l_returnflag, variable, value AS mode, n AS mode_count, total, n / total AS mode_share
FROM ranked JOIN tot USING (l_returnflag, variable) WHERE rn = 1
""")
def q_modes_by_candidates_grouped(spark, sf_dir):
    """A11 by candidates, per return flag."""
    return modes_by_candidates(_line_attrs(spark, sf_dir), list(LINE_ATTRS), "l_returnflag")


@query("compare_categorical", with_o(f""",
lng AS ({_long_attr_sql("(SELECT * FROM peers WHERE entity_id <> (SELECT id FROM target))")}),
cnt AS (SELECT variable, value, count(*) AS count FROM lng GROUP BY 1, 2),
tot AS (SELECT variable, sum(count) AS total FROM cnt GROUP BY 1),
tv AS (SELECT 'segment' AS variable, CAST(segment AS VARCHAR) AS target_value FROM peers
         WHERE entity_id = (SELECT id FROM target)
       UNION ALL SELECT 'region', region FROM peers WHERE entity_id = (SELECT id FROM target)
       UNION ALL SELECT 'status', status FROM peers WHERE entity_id = (SELECT id FROM target))
SELECT cnt.variable, value, count, CAST(total AS BIGINT) AS total, count / total AS share,
       coalesce(tv.target_value, 'N/A') AS target_value,
       printf('%.1f', round_even(count / total * 100, 1)) || '%' AS percent
FROM cnt JOIN tot ON cnt.variable = tot.variable LEFT JOIN tv ON cnt.variable = tv.variable
""".replace("peers WHERE member OR entity_id = (SELECT id FROM target))\n,", "peers WHERE member OR entity_id = (SELECT id FROM target)),", 1)))
def q_compare_categorical(spark, sf_dir):
    _, peers, target = o_peers(spark, sf_dir)
    return C.compare_categorical(peers, "entity_id", target, ATTRS3)


# 7. Cohorts (C9, C10, U1, P9, P10, O3) -----------------------------------------------

COHORT_SQL = """,
stacked AS (SELECT CASE WHEN status = 'F' THEN 'R1' ELSE 'R2' END AS designation, entity_id, segment,
                   urgent, high, medium, not_specified, low FROM profile
            UNION ALL
            SELECT 'MEMBER', entity_id, segment, urgent, high, medium, not_specified, low FROM profile WHERE member)
"""


def _stacked(spark, sf_dir, materialize: bool = False):
    """The overlapping cohorts; ``materialize`` when the query passes over them twice."""
    prof = o_profile(spark, sf_dir) if materialize else fx.profile_o(spark, sf_dir)
    p = C.recode_designation(prof, "status", "F")
    return C.designations(p, "member", "MEMBER", "designation", ["entity_id", "segment", *fx.O_METRICS])


@query("cohort_shares", with_o(COHORT_SQL.strip().lstrip(",").join([",\n", ""]) + """,
segs AS (SELECT DISTINCT segment FROM stacked WHERE segment IS NOT NULL),
des AS (SELECT DISTINCT designation FROM stacked),
cnt AS (SELECT d.designation, s.segment,
               (SELECT count(*) FROM stacked x WHERE x.designation = d.designation AND x.segment = s.segment) AS count
        FROM des d CROSS JOIN segs s)
SELECT designation, segment, count,
       CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY designation) AS share
FROM cnt
"""))
def q_cohort_shares(spark, sf_dir):
    # two passes: the category list (a plan-time fact) and the shares
    return C.cohort_shares(_stacked(spark, sf_dir, materialize=True), "segment", fill_zero=True)


@query("cohort_funding", with_o(COHORT_SQL.strip().lstrip(",").join([",\n", ""]) + """
SELECT designation,
  round(CAST(sum(urgent) AS DOUBLE) / count(urgent) * 1000.0, 4) AS urgent,
  round(CAST(sum(high) AS DOUBLE) / count(high) * 1000.0, 4) AS high,
  round(CAST(sum(medium) AS DOUBLE) / count(medium) * 1000.0, 4) AS medium,
  round(CAST(sum(not_specified) AS DOUBLE) / count(not_specified) * 1000.0, 4) AS not_specified,
  round(CAST(sum(low) AS DOUBLE) / count(low) * 1000.0, 4) AS low
FROM stacked GROUP BY designation
"""))
def q_cohort_funding(spark, sf_dir):
    out = C.cohort_funding(_stacked(spark, sf_dir), fx.O_METRICS)
    return out.withColumns({m: r4(m) for m in fx.O_METRICS})


# Short labels for the cohort names.
COHORT_SHORT = {"MEMBER": "Member", "R1": "Tier 1", "R2": "Tier 2"}


@query("label_cohorts", with_o(COHORT_SQL.strip().lstrip(",").join([",\n", ""]) + """
SELECT CASE designation WHEN 'MEMBER' THEN 'Member' WHEN 'R1' THEN 'Tier 1' WHEN 'R2' THEN 'Tier 2'
       ELSE designation END AS cohort, entity_id, segment
FROM stacked
"""))
def q_label_cohorts(spark, sf_dir):
    st = _stacked(spark, sf_dir)
    lab = label_cohort(st, "designation", "cohort", drop=["designation", *fx.O_METRICS])
    return short_labels(lab, "cohort", COHORT_SHORT)


# A declared order of priorities; 1-URGENT is deliberately left out.
PRIORITY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@query("category_order", """
SELECT CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH') THEN o_orderpriority END
         AS o_orderpriority,
       CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
         WHEN '2-HIGH' THEN 3 END AS category_rank,
       count(*) AS count
FROM orders GROUP BY o_orderpriority
""")
def q_category_order(spark, sf_dir):
    counts = count_by(fx.table(spark, sf_dir, "orders"), ["o_orderpriority"])
    return order_by_category(counts, "o_orderpriority", PRIORITY_ORDER)


# 8. Target against peers (C3, C4, C6, W2) -----------------------------------------------

@query("target_vs_means", with_o("""
, t AS (SELECT * FROM peers)
SELECT m.metric,
  avg(CASE WHEN entity_id = (SELECT id FROM target) THEN v END) AS target,
  round(avg(CASE WHEN entity_id <> (SELECT id FROM target) THEN v END), 4) AS mean_with_outlier,
  round(avg(CASE WHEN entity_id <> (SELECT id FROM target) AND entity_id <> (SELECT id FROM outlier) THEN v END), 4)
    AS mean_without_outlier
FROM (SELECT entity_id, 'urgent' AS metric, urgent AS v FROM t
      UNION ALL SELECT entity_id, 'high', high FROM t UNION ALL SELECT entity_id, 'medium', medium FROM t
      UNION ALL SELECT entity_id, 'not_specified', not_specified FROM t UNION ALL SELECT entity_id, 'low', low FROM t
      UNION ALL SELECT entity_id, 'total_with', total_with FROM t
      UNION ALL SELECT entity_id, 'total_without', total_without FROM t) m
GROUP BY m.metric
""".replace("\n, t AS", ",\nt AS", 1)))
def q_target_vs_means(spark, sf_dir):
    prof, peers, target = o_peers(spark, sf_dir)
    outlier = o_outlier(prof)
    out = C.target_vs_means(peers, "entity_id", target, outlier, fx.O_ALL_METRICS)
    return out.withColumn("mean_with_outlier", r4("mean_with_outlier")).withColumn(
        "mean_without_outlier", r4("mean_without_outlier"))


ROLLUP_METRICS = ["urgent", "total_with"]


@query("rollup_by_nation", with_o("""
, v AS (
  SELECT nation, 'with' AS outlier, 'mean' AS method, avg(urgent) AS urgent, avg(total_with) AS total_with
    FROM profile WHERE nation IS NOT NULL GROUP BY nation
  UNION ALL
  SELECT nation, 'with', 'total', sum(urgent), sum(total_with) FROM profile WHERE nation IS NOT NULL GROUP BY nation
  UNION ALL
  SELECT nation, 'without', 'mean', avg(urgent), avg(total_with) FROM profile
    WHERE nation IS NOT NULL AND entity_id <> (SELECT id FROM outlier) GROUP BY nation
  UNION ALL
  SELECT nation, 'without', 'total', sum(urgent), sum(total_with) FROM profile
    WHERE nation IS NOT NULL AND entity_id <> (SELECT id FROM outlier) GROUP BY nation)
SELECT v.nation, v.outlier, v.method, round(v.urgent, 4) AS urgent, round(v.total_with, 4) AS total_with,
       n_nationkey, n_regionkey
FROM v JOIN nation ON v.nation = n_name
""".replace("\n, v AS", ",\nv AS", 1)))
def q_rollup_by_nation(spark, sf_dir):
    prof = o_profile(spark, sf_dir)
    outlier = o_outlier(prof)
    dim = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), "n_nationkey", "n_regionkey")
    out = C.rollup_by_state(prof, dim, "nation", "nation", ROLLUP_METRICS, "entity_id", outlier)
    return out.withColumns({m: r4(m) for m in ROLLUP_METRICS})


QUART_METRICS = ["urgent", "total_with"]


def _qbin_sql(m: str, src: str = "profile") -> str:
    return (f"CASE WHEN {m} IS NULL THEN NULL "
            f"WHEN {m} <= (SELECT q[2] FROM qs_{m}) THEN 'Q1 (Low)' "
            f"WHEN {m} <= (SELECT q[3] FROM qs_{m}) THEN 'Q2' "
            f"WHEN {m} <= (SELECT q[4] FROM qs_{m}) THEN 'Q3' ELSE 'Q4 (High)' END")


def _qs_sql(src: str) -> str:
    return ",\n".join(f"qs_{m} AS (SELECT quantile_cont({m}, [0, 0.25, 0.5, 0.75, 1]) AS q FROM {src})"
                      for m in QUART_METRICS)


@query("quantile_bins", with_o(f""",
{_qs_sql('profile')}
SELECT entity_id, {", ".join(_qbin_sql(m) + f' AS {m}_quartile' for m in QUART_METRICS)}
FROM profile
"""))
def q_quantile_bins(spark, sf_dir):
    b = quantile_bin(o_profile(spark, sf_dir), QUART_METRICS)
    return b.select("entity_id", *[f"{m}_quartile" for m in QUART_METRICS])


@query("quartile_distribution", with_o(f""",
{_qs_sql('peers')},
binned AS (SELECT entity_id, {", ".join(_qbin_sql(m) + f' AS {m}' for m in QUART_METRICS)} FROM peers),
lng AS ({" UNION ALL ".join(f"SELECT entity_id, '{m}' AS metric, {m} AS quartile FROM binned" for m in QUART_METRICS)}),
cnt AS (SELECT metric, quartile, count(*) AS count FROM lng WHERE quartile IS NOT NULL GROUP BY 1, 2),
tq AS (SELECT metric, coalesce(max(quartile) FILTER (WHERE entity_id = (SELECT id FROM target)), 'Unknown')
         AS target_quartile FROM lng GROUP BY metric)
SELECT cnt.metric, quartile, count, target_quartile,
  CASE quartile WHEN 'Q1 (Low)' THEN 0 WHEN 'Q2' THEN 1 WHEN 'Q3' THEN 2 WHEN 'Q4 (High)' THEN 3 END AS quartile_rank
FROM cnt JOIN tq ON cnt.metric = tq.metric
"""))
def q_quartile_distribution(spark, sf_dir):
    _, peers, target = o_peers(spark, sf_dir)
    return C.quartile_distribution(peers, QUART_METRICS, "entity_id", target)


def _box_sql(src: str) -> str:
    lng = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM {src} WHERE {m} IS NOT NULL"
                             for m in fx.O_ALL_METRICS)
    return f""",
lng AS ({lng}),
qq AS (SELECT metric, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
              quantile_cont(v, 0.75) AS q3 FROM lng GROUP BY metric),
box AS (
  SELECT l.metric, count(*) AS n, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max,
    min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
    max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
    count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers,
    round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3
  FROM lng l JOIN qq ON l.metric = qq.metric GROUP BY l.metric)
"""


@query("box_stats", with_o(_box_sql("profile") + "SELECT * FROM box"))
def q_box_stats(spark, sf_dir):
    return _round_box(box_stats(o_profile(spark, sf_dir), fx.O_ALL_METRICS))


def _round_box(df: DataFrame) -> DataFrame:
    """Interpolated quartiles differ from DuckDB's by at most one ulp: compare them to 6 places."""
    return df.withColumns({"mean": r4("mean"), "q1": F.round("q1", 6), "median": F.round("median", 6),
                           "q3": F.round("q3", 6)})


@query("target_vs_box", with_o(_box_sql("(SELECT * FROM peers WHERE entity_id <> (SELECT id FROM target))") + """,
tv AS (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, (SELECT {m} FROM peers WHERE entity_id = (SELECT id FROM target)) AS target_value"
    for m in fx.O_ALL_METRICS) + """)
SELECT box.*, tv.target_value,
       regexp_replace(box.metric, '^.* of ', '') AS label
FROM box LEFT JOIN tv ON box.metric = tv.metric
"""))
def q_target_vs_box(spark, sf_dir):
    _, peers, target = o_peers(spark, sf_dir)
    return _round_box(C.target_vs_box(peers, "entity_id", target, fx.O_ALL_METRICS))


# 9. Fills, standardising, one-hot (X7, X8, W3, R6) ----------------------------------

@query("median_impute", with_o(""",
holes AS (SELECT entity_id, CASE WHEN status = 'P' THEN NULL ELSE urgent END AS urgent,
                 CASE WHEN status = 'O' THEN NULL ELSE total_with END AS total_with FROM profile)
SELECT entity_id,
  coalesce(urgent, (SELECT quantile_cont(urgent, 0.5) FROM holes)) AS urgent,
  coalesce(total_with, (SELECT quantile_cont(total_with, 0.5) FROM holes)) AS total_with
FROM holes
"""))
def q_median_impute(spark, sf_dir):
    p = o_profile(spark, sf_dir)
    holes = p.select("entity_id",
                     F.when(F.col("status") == "P", F.lit(None)).otherwise(F.col("urgent")).alias("urgent"),
                     F.when(F.col("status") == "O", F.lit(None)).otherwise(F.col("total_with")).alias("total_with"))
    return median_impute(holes, ["urgent", "total_with"])


@query("fill_unknown", with_o("""
SELECT entity_id, coalesce(CASE WHEN status = 'P' THEN NULL ELSE segment END, 'Unknown') AS segment,
       coalesce(CASE WHEN status = 'O' THEN NULL ELSE nation END, 'Unknown') AS nation
FROM profile
"""))
def q_fill_unknown(spark, sf_dir):
    p = fx.profile_o(spark, sf_dir)
    holes = p.select("entity_id",
                     F.when(F.col("status") == "P", F.lit(None)).otherwise(F.col("segment")).alias("segment"),
                     F.when(F.col("status") == "O", F.lit(None)).otherwise(F.col("nation")).alias("nation"))
    return fill_unknown(holes, ["segment", "nation"])


def _z_sql(cols, src: str = "profile", nd: int = 6) -> str:
    return ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 1 "
        f"ELSE stddev_pop({c}) OVER () END, {nd}) AS {c}" for c in cols)


@query("standardize", with_o(f"\nSELECT entity_id, {_z_sql(fx.O_METRICS)} FROM profile"))
def q_standardize(spark, sf_dir):
    z = standardize(o_profile(spark, sf_dir), fx.O_METRICS)
    return z.select("entity_id", *[F.round(m, 6).alias(m) for m in fx.O_METRICS])


@query("features_numeric", with_o(f"\nSELECT entity_id, {_z_sql(fx.O_ALL_METRICS)} FROM profile"))
def q_features_numeric(spark, sf_dir):
    f = features_numeric(o_profile(spark, sf_dir), "entity_id", fx.O_ALL_METRICS)
    return f.select("entity_id", *[F.round(m, 6).alias(m) for m in fx.O_ALL_METRICS])


SEGMENTS_SQL = ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\""
    for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("one_hot", f"SELECT c_custkey, c_nationkey, {SEGMENTS_SQL} FROM customer")
def q_one_hot(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return one_hot(c, ["c_mktsegment", "c_nationkey"])


@query("panel_refresh", """
SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(count(*) AS DOUBLE) AS n
FROM orders GROUP BY 1, 2
""")
def q_panel_refresh(spark, sf_dir):
    """The panel of all orders, written when the urgent ones had no amount yet, refreshed with these."""
    now = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("year"), "o_orderpriority",
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit(1).alias("n"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    path = scratch_path(spark, f"panel-{uuid.uuid4().hex}")
    clubbed = lambda rows: club(rows, ["entity_id", "year"], values=["amount", "n"], as_double=True)
    refresh_panel(now.where(~urgent), None, path, clubbed)
    refresh_panel(now, now.where(urgent), path, clubbed)
    return read_panel(spark, path).select("entity_id", "year", "amount", "n")


CATEGORY_IDS_SQL = """
long AS (SELECT 'o_orderpriority' AS variable, o_orderpriority AS value, NULL AS number FROM orders
         UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), o_custkey FROM orders),
ids AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY number, value) - 1 AS id, count
        FROM (SELECT variable, value, number, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3))
"""


@query("category_ids", f"WITH {CATEGORY_IDS_SQL} SELECT variable, value, id, count FROM ids")
def q_category_ids(spark, sf_dir):
    return category_dictionary(fx.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"])


@query("one_hot_places", f"""
WITH {CATEGORY_IDS_SQL}
SELECT o_orderkey, concat_ws(',', p.id, (SELECT count(DISTINCT o_orderpriority) FROM orders) + c.id) AS places
FROM orders LEFT JOIN ids p ON p.variable = 'o_orderpriority' AND p.value = o_orderpriority
LEFT JOIN ids c ON c.variable = 'o_custkey' AND c.value = CAST(o_custkey AS VARCHAR)
""")
def q_one_hot_places(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    places, _ = one_hot_places(o, ["o_orderpriority", "o_custkey"])
    return places.select("o_orderkey", F.array_join("places", ",").alias("places"))


MIXED_NUM = ["urgent", "high", "total_with"]


@query("mixed_features", with_o(""",
holes AS (SELECT entity_id, CASE WHEN status = 'P' THEN NULL ELSE urgent END AS urgent, high, total_with,
                 CASE WHEN status = 'O' THEN NULL ELSE segment END AS segment, n_nationkey AS nation_code
          FROM profile JOIN nation ON nation = n_name),
filled AS (SELECT entity_id,
  coalesce(urgent, (SELECT quantile_cont(urgent, 0.5) FROM holes)) AS urgent,
  coalesce(high, (SELECT quantile_cont(high, 0.5) FROM holes)) AS high,
  coalesce(total_with, (SELECT quantile_cont(total_with, 0.5) FROM holes)) AS total_with,
  coalesce(segment, 'Unknown') AS segment, nation_code FROM holes)
SELECT entity_id, """ + _z_sql(MIXED_NUM, "filled") + """, nation_code,
""" + ", ".join(f"CASE WHEN segment = '{s}' THEN 1 ELSE 0 END AS \"segment_{s}\""
                for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown"]) + """
FROM filled
"""))
def q_mixed_features(spark, sf_dir):
    p = o_profile(spark, sf_dir)
    nat = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), F.col("n_nationkey").alias("nation_code"))
    holes = p.join(nat, "nation").select(
        "entity_id", F.when(F.col("status") == "P", F.lit(None)).otherwise(F.col("urgent")).alias("urgent"),
        "high", "total_with",
        F.when(F.col("status") == "O", F.lit(None)).otherwise(F.col("segment")).alias("segment"), "nation_code")
    feats = features_mixed(holes, "entity_id", MIXED_NUM, ["segment", "nation_code"])
    cols = feature_columns(feats, "entity_id")
    return feats.select("entity_id", *[F.round(c, 6).alias(c) if c in MIXED_NUM else F.col(c) for c in cols])


# 10. Joins, lookups, ordering (J3, J7, F6, X10, A15, A20, A17, W4, O2, A16) -------------------

@query("panel_join", with_l(L_YEARLY_SQL.strip() + """,
ord AS (SELECT l_suppkey AS entity_id, CAST(year(l_shipdate) AS INTEGER) AS year, s_name AS entity_name,
               count(DISTINCT l_orderkey) AS n_orders
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
SELECT y.entity_id, y.year, y.amount, o.entity_name AS entity_name_right, o.n_orders
FROM yearly y JOIN ord o ON y.entity_id = o.entity_id AND y.year = o.year
"""))
def q_panel_join(spark, sf_dir):
    left = _l_yearly(spark, sf_dir)
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    li = fx.lineitem_l(spark, sf_dir)
    right = (li.groupBy("l_suppkey", "year").agg(F.count_distinct("l_orderkey").alias("n_orders"))
             .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.col("l_suppkey").alias("entity_id"), "year", F.col("s_name").alias("entity_name"), "n_orders"))
    j = panel_join(left, right, ["entity_id", "year"], ["entity_id", "year"])
    return sort_by(j.drop("entity_name"), ["entity_id", "year"], [False, True])


@query("attach_side", with_o(f""",
{_qs_sql('profile')}
SELECT entity_id, entity_name, total_with, {_qbin_sql('total_with')} AS total_with_quartile FROM profile
"""))
def q_attach_side(spark, sf_dir):
    p = o_profile(spark, sf_dir)
    side = quantile_bin(p.select("entity_id", "total_with"), ["total_with"]).select("entity_id", "total_with_quartile")
    return attach(p.select("entity_id", "entity_name", "total_with"), side, "entity_id")


@query("lookup_entity", with_o("""
SELECT entity_name, urgent, total_with FROM profile
WHERE entity_name = (SELECT entity_name FROM profile WHERE entity_id = (SELECT id FROM target))
"""))
def q_lookup_entity(spark, sf_dir):
    p = o_profile(spark, sf_dir)
    target = o_target(p)
    name = p.where(F.col("entity_id") == target).select("entity_name").scalar()
    return lookup(p, "entity_name", name, ["entity_name", "urgent", "total_with"])


@query("target_value", with_o("""
SELECT (SELECT urgent FROM profile WHERE entity_id = (SELECT id FROM target)) AS target_urgent,
       coalesce((SELECT segment FROM profile WHERE entity_id = (SELECT id FROM target)), 'N/A') AS target_segment,
       (SELECT urgent FROM profile WHERE entity_id = -1) AS absent_urgent,
       coalesce((SELECT segment FROM profile WHERE entity_id = -1), 'N/A') AS absent_segment
"""))
def q_target_value(spark, sf_dir):
    p = o_profile(spark, sf_dir)
    target = o_target(p)
    a = target_value(p, "entity_id", target, ["urgent"])
    b = target_value(p, "entity_id", target, ["segment"], default="N/A")
    c = target_value(p, "entity_id", -1, ["urgent"], prefix="absent_")
    d = target_value(p, "entity_id", -1, ["segment"], default="N/A", prefix="absent_")
    return a.crossJoin(b).crossJoin(c).crossJoin(d)


@query("distinct_years", with_o("SELECT DISTINCT year FROM panel"))
def q_distinct_years(spark, sf_dir):
    return distinct_values(fx.panel_o(spark, sf_dir), "year")


@query("row_counts", with_o("SELECT region, count(*) AS n FROM profile GROUP BY region"))
def q_row_counts(spark, sf_dir):
    return row_count(fx.profile_o(spark, sf_dir), "region")


EXACT_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("exact_quantiles", with_o(""",
lng AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS variable, {m} AS v FROM profile WHERE {m} IS NOT NULL"
                                  for m in fx.O_ALL_METRICS) + """)
""" + " UNION ALL ".join(f"SELECT variable, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(v, {p}), 6) AS value, "
                         f"count(*) AS n FROM lng GROUP BY variable" for p in [0.1, 0.25, 0.5, 0.75, 0.9])))
def q_exact_quantiles(spark, sf_dir):
    q = quantiles_long(o_profile(spark, sf_dir), fx.O_ALL_METRICS, EXACT_PROBS)
    return q.withColumn("value", F.round("value", 6))


@query("rank_in_group", with_o("""
SELECT region, entity_id, total_with,
       row_number() OVER (PARTITION BY region ORDER BY total_with DESC, entity_id) AS rank
FROM profile
"""))
def q_rank_in_group(spark, sf_dir):
    p = fx.profile_o(spark, sf_dir).select("region", "entity_id", "total_with")
    return rank_within(p, "region", [F.col("total_with").desc(), F.col("entity_id").asc()])


@query("top_k", with_o("""
SELECT entity_id, entity_name, total_with FROM profile ORDER BY total_with DESC, entity_id LIMIT 5
"""))
def q_top_k(spark, sf_dir):
    p = fx.profile_o(spark, sf_dir)
    return top_k(p, "total_with", 5, tie=["entity_id"]).select("entity_id", "entity_name", "total_with")


@query("dedupe", """
SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus,
       arg_min(o_totalprice, o_orderkey) AS o_totalprice, arg_min(o_orderdate, o_orderkey) AS o_orderdate,
       arg_min(o_orderpriority, o_orderkey) AS o_orderpriority
FROM orders GROUP BY o_custkey
""")
def q_dedupe(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return dedupe(o, "o_custkey", ["o_orderkey"])


@query("dedupe_by_late_fetch", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""")
def q_dedupe_by_late_fetch(spark, sf_dir):
    """A16 on wide rows: the first document of each source and language; the texts of other documents do not move."""
    return pick_rows(fx.table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id")


@query("text_functions", """
SELECT p_partkey,
  string_split('Division of ' || p_type, ' of ')[-1] AS type_label,
  p_name AS name_label,
  CASE WHEN length(CAST(p_size AS VARCHAR)) >= 2 THEN CAST(p_size AS VARCHAR)
       ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END AS size_code,
  '$' || format('{:,}', CAST(floor(p_retailprice * 1000) AS BIGINT)) AS price_text
FROM part
""")
def q_text_functions(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    return p.select("p_partkey", last_of(F.concat(F.lit("Division of "), F.col("p_type"))).alias("type_label"),
                    last_of("p_name").alias("name_label"), zero_pad("p_size", 2).alias("size_code"),
                    money_text(F.floor(F.col("p_retailprice") * 1000).cast("double")).alias("price_text"))


# 11. Model-side operators with a closed form (M4 k=1, M5, M6, M7, C13) ----------------------

# Three literal centres in (urgent, high) money space.
NEAREST_CENTRES = [[0.0, 0.0], [150000.0, 150000.0], [300000.0, 50000.0]]


@query("assign_nearest", with_o("""
, d AS (SELECT entity_id,
   (urgent - 0.0) * (urgent - 0.0) + (high - 0.0) * (high - 0.0) AS d0,
   (urgent - 150000.0) * (urgent - 150000.0) + (high - 150000.0) * (high - 150000.0) AS d1,
   (urgent - 300000.0) * (urgent - 300000.0) + (high - 50000.0) * (high - 50000.0) AS d2 FROM profile)
SELECT entity_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d
""".replace("\n, d AS", ",\nd AS", 1)))
def q_assign_nearest(spark, sf_dir):
    p = fx.profile_o(spark, sf_dir)
    return assign_nearest(p, NEAREST_CENTRES, columns=["urgent", "high"]).select("entity_id", "cluster")


@query("inertia_k1", with_o(""",
z AS (SELECT """ + _z_sql(fx.O_METRICS, nd=12) + """ FROM profile)
SELECT 1 AS k, round(""" + " + ".join(f"var_pop({m}) * count({m})" for m in fx.O_METRICS) + """, 4) AS inertia
FROM z
"""))
def q_inertia_k1(spark, sf_dir):
    f = features_numeric(o_profile(spark, sf_dir), "entity_id", fx.O_METRICS)
    return inertia_k1(f).withColumn("inertia", r4("inertia"))


PCA2 = ["urgent", "high"]


@query("pca_explained", with_o(f""",
r AS (SELECT abs(corr({PCA2[0]}, {PCA2[1]})) AS r FROM profile)
SELECT 1 AS component, round((1 + r) / 2, 6) AS explained_variance_ratio FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM r
"""))
def q_pca_explained(spark, sf_dir):
    f = features_numeric(o_profile(spark, sf_dir), "entity_id", PCA2)
    return pca_explained(f, 2).withColumn("explained_variance_ratio", F.round("explained_variance_ratio", 6))


@query("pca_two_features", with_o(f""",
z AS (SELECT entity_id, {_z_sql(PCA2, nd=15)} FROM profile),
c AS (SELECT corr({PCA2[0]}, {PCA2[1]}) AS r FROM profile)
SELECT entity_id,
  round(CASE WHEN (SELECT r FROM c) >= 0 THEN ({PCA2[0]} + {PCA2[1]}) ELSE ({PCA2[0]} - {PCA2[1]}) END / sqrt(2), 6)
    AS pc1,
  round(CASE WHEN (SELECT r FROM c) >= 0 THEN ({PCA2[0]} - {PCA2[1]}) ELSE ({PCA2[0]} + {PCA2[1]}) END / sqrt(2), 6)
    AS pc2
FROM z
"""))
def q_pca_two_features(spark, sf_dir):
    f = features_numeric(o_profile(spark, sf_dir), "entity_id", PCA2)
    pr = pca_project(f, 2)
    return pr.select("entity_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("cluster_radar_given", with_o(""",
m AS (SELECT region AS cluster, avg(urgent) AS urgent, avg(high) AS high, avg(total_with) AS total_with
      FROM profile GROUP BY region)
SELECT cluster, """ + _z_sql(["urgent", "high", "total_with"], "m") + """ FROM m
"""))
def q_cluster_radar_given(spark, sf_dir):
    p = fx.profile_o(spark, sf_dir).withColumnRenamed("region", "cluster")
    r = C.cluster_radar(p, ["urgent", "high", "total_with"])
    return r.select("cluster", *[F.round(m, 6).alias(m) for m in ["urgent", "high", "total_with"]])


@query("nested_counts", with_o("""
SELECT 'segment' AS level1, segment AS value1, 'region' AS level2, region AS value2, count(*) AS count
  FROM profile WHERE segment IS NOT NULL AND region IS NOT NULL GROUP BY segment, region
UNION ALL
SELECT 'status', status, 'member', CAST(member AS VARCHAR), count(*)
  FROM profile WHERE status IS NOT NULL AND member IS NOT NULL GROUP BY status, member
UNION ALL
SELECT 'region', region, 'nation', nation, count(*)
  FROM profile WHERE region IS NOT NULL AND nation IS NOT NULL GROUP BY region, nation
"""))
def q_nested_counts(spark, sf_dir):
    out = C.nested_counts(fx.profile_o(spark, sf_dir), [("segment", "region"), ("status", "member"),
                                                        ("region", "nation")])
    return out.withColumn("value2", F.when(F.col("level2") == "member", F.lower("value2")).otherwise(F.col("value2")))


# Cluster tables on given labels: the nearest of the literal centres.  These are the tables of
# the cluster analyses without the fit, so SQL can express them.

GIVEN_SQL = """,
d AS (SELECT *,
   urgent * urgent + high * high AS d0,
   (urgent - 150000.0) * (urgent - 150000.0) + (high - 150000.0) * (high - 150000.0) AS d1,
   (urgent - 300000.0) * (urgent - 300000.0) + (high - 50000.0) * (high - 50000.0) AS d2 FROM peers),
g AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d),
tc AS (SELECT cluster FROM g WHERE entity_id = (SELECT id FROM target))
"""


def _given(spark, sf_dir):
    _, peers, target = o_peers(spark, sf_dir)
    return assign_nearest(peers, NEAREST_CENTRES, columns=["urgent", "high"]), target


@query("cluster_members_given", with_o(GIVEN_SQL + "SELECT cluster, entity_id, entity_name, total_with / 1000.0 AS total_with FROM g"))
def q_cluster_members_given(spark, sf_dir):
    return C.cluster_members(_given(spark, sf_dir)[0], "entity_id", "entity_name", "total_with")


@query("cluster_summary_given", with_o(GIVEN_SQL + """,
e AS (SELECT quantile_cont(total_without, 0.25) AS q1, quantile_cont(total_without, 0.5) AS q2,
             quantile_cont(total_without, 0.75) AS q3 FROM g)
SELECT cluster, entity_id, entity_name, '$' || format('{:,}', CAST(floor(total_without) AS BIGINT)) AS total_funding,
  CASE WHEN total_without <= q1 THEN 1 WHEN total_without <= q2 THEN 2 WHEN total_without <= q3 THEN 3 ELSE 4 END AS funding_quartile,
  row_number() OVER (PARTITION BY cluster ORDER BY total_without DESC NULLS LAST, entity_id) AS rank_in_cluster
FROM g, e
"""))
def q_cluster_summary_given(spark, sf_dir):
    """C12 (amounts floored before they become text, so that no rounding rule decides)."""
    g = quantile_bin(_given(spark, sf_dir)[0], ["total_without"], index=True)
    whole = g.withColumn("amount", F.floor("total_without").cast("double")).withColumn("order", col("total_without"))
    ranked = C.cluster_summary(whole.drop("total_without").withColumnRenamed("order", "total_without"), "entity_id", "entity_name",
                               "total_without", "total_without_quartile", shown="amount")
    return ranked


@query("cluster_sizes_given", with_o(GIVEN_SQL + "SELECT cluster, count(*) AS size FROM g GROUP BY cluster"))
def q_cluster_sizes_given(spark, sf_dir):
    """C14: the size of every cluster."""
    return C.cluster_sizes(_given(spark, sf_dir)[0])


@query("target_cluster_given", with_o(GIVEN_SQL + """
SELECT g.cluster, count(*) OVER () AS cluster_size, row_number() OVER (ORDER BY total_with, entity_id) AS position,
       entity_id, entity_name, total_with
FROM g JOIN tc ON g.cluster = tc.cluster QUALIFY position <= 5
"""))
def q_target_cluster_given(spark, sf_dir):
    g, target = _given(spark, sf_dir)
    return C.target_cluster(g, "entity_id", target, "entity_name", by="total_with")


@query("cluster_card_given", with_o(GIVEN_SQL + """,
inside AS (SELECT g.* FROM g JOIN tc ON g.cluster = tc.cluster),
lng AS (SELECT 'segment' AS variable, segment AS value FROM inside WHERE segment IS NOT NULL
        UNION ALL SELECT 'region', region FROM inside WHERE region IS NOT NULL
        UNION ALL SELECT 'status', status FROM inside WHERE status IS NOT NULL),
cnt AS (SELECT variable, value, count(*) AS n FROM lng GROUP BY 1, 2),
md AS (SELECT variable, value FROM cnt QUALIFY row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) = 1)
SELECT (SELECT cluster FROM tc) AS cluster, (SELECT value FROM md WHERE variable = 'segment') AS segment,
       (SELECT value FROM md WHERE variable = 'region') AS region, (SELECT value FROM md WHERE variable = 'status') AS status,
       round(avg(urgent), 4) AS urgent, round(avg(total_with), 4) AS total_with FROM inside
"""))
def q_cluster_card_given(spark, sf_dir):
    g, target = _given(spark, sf_dir)
    card = C.cluster_card(g, "entity_id", target, ["segment", "region", "status"], ["urgent", "total_with"])
    return card.withColumns({m: r4(m) for m in ("urgent", "total_with")})


@query("cluster_box_given", with_o(GIVEN_SQL + """,
q AS (SELECT cluster, quantile_cont(total_with, 0.25) AS q1, quantile_cont(total_with, 0.5) AS median,
             quantile_cont(total_with, 0.75) AS q3 FROM g GROUP BY cluster),
b AS (SELECT g.cluster, 'total_with' AS metric, count(*) AS n, round(avg(total_with), 4) AS mean, min(total_with) AS min, max(total_with) AS max,
             min(total_with) FILTER (WHERE total_with >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
             max(total_with) FILTER (WHERE total_with <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
             count(*) FILTER (WHERE total_with < q1 - 1.5 * (q3 - q1) OR total_with > q3 + 1.5 * (q3 - q1)) AS n_outliers
      FROM g JOIN q ON g.cluster = q.cluster GROUP BY g.cluster)
SELECT b.*, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, (SELECT cluster FROM tc) AS target_cluster,
       (SELECT total_with FROM g WHERE entity_id = (SELECT id FROM target)) AS target_value
FROM b JOIN q ON b.cluster = q.cluster
"""))
def q_cluster_box_given(spark, sf_dir):
    g, target = _given(spark, sf_dir)
    return _round_box(C.cluster_box(g, "total_with", "entity_id", target))


@query("cluster_scatter_given", with_o(GIVEN_SQL + "SELECT entity_id, entity_name, urgent, high, cluster, total_with FROM g"))
def q_cluster_scatter_given(spark, sf_dir):
    return C.cluster_scatter(_given(spark, sf_dir)[0], "entity_id", "entity_name", "total_with", pcs=("urgent", "high"))


@query("lloyd_steps", with_o("""
, x AS (SELECT entity_id, urgent / 1000.0 AS u, high / 1000.0 AS h FROM profile),
""" + ",\n".join(f"""
a{i} AS (SELECT x.*, arg_min(c, (x.u - cu) * (x.u - cu) + (x.h - ch) * (x.h - ch)) AS c FROM x, {prev} GROUP BY ALL),
m{i} AS (SELECT c, avg(u) AS cu, avg(h) AS ch FROM a{i} GROUP BY c)""" for i, prev in (
    (1, "(VALUES (0, 0.0, 0.0), (1, 150.0, 150.0), (2, 300.0, 50.0)) v(c, cu, ch)"), (2, "m1"), (3, "m2"))) + """
SELECT c AS cluster, round(cu, 6) AS urgent, round(ch, 6) AS high FROM m3
""".replace("\n, x AS", ",\nx AS", 1)).replace("\n, x AS", ",\nx AS", 1))
def q_lloyd_steps(spark, sf_dir):
    """M3: three Lloyd steps from given centres, in the batched loop of the fits."""
    import numpy as np

    p = fx.profile_o(spark, sf_dir).select(F.array(F.col("urgent") / 1000, F.col("high") / 1000).alias("x"))
    fit = lloyd(cut_lineage(p), [Fit(3, 0, np.array(NEAREST_CENTRES) / 1000)], max_iter=3, tol=0.0)[0]
    return spark.createDataFrame([(i, round(float(u), 6), round(float(h), 6)) for i, (u, h) in enumerate(fit.centres)],
                                 "cluster int, urgent double, high double")


@query("quantiles_by_group_null", with_o("""
, s AS (SELECT CASE WHEN region = 'ASIA' THEN NULL ELSE region END AS region, urgent FROM profile)
""".replace("\n, s AS", ",\ns AS", 1) + " UNION ALL ".join(
    f"SELECT region, 'urgent' AS variable, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(urgent, {p}), 6) AS value, count(urgent) AS n FROM s GROUP BY region"
    for p in (0.1, 0.5, 0.9))))
def q_quantiles_by_group_null(spark, sf_dir):
    """A17 by a group column that holds NULL."""
    p = fx.profile_o(spark, sf_dir).withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    return quantiles_long(p, ["urgent"], [0.1, 0.5, 0.9], by=["region"]).withColumn("value", F.round("value", 6))


@query("quantiles_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS value, count({c}) AS n FROM lineitem"
    for c in ("l_extendedprice", "l_quantity") for p in (0.01, 0.5, 0.999)))
def q_quantiles_lineitem(spark, sf_dir):
    """A17 over all line items."""
    out = quantiles_long(fx.table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.999])
    return out.withColumn("value", F.round("value", 6))


@query("median_impute_int", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 2 + o_orderkey % 2 END AS x FROM orders)
SELECT o_orderkey, coalesce(CAST(x AS DOUBLE), (SELECT quantile_cont(x, 0.5) FROM o)) AS x FROM o
""")
def q_median_impute_int(spark, sf_dir):
    """X8 on an integer column: the median may lie between two integers."""
    k = F.col("o_orderkey")
    o = fx.table(spark, sf_dir, "orders").select(k, F.when(k % 3 != 0, k * 2 + k % 2).alias("x"))
    return median_impute(o, ["x"])


# 12. Model fits (no SQL form: rows-only in the driver, invariants in the tests) -------------

# Numeric clustering runs on the "active features": every source except the agriculture and
# non-federal analogues, i.e. the columns of total_without.
CLUSTER_METRICS = fx.O_TOTAL_WITHOUT
MIXED_CATEGORICAL = ["segment", "region", "status"]


def _clustered(spark, sf_dir, k: int = 4, restarts: int = 10, project: bool = False):
    prof, peers, target = o_peers(spark, sf_dir)
    table = C.cluster_profile_table(peers, "entity_id", CLUSTER_METRICS, k, restarts=restarts, project=project)
    return table, target


def _clustered_mixed(frame: DataFrame, k: int = 3, restarts: int = 1) -> DataFrame:
    """Mixed features (all metrics median-filled and standardised, categorical attributes
    one-hot), k-means with the library default of one run, two components."""
    feats = features_mixed(frame, "entity_id", fx.O_ALL_METRICS, MIXED_CATEGORICAL)
    clustered = kmeans(C.vectors_once(feats, "entity_id"), k, restarts=restarts)
    side = pca_project(clustered, 2).select("entity_id", "cluster", "pc1", "pc2")
    return frame.join(side, "entity_id")


@query("elbow")
def q_elbow(spark, sf_dir):
    """M4 on the active features: k = 1..10, 10 restarts each."""
    _, peers, _ = o_peers(spark, sf_dir)
    f = features_numeric(peers, "entity_id", CLUSTER_METRICS)
    return elbow(f, range(1, 11), restarts=10)


@query("elbow_mixed")
def q_elbow_mixed(spark, sf_dir):
    """M4 on the mixed features: k = 2 .. min(10, n - 1) - 1, one run each."""
    _, peers, _ = o_peers(spark, sf_dir)
    f = features_mixed(peers, "entity_id", fx.O_ALL_METRICS, MIXED_CATEGORICAL)
    n = peers.count()
    return elbow(f, range(2, min(10, n - 1)), restarts=1)


@query("kmeans_clusters")
def q_kmeans_clusters(spark, sf_dir):
    t, _ = _clustered(spark, sf_dir)
    return t.select("entity_id", "cluster")


@query("cluster_members")
def q_cluster_members(spark, sf_dir):
    t, _ = _clustered(spark, sf_dir)
    return C.cluster_members(t, "entity_id", "entity_name", "total_with")


@query("cluster_summary")
def q_cluster_summary(spark, sf_dir):
    t, _ = _clustered(spark, sf_dir)
    t = quantile_bin(t, ["total_without"])
    return C.cluster_summary(t, "entity_id", "entity_name", "total_without", "total_without_quartile")


@query("cluster_scatter")
def q_cluster_scatter(spark, sf_dir):
    t, _ = _clustered(spark, sf_dir, project=True)
    return C.cluster_scatter(t, "entity_id", "entity_name", "total_with")


@query("target_cluster")
def q_target_cluster(spark, sf_dir):
    """C14 on the mixed clustering of the peers (k = 3)."""
    _, peers, target = o_peers(spark, sf_dir)
    return C.target_cluster(_clustered_mixed(peers), "entity_id", target, "entity_name")


def _r1_cohort(spark, sf_dir):
    p = C.recode_designation(o_profile(spark, sf_dir), "status", "F")
    r1 = cut_lineage(p.where(F.col("designation") == "R1"))
    target = r1.where(~F.col("member")).agg(F.min("entity_id")).scalar()
    return r1, target


@query("cluster_card")
def q_cluster_card(spark, sf_dir):
    """The target's cluster in the R1 cohort's mixed clustering: modal attributes and
    mean metrics."""
    r1, target = _r1_cohort(spark, sf_dir)
    return C.cluster_card(_clustered_mixed(r1), "entity_id", target, MIXED_CATEGORICAL, fx.O_ALL_METRICS)


@query("cluster_box")
def q_cluster_box(spark, sf_dir):
    t, target = _clustered(spark, sf_dir)
    return C.cluster_box(t, "total_without", "entity_id", target)


@query("cluster_radar")
def q_cluster_radar(spark, sf_dir):
    t, _ = _clustered(spark, sf_dir)
    return C.cluster_radar(t, CLUSTER_METRICS)


@query("analyse_cohort")
def q_analyse_cohort(spark, sf_dir):
    p = C.recode_designation(o_profile(spark, sf_dir), "status", "F")
    return C.analyse_cohort(p, "designation", "R1", "entity_id", "entity_name", fx.O_METRICS,
                            {"total_with": fx.O_TOTAL_WITH, "total_without": fx.O_TOTAL_WITHOUT},
                            MIXED_CATEGORICAL, k=3)


@query("cohort_features", with_o(""",
cohort AS (SELECT * FROM profile WHERE status = 'F')
SELECT entity_id, """ + _z_sql(fx.O_ALL_METRICS, "cohort") + ", "
    + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, values in {
        "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "status": ["F"]}.items() for v in values)
    + " FROM cohort"))
def q_cohort_features(spark, sf_dir):
    """C19 up to the fit: the R1 cohort's totals and mixed features."""
    p = C.recode_designation(o_profile(spark, sf_dir), "status", "F")
    _, feats = C.cohort_features(p, "designation", "R1", "entity_id", fx.O_METRICS,
                                 {"total_with": fx.O_TOTAL_WITH, "total_without": fx.O_TOTAL_WITHOUT}, MIXED_CATEGORICAL)
    return feats.select("entity_id", *[F.round(c, 6).alias(c) if c in fx.O_ALL_METRICS else F.col(f"`{c}`")
                                       for c in feature_columns(feats, "entity_id")])


@query("kmeans_vectors")
def q_kmeans_vectors(spark, sf_dir):
    """M3 + M5 on the 64-dimensional embeddings."""
    from pyspark.ml.functions import array_to_vector
    e = fx.table(spark, sf_dir, "embeddings")
    v = e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    clustered = kmeans(v, 10)
    return pca_project(clustered, 2).select("vec_id", "label", "cluster", "pc1", "pc2")


# 13. Remaining inventory operators, each on whole tables ----------------------------------

@query("strip_suffix", "WITH " + REGISTRY_LONG_SQL.strip() + """
SELECT entity_id, entity_name, "Quantity (units)", "Orders", year FROM reglong
""")
def q_strip_suffix(spark, sf_dir):
    """P2 + P1 + P4: each year's block of the wide registry with its suffix stripped and its year
    as a constant column, stacked."""
    reg = fx.registry_wide_l(spark, sf_dir)
    blocks = []
    for year in year_blocks(reg.columns):  # X1 on the column names: no job
        block = [c for c in reg.columns if c.endswith(f"(HD{year})")]
        blocks.append(add_literal(strip_suffix(order_columns(reg, ["entity_id", "entity_name"], block)), "year", year))
    return concat_diagonal(blocks)


@query("diagonal_union", "WITH " + REGISTRY_LONG_SQL.strip() + """
SELECT entity_id, entity_name, year, "Quantity (units)",
       CASE WHEN year = (SELECT max(year) FROM yrs) THEN NULL ELSE "Orders" END AS "Orders" FROM reglong
""")
def q_diagonal_union(spark, sf_dir):
    """The union form of wide to long, on a registry whose newest year lacks an attribute."""
    reg = fx.registry_wide_l(spark, sf_dir)
    newest = max(year_blocks(reg.columns))
    reg = reg.drop(f"Orders (HD{newest})")
    return wide_years_to_long(reg, ["entity_id", "entity_name"], method="union").select(
        "entity_id", "entity_name", "year", "Quantity (units)", "Orders")


@query("split_target", with_o("""
SELECT 'target' AS part, count(*) AS n, round(sum(total_with), 4) AS total_with FROM profile
  WHERE entity_id = (SELECT id FROM target)
UNION ALL
SELECT 'others', count(*), round(sum(total_with), 4) FROM profile WHERE entity_id <> (SELECT id FROM target)
"""))
def q_split_target(spark, sf_dir):
    """the target's rows and everyone else's, summarised side by side."""
    prof = o_profile(spark, sf_dir)
    t, others = split_target(prof, "entity_id", o_target(prof))
    agg = [F.count(F.lit(1)).alias("n"), F.round(F.sum("total_with"), 4).alias("total_with")]
    return t.agg(*agg).select(F.lit("target").alias("part"), "*").unionByName(
        others.agg(*agg).select(F.lit("others").alias("part"), "*"))


@query("exclude_outlier", with_o("""
SELECT entity_id, total_with FROM profile WHERE entity_id <> (SELECT id FROM outlier)
"""))
def q_exclude_outlier(spark, sf_dir):
    """leave the outlier out."""
    prof = o_profile(spark, sf_dir)
    return exclude(prof, "entity_id", o_outlier(prof)).select("entity_id", "total_with")


@query("in_list", """
SELECT o_orderkey, o_orderpriority, o_orderpriority IN ('1-URGENT', '2-HIGH') AS listed FROM orders
WHERE o_orderstatus IN ('F', 'O')
""")
def q_in_list(spark, sf_dir):
    """F5 with a short literal list (pushed into the scan as an IN filter)."""
    o = in_values(fx.table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])
    return o.select("o_orderkey", "o_orderpriority", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("listed"))


@query("not_in_table", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 100000)
""")
def q_not_in_table(spark, sf_dir):
    """F5 for a list of any length: anti join against a one-column table (customers with
    no order above 100,000)."""
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    big = fx.table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 100000).select("o_custkey")
    return in_table(c, "c_custkey", big, negate=True)


@query("join_suffix", with_l(L_YEARLY_SQL.strip() + """,
sup AS (SELECT s_suppkey AS entity_id, s_name || ' (registry)' AS entity_name, s_acctbal FROM supplier)
SELECT y.entity_id, y.entity_name, y.year, y.amount, s.entity_name AS entity_name_registry, s.s_acctbal
FROM yearly y LEFT JOIN sup s ON y.entity_id = s.entity_id
"""))
def q_join_suffix(spark, sf_dir):
    """Left join on a shared key; the clashing right column keeps a suffix."""
    sup = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("entity_id"), F.concat("s_name", F.lit(" (registry)")).alias("entity_name"),
        "s_acctbal")
    return left_join_suffix(_l_yearly(spark, sf_dir), sup, "entity_id", suffix="_registry")


@query("value_counts", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment")
def q_value_counts(spark, sf_dir):
    """A8."""
    return value_counts(fx.table(spark, sf_dir, "customer"), "c_mktsegment")


@query("rollup_by_region", with_o("""
SELECT region, 'mean' AS method, round(avg(urgent), 4) AS urgent, round(avg(total_with), 4) AS total_with
  FROM profile WHERE region IS NOT NULL GROUP BY region
UNION ALL
SELECT region, 'sum', round(sum(urgent), 4), round(sum(total_with), 4)
  FROM profile WHERE region IS NOT NULL GROUP BY region
"""))
def q_rollup_by_region(spark, sf_dir):
    """Mean or sum by a group, NULL groups dropped."""
    prof = fx.profile_o(spark, sf_dir)
    parts = []
    for how, label in (("mean", "mean"), ("sum", "sum")):
        r = rollup_by(prof, "region", ["urgent", "total_with"], how=how)
        parts.append(r.select("region", F.lit(label).alias("method"), r4("urgent").alias("urgent"),
                              r4("total_with").alias("total_with")))
    return parts[0].unionByName(parts[1])


@query("cohort_means", with_o("""
SELECT round(avg(urgent), 4) AS urgent, round(avg(total_with), 4) AS total_with FROM profile WHERE member
"""))
def q_cohort_means(spark, sf_dir):
    """A12 over one cohort (no grouping: one row)."""
    m = cohort_means(fx.profile_o(spark, sf_dir).where("member"), ["urgent", "total_with"])
    return m.select(r4("urgent").alias("urgent"), r4("total_with").alias("total_with"))


@query("medians", with_o(""",
m AS (SELECT """ + ", ".join(f"quantile_cont({m}, 0.5) AS {m}" for m in fx.O_ALL_METRICS) + """ FROM profile)
SELECT """ + ", ".join(f"round({m}, 6) AS {m}" for m in fx.O_ALL_METRICS) + """ FROM m
"""))
def q_medians(spark, sf_dir):
    """Exact medians of every metric."""
    m = median(o_profile(spark, sf_dir), fx.O_ALL_METRICS)
    return m.select(*[F.round(c, 6).alias(c) for c in fx.O_ALL_METRICS])


@query("cut_points_wide", with_o("""
SELECT """ + ", ".join(f"round(quantile_cont({m}, {p}), 6) AS \"{m}_{n}\"" for m in ["urgent", "total_with"]
                       for p, n in [(0.2, "p20"), (0.8, "p80")]) + """ FROM profile
"""))
def q_cut_points_wide(spark, sf_dir):
    """A17 in the wide form: one row, a column per metric and probability."""
    c = cut_points(o_profile(spark, sf_dir), ["urgent", "total_with"], [0.2, 0.8], names=["p20", "p80"])
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query("box_outliers", with_o(""",
lng AS (SELECT entity_id, 'urgent' AS metric, urgent AS value FROM profile WHERE urgent IS NOT NULL
        UNION ALL SELECT entity_id, 'total_with', total_with FROM profile WHERE total_with IS NOT NULL),
q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY metric)
SELECT l.entity_id, l.metric, l.value FROM lng l JOIN q ON l.metric = q.metric
WHERE l.value < q1 - 1.5 * (q3 - q1) OR l.value > q3 + 1.5 * (q3 - q1)
"""))
def q_box_outliers(spark, sf_dir):
    """A19 points: the entities outside the whiskers, per metric."""
    return box_outliers(o_profile(spark, sf_dir), "entity_id", ["urgent", "total_with"])


@query("preview_sorted", with_o("""
SELECT entity_id, entity_name, total_without FROM profile ORDER BY total_without, entity_id LIMIT 5
"""))
def q_preview_sorted(spark, sf_dir):
    """O4 after O1: the first rows of a sorted profile (the smallest totals)."""
    prof = fx.profile_o(spark, sf_dir).select("entity_id", "entity_name", "total_without")
    return preview(sort_by(prof, ["total_without", "entity_id"]), 5)


@query("registry_stability", "WITH " + REGISTRY_LONG_SQL.strip() + """
SELECT entity_id, entity_name, count(DISTINCT "Quantity (units)") AS "Quantity (units)_unique_count",
       count(DISTINCT "Orders") AS "Orders_unique_count"
FROM reglong GROUP BY entity_id, entity_name
""")
def q_registry_stability(spark, sf_dir):
    """C2 on the registry itself: distinct non-NULL values of each attribute over the years,
    per entity (the attributes are found from the column names of the long form)."""
    long = wide_years_to_long(fx.registry_wide_l(spark, sf_dir), ["entity_id", "entity_name"])
    return C.attribute_stability(long, ["entity_id", "entity_name"])



@query("panel_reread", ORACLE["build_panel"])
def q_panel_reread(spark, sf_dir):
    """The whole panel, written by year and read again: every year and every column."""
    import uuid

    from ..session import scratch_path
    from ..sources.files import read_panel, write_panel

    panel = QUERIES["build_panel"](spark, sf_dir)
    path = scratch_path(spark, f"panel-{uuid.uuid4().hex}")
    write_panel(panel, path)
    out = cut_lineage(read_panel(spark, path).select(panel.columns))
    _delete(spark, path)
    return out


@query("panel_roundtrip", with_l(REGISTRY_LONG_SQL.strip() + f""",
fixed AS (
  SELECT coalesce(o.entity_id, TRY_CAST(f.entity_id_raw AS BIGINT)) AS entity_id, f.entity_name, f.year,
         f.source, f.amount
  FROM funding f LEFT JOIN overrides o ON f.entity_name = o.entity_name),
wide AS (
  SELECT year, entity_name, entity_id,
{_types_filter("max")}
  FROM fixed WHERE entity_id IS NOT NULL GROUP BY year, entity_name, entity_id),
clubbed AS (
  SELECT entity_id, year, min(entity_name) AS entity_name,
{",".join(chr(10) + f"    coalesce(sum(\"{t}\"), 0) AS \"{t}\"" for t in fx.PART_TYPES)}
  FROM wide GROUP BY entity_id, year)
SELECT r.entity_id, r.year, r."Quantity (units)",
{",".join(chr(10) + f"  CAST(c.\"{t}\" AS DOUBLE) AS \"{t}\"" for t in fx.PART_TYPES)}
FROM reglong r JOIN clubbed c ON r.entity_id = c.entity_id AND r.year = c.year
WHERE r.year = (SELECT max(year) FROM yrs)
"""))
def q_panel_roundtrip(spark, sf_dir):
    """S4 + S5: write the panel partitioned by year into the shared folder, re-read only
    the latest year (partition pruning: the other years' files are never opened)."""
    import uuid

    from ..session import scratch_path
    from ..sources.files import read_panel, write_panel

    panel = C.build_panel(fx.funding_l(spark, sf_dir), fx.overrides_l(spark, sf_dir),
                          fx.registry_wide_l(spark, sf_dir), fx.classes_l(spark, sf_dir),
                          fx.members_l(spark, sf_dir), sources=fx.PART_TYPES, sort=False)
    path = scratch_path(spark, f"panel-{uuid.uuid4().hex}")
    write_panel(panel, path)
    years = [int(p.split("=")[1]) for p in _partition_dirs(spark, path, "year")]
    back = read_panel(spark, path, years=[max(years)])
    out = cut_lineage(_double_metrics(back.select("entity_id", "year", "Quantity (units)", *fx.PART_TYPES), fx.PART_TYPES))
    _delete(spark, path)
    return out


def _delete(spark, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def _partition_dirs(spark, path: str, column: str) -> list[str]:
    """Partition directory names under ``path`` (listed through Hadoop, so it works on any
    file system the cluster uses)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath().getName() for st in fs.listStatus(hpath)
            if st.isDirectory() and st.getPath().getName().startswith(column + "=")]


@query("headerless_sheet", "SELECT CAST(doc_id AS VARCHAR) AS id, source, lang, text FROM documents")
def q_headerless_sheet(spark, sf_dir):
    """S3: the documents as sheets without header, two title lines a file, line ends and quotes inside of fields, read back."""
    d = fx.table(spark, sf_dir, "documents")
    fields = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in ["source", "lang", "text"]]
    line = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *[F.coalesce(f, F.lit("")) for f in fields])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1)) == 0  # of its file
    path = scratch_path(spark, f"sheet-{uuid.uuid4().hex}")
    d.select(F.concat(F.when(first, F.lit("Documents\nid, source, language, text\n")).otherwise(F.lit("")), line)).write.text(path)
    return read_headerless(spark, path, ["id", "source", "lang", "text"], skip_rows=2)
