"""Domain tables derived from the driver's test tables (FIXTURES.md section 2).

Two mappings of the panel domain onto the TPC-H-like tables:

* **[L]** entity = supplier, year = year of ``l_shipdate``, funding source =
  ``p_type``, amount = ``l_extendedprice``; registry attributes from line
  quantities and order counts by year; classification = nation and region.
* **[O]** entity = customer, year = year of ``o_orderdate``, source =
  ``o_orderpriority``, amount = ``o_totalprice``; attributes are the market
  segment, nation, region and the latest order status.

Every table here is a lazy plan over the given tables, so its work grows with
them.  Money is summed as ``decimal(18,2)`` (the prices have two decimals),
which makes sums exact and independent of row order.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import entity_profile
from ..operators.columns import row_total
from ..operators.joins import bounded, flag_members
from ..session import cut_lineage
from ..sources.files import cast_lenient, read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings")

# Fixed values of the mapping ------------------------------------------------
# [O] funding sources: order priority -> short metric name.
PRIORITY_NAMES = {
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "not_specified",
    "5-LOW": "low",
}
O_METRICS = list(PRIORITY_NAMES.values())
# "Total with": every source but the non-federal analogue (not_specified);
# "Total without" also leaves out the agriculture analogue (low).
O_TOTAL_WITH = ["urgent", "high", "medium", "low"]
O_TOTAL_WITHOUT = ["urgent", "high", "medium"]
O_ALL_METRICS = O_METRICS + ["total_with", "total_without"]
# [L] funding sources: part types.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# Member cohorts: entities of one region, listed by name.
MEMBER_REGION_O = "AMERICA"
MEMBER_REGION_L = "EUROPE"
# [L] key damage: key missing when divisible by 7; half of those (divisible by 14)
# are repaired by the override table; keys with remainder 5 modulo 11 are written as
# malformed text.  These spoil values, they never drop or sample rows.
MISSING_KEY_EVERY = 7
OVERRIDE_EVERY = 14


_TABLES: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy scan of one test table.  The handle (a plan, not data) is reused within a
    session, so the file listing and footer read happen once per table."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (id(spark), path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = read_table(spark, path)
    return df


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in TABLES}


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> (nation name, region name): 25 rows, a closed dimension."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(bounded(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


# [O] ------------------------------------------------------------------------

def funding_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding in long form: one row per order (entity, year, source, amount)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("entity_id"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderkey"),
        F.col("o_orderstatus"))


def customers_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    g = _geo(spark, sf_dir)
    return c.join(bounded(g), c.c_nationkey == g.n_nationkey).select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"),
        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def members_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member list: names of the customers of one region."""
    return customers_o(spark, sf_dir).where(F.col("region") == MEMBER_REGION_O).select("entity_name")


def _yearly_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = funding_o(spark, sf_dir)
    aggs = [F.coalesce(F.sum(F.when(F.col("source") == src, F.col("amount"))), F.lit(0)).alias(name)
            for src, name in PRIORITY_NAMES.items()]
    aggs.append(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return f.groupBy("entity_id", "year").agg(*aggs)


def customers_flagged_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer attributes with the member flag (J5 applied to the dimension: one row per
    customer instead of one per customer and year)."""
    return flag_members(customers_o(spark, sf_dir), members_o(spark, sf_dir), "entity_name", "entity_id",
                        out="member")


def panel_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x year panel: one amount per priority (0 when none), the year's latest order
    status (by order key), customer attributes and the member flag."""
    return _yearly_o(spark, sf_dir).join(customers_flagged_o(spark, sf_dir), on="entity_id")


def profile_o(spark: SparkSession, sf_dir: str, totals: bool = True) -> DataFrame:
    """Customer profile: latest attributes, mean amount per priority over the customer's
    panel years (as double), and the two totals.

    The order facts are rolled up first (A4 with the one attribute that changes by
    year, the status) and the static customer attributes are joined once afterwards:
    the latest value of an attribute that never changes is that value, so this is
    the panel profile with a narrower aggregate.
    """
    p = entity_profile(_yearly_o(spark, sf_dir), "entity_id", ["status"], O_METRICS, order="year")
    p = p.join(customers_flagged_o(spark, sf_dir), on="entity_id")
    if totals:
        p = row_total(p, "total_with", O_TOTAL_WITH)
        p = row_total(p, "total_without", O_TOTAL_WITHOUT)
    return p


# [L] ------------------------------------------------------------------------

def lineitem_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with supplier, year and part type."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey"), F.col("l_orderkey"), F.year("l_shipdate").cast("int").alias("year"),
        F.col("p_type"), F.col("l_quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


def funding_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding in long form, one row per (supplier, year, part type): the entity id is text,
    missing for every seventh key and malformed for some others."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    cells = (lineitem_l(spark, sf_dir).groupBy("l_suppkey", "year", "p_type")
             .agg(F.sum("amount").alias("amount")))
    k = F.col("s_suppkey")
    raw = (F.when(k % MISSING_KEY_EVERY == 0, F.lit(None).cast("string"))
           .when(k % 11 == 5, F.concat(F.lit("id-"), k.cast("string")))
           .otherwise(k.cast("string")))
    return cells.join(s, cells.l_suppkey == s.s_suppkey).select(
        raw.alias("entity_id_raw"), F.col("s_name").alias("entity_name"), "year",
        F.col("p_type").alias("source"), "amount")


def overrides_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing-key overrides: (name, id) for half of the suppliers whose key is missing."""
    s = table(spark, sf_dir, "supplier")
    return s.where(F.col("s_suppkey") % OVERRIDE_EVERY == 0).select(
        F.col("s_name").alias("entity_name"), F.col("s_suppkey").alias("entity_id"))


def members_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    g = _geo(spark, sf_dir)
    return (s.join(bounded(g), s.s_nationkey == g.n_nationkey).where(F.col("r_name") == MEMBER_REGION_L)
            .select(F.col("s_name").alias("entity_name")))


def registry_wide_l(spark: SparkSession, sf_dir: str, years: list[int] | None = None) -> DataFrame:
    """Registry, wide by year: ``Quantity (units) (HD<year>)`` for every year and
    ``Orders (HD<year>)`` for every year but the last (an attribute missing in one year,
    and one whose name holds parentheses).

    One (supplier, year) aggregate first (a single distinct count per group, so no row
    is expanded once per year), materialised: the year list (the registry's column
    names, a plan-time fact) and the pivot both read that small table, not the line
    items again.
    """
    li = lineitem_l(spark, sf_dir)
    per_year = cut_lineage(li.groupBy("l_suppkey", "year").agg(F.sum("l_quantity").alias("q"),
                                                               F.count_distinct("l_orderkey").alias("n")))
    if years is None:
        years = [r[0] for r in per_year.select("year").distinct().orderBy("year").collect()]
    aggs = []
    for y in sorted(years):
        aggs.append(F.max(F.when(F.col("year") == y, F.col("q"))).alias(f"Quantity (units) (HD{y})"))
        if y != max(years):
            aggs.append(F.coalesce(F.max(F.when(F.col("year") == y, F.col("n"))), F.lit(0))
                        .alias(f"Orders (HD{y})"))
    reg = per_year.groupBy("l_suppkey").agg(*aggs)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return reg.join(s, reg.l_suppkey == s.s_suppkey).select(
        F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"),
        *[F.col(f"`{c}`") for c in reg.columns if c != "l_suppkey"])


def classes_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification: one row per supplier, keyed ``unitid``, with nation and region
    (and name/city/state columns that the panel build drops)."""
    s = table(spark, sf_dir, "supplier")
    g = _geo(spark, sf_dir)
    return s.join(bounded(g), s.s_nationkey == g.n_nationkey).select(
        F.col("s_suppkey").alias("unitid"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("city"),
        F.col("n_name").alias("state"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def lenient_ids_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_lenient(funding_l(spark, sf_dir), "entity_id_raw", "bigint", out="entity_id")
