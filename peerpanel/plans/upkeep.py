"""Upkeep of a written panel by change sets.

A panel is clubbed from funding rows and written by year.  When rows are added or corrected, only the touched
(entity, year) keys are clubbed anew; their years are written by dynamic partition overwrite and all other years
keep their files.  A log beside the years tells which years a refresh began and finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._names import col
from ..session import cut_lineage
from ..sources.files import read_panel

LOG = "_rounds"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _rounds(spark: SparkSession, path: str, state: str) -> set[int]:
    fs, at = _folder(spark, f"{path}/{LOG}")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return {int(n.split("-")[1]) for n in names
            if n.startswith(state) and fs.exists(_folder(spark, f"{path}/{LOG}/{n}/_SUCCESS")[1])}


def _unfinished(spark: SparkSession, path: str) -> set[int]:
    """Years of refreshes that began after the last finished one: their files may be old, new or gone."""
    done = max(_rounds(spark, path, "done"), default=-1)
    open_rounds = [n for n in _rounds(spark, path, "begun") if n > done]
    return {r["year"] for n in open_rounds for r in spark.read.schema("year int").json(f"{path}/{LOG}/begun-{n:06d}").collect()}


def round_log(spark: SparkSession, path: str) -> DataFrame:
    """(round, year, rows): the years that each finished refresh wrote, with their rows after it (0: the year went)."""
    paths = [f"{path}/{LOG}/done-{n:06d}" for n in sorted(_rounds(spark, path, "done"))]
    schema = "round int, year int, rows long"
    return spark.read.schema(schema).json(paths) if paths else spark.range(0).selectExpr(
        "CAST(NULL AS int) AS round", "CAST(NULL AS int) AS year", "CAST(NULL AS long) AS rows")


def refresh_panel(rows: DataFrame, changes: DataFrame | None, path: str, build: Callable[[DataFrame], DataFrame],
                  key: str = "entity_id", year: str = "year") -> list[int]:
    """Bring the panel at ``path`` up to ``rows``, all funding rows as they are now; the years written are returned.

    ``changes`` holds the (key, year) of every row that was added, corrected or removed since the last call; a row that
    moved to another key or year is in it with both.  ``None`` builds all years.  ``build`` clubs rows to at most one row per (key, year) and must
    treat keys alone, as ``club`` does.  Rows without key or year take no part, in ``rows`` as in ``changes``.
    Repeated changes, and changes of keys that have no rows, do no harm; a year without rows left goes.

    The years are begun in the log before files change and finished after; a refresh that was cut off is made good by the next
    one, which builds its years in full.  New rows are written to the checkpoint folder before the old files go.
    One refresh of a panel runs at a time.  Years reach the driver, keys and rows do not.
    """
    spark = rows.sparkSession
    rows = rows.dropna(how="any", subset=[key, year])
    whole = _unfinished(spark, path)
    if changes is None:
        panel = read_panel(spark, path).select(year) if _rounds(spark, path, "done") else rows.select(year).limit(0)
        whole |= {r[0] for r in rows.select(year).union(panel).distinct().collect()}
        changes = rows.limit(0)
    touched = cut_lineage(changes.select(col(key), col(year)).dropna().distinct())
    years = sorted(whole | {r[0] for r in touched.select(col(year)).distinct().collect()})
    if not years:
        return []
    number = 1 + max(_rounds(spark, path, "begun") | _rounds(spark, path, "done"), default=-1)
    spark.createDataFrame([(y,) for y in years], "year int").coalesce(1).write.mode("overwrite").json(f"{path}/{LOG}/begun-{number:06d}")

    some = [y for y in years if y not in whole]
    new = build(rows.where(col(year).isin(sorted(whole))).unionByName(
        rows.where(col(year).isin(some)).join(touched, [key, year], "left_semi").select(*[col(c) for c in rows.columns])))
    if some:
        old = read_panel(spark, path, schema=new.schema, years=some, year_col=year)
        new = new.unionByName(old.join(touched, [key, year], "left_anti").select(*[col(c) for c in new.columns]))
    new = cut_lineage(new)
    left = {r[0]: r["n"] for r in new.groupBy(col(year)).agg(F.count(F.lit(1)).alias("n")).collect()}
    (new.hint("rebalance", year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", 5_000_000).partitionBy(year).parquet(path))
    for gone in set(years) - set(left):
        fs, at = _folder(spark, f"{path}/{year}={gone}")
        fs.delete(at, True)
    done = spark.createDataFrame([(number, y, left.get(y, 0)) for y in years], "round int, year int, rows long")
    done.coalesce(1).write.mode("overwrite").json(f"{path}/{LOG}/done-{number:06d}")
    return years
