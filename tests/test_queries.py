"""Every registered query runs on sf0.001; SQL-expressible ones match their DuckDB oracle."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from plan_guard import plan_problems

SQL = {k: v for k, v in E.oracle_sql().items() if not k.startswith("op")}  # those have tests of their own
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings", "documents"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return round(float(v), 6)
    return v


def _sorted(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_with" in df.columns


def test_every_query_has_oracle_or_is_model_fit():
    fits = {"elbow", "elbow_mixed", "kmeans_clusters", "cluster_members", "cluster_summary", "cluster_scatter", "target_cluster",
            "cluster_card", "cluster_box", "cluster_radar", "analyse_cohort", "kmeans_vectors"}
    assert {n for n in set(QUERIES) - set(SQL) if n != "pipeline" and not n.startswith("op")} == fits


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    assert plan_problems(sdf) == []
    scols = sdf.columns
    srows = sdf.collect()
    rel = duck.sql(SQL[name])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in stypes.items()} == dtypes
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    s = _sorted(tuple(r[scols.index(c)] for c in order) for r in srows)
    d = _sorted(tuple(r[dcols.index(c)] for c in order) for r in drows)
    assert s == d


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_queries_run_with_sane_plans(spark, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    assert plan_problems(sdf) == []
    assert sdf.count() > 0


def test_panel_key_is_unique(spark):
    panel = QUERIES["build_panel"](spark, SF_SMALL)
    assert panel.count() == panel.select("entity_id", "year").distinct().count()
