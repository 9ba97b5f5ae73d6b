import pytest

from peerpanel.operators.categories import category_dictionary, features_sparse, one_hot_places
from peerpanel.operators.reshape import one_hot

ROWS = [(1, "b", 10, 0.0), (2, "a", 9, -0.0), (3, None, 100, 2.5), (4, "b", None, None), (4, "b", None, None), (5, "", -3, 7.0)]


def test_ids_in_the_order_of_one_hot(spark):
    df = spark.createDataFrame(ROWS, "k int, s string, code int, x double")
    got = {}
    for r in category_dictionary(df, ["s", "code", "x"]).orderBy("variable", "id").collect():
        got.setdefault(r["variable"], []).append((r["id"], r["value"], r["count"]))
    assert got == {"s": [(0, "", 1), (1, "a", 1), (2, "b", 3)], "code": [(0, "-3", 1), (1, "9", 1), (2, "10", 1), (3, "100", 1)],
                   "x": [(0, "0.0", 2), (1, "2.5", 1), (2, "7.0", 1)]}
    big = spark.createDataFrame([(2**53,), (2**53 + 1,), (-2**63,), (5,)], "v long")
    assert [r["value"] for r in category_dictionary(big, "v").orderBy("id").collect()] == [str(-2**63), "5", str(2**53), str(2**53 + 1)]


def test_places_equal_one_hot(spark):
    df = spark.createDataFrame(ROWS, "k int, s string, code int, x double")
    places, sizes = one_hot_places(df.drop("x"), ["s", "code"])
    assert sizes == {"s": 3, "code": 4} and places.columns == ["k", "places"]
    wide = one_hot(df.drop("x"), ["s", "code"], numeric="encode")
    want = sorted((r[0], [i for i, v in enumerate(r[1:]) if v]) for r in wide.collect())
    assert sorted((r["k"], r["places"]) for r in places.collect()) == want


def test_unknown_values_null_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None)], "k int, s string, n string")
    seen = category_dictionary(df.where("k = 1"), ["s", "n"])
    places, sizes = one_hot_places(df, ["s", "n"], seen)
    assert sizes == {"s": 1, "n": 0} and sorted(tuple(r) for r in places.collect()) == [(1, [0]), (2, [])]
    none, sizes = one_hot_places(df.where("k > 9"), ["s", "n"])
    assert none.count() == 0 and sizes == {"s": 0, "n": 0}


def test_sparse_features_equal_the_mixed_ones(spark):
    df = spark.createDataFrame(ROWS, "k int, s string, code int, x double")
    got = sorted((r["k"], str(r["features"].toArray().tolist())) for r in features_sparse(df, "k", ["x"], ["s", "code"]).collect())
    wide = one_hot(df.select("k", "x", "s", "code"), ["s", "code"], numeric="encode")
    want = sorted((r["k"], str([float("nan") if r["x"] is None else r["x"] + 0.0, *map(float, r[2:])])) for r in wide.collect())
    assert got == want


def test_a_million_values_and_a_hot_one(spark):
    """A third of the rows holds one value, a tenth NULL."""
    df = spark.range(2_000_000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('v', id) END AS s")
    places, sizes = one_hot_places(df, "s")
    n = df.where("s <> 'hot'").count() + 1
    assert sizes == {"s": n} and n > 1_000_000
    got = places.selectExpr("count(*) n", "count_if(size(places) = 0) none", "count(DISTINCT get(places, 0)) ids", "max(get(places, 0)) top").first()
    assert tuple(got) == (2_000_000, df.where("s IS NULL").count(), n, n - 1)
    assert places.where("k % 3 = 0").select("places").distinct().count() == 1


def test_vectors_go_into_the_components(spark):
    from peerpanel.operators.cluster import pca_explained

    df = spark.createDataFrame([(i, f"c{i % 5}", f"d{i % 3}") for i in range(60)], "k int, s string, t string")
    got = [r["explained_variance_ratio"] for r in pca_explained(features_sparse(df, "k", [], ["s", "t"]), 2).orderBy("component").collect()]
    assert got == pytest.approx([(1 / 3) / (4 * 0.2 + 2 / 3)] * 2, rel=1e-8)  # both blocks are balanced and crossed
