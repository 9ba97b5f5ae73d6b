import pytest

from peerpanel.operators.windows import rank_within, share_within, standardize


def test_standardize_constant_and_range(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(8)], "k int, x double, c double")
    out = {r["k"]: (r["x"], r["c"]) for r in standardize(df, ["x", "c"]).collect()}
    assert out[0][0] == pytest.approx(-1.5275, abs=1e-4)
    assert all(v[1] == 0.0 for v in out.values())


def test_standardize_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, x double")
    out = sorted((r["g"], r["x"]) for r in standardize(df, ["x"], by="g").collect())
    assert out == [("a", -1.0), ("a", 1.0), ("b", 0.0)]


def test_share_within_zero_sum_is_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0), (None, 2)], "g string, n int")
    out = sorted(((r["g"], r["n"]), r["share"]) for r in share_within(df, "g", "n").collect()
                 if r["g"] is not None)
    assert out == [(("a", 1), 0.25), (("a", 3), 0.75), (("b", 0), None)]
    nulls = [r["share"] for r in share_within(df, "g", "n").collect() if r["g"] is None]
    assert nulls == [1.0]


def test_rank_within_top(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 2.0, 3), ("b", 1.0, 4)], "g string, v double, k int")
    from pyspark.sql import functions as F
    top = rank_within(df, "g", [F.col("v").desc()], top=2)
    assert sorted((r["g"], r["k"], r["rank"]) for r in top.collect()) == [("a", 2, 1), ("a", 3, 2), ("b", 4, 1)]


def test_rank_within_matches_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rows = [("hot", float(i % 97), i) for i in range(3000)] + [("cold", float(i), 10000 + i) for i in range(50)]
    rows += [(None, 1.0, 20000), (None, 2.0, 20001)]
    df = spark.createDataFrame(rows, "g string, v double, k int").repartition(5)
    order = [F.col("v").desc(), F.col("k").asc()]
    number = F.row_number().over(Window.partitionBy("g").orderBy(*order))
    window = {r["k"]: r["rank"] for r in df.withColumn("rank", number).collect()}
    sorted_path = {r["k"]: r["rank"] for r in rank_within(df, "g", order).collect()}
    assert window == sorted_path
    assert len(sorted_path) == 3052
