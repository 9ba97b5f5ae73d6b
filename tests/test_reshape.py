import pytest
from pyspark.sql import functions as F

from peerpanel.operators.reshape import concat_diagonal, melt, one_hot, pivot_counts, pivot_strict, wide_years_to_long


def test_wide_years_to_long_paren_names_and_missing_year(spark):
    df = spark.createDataFrame(
        [(1, "U1", "City", "Town", 10, 11)],
        "id long, name string, `Degree (Urban-centric) (HD2022)` string, `Degree (Urban-centric) (HD2021)` string, "
        "`Size (HD2023)` int, `Size (HD2022)` int")
    for method in ("explode", "union"):
        long = wide_years_to_long(df, ["id", "name"], method=method)
        assert long.columns == ["id", "name", "year", "Size", "Degree (Urban-centric)"]
        rows = {r["year"]: (r["Size"], r["Degree (Urban-centric)"]) for r in long.collect()}
        assert rows == {2023: (10, None), 2022: (11, "City"), 2021: (None, "Town")}


def test_wide_years_type_conflict_raises(spark):
    df = spark.createDataFrame([(1, 5, "x")], "id long, `A (HD2020)` int, `A (HD2021)` string")
    with pytest.raises(TypeError):
        wide_years_to_long(df, ["id"])


def test_concat_diagonal(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    b = spark.createDataFrame([(3, "s")], "k int, y string")
    out = concat_diagonal([a, b])
    assert out.columns == ["k", "x", "y"]
    assert sorted(out.collect(), key=lambda r: r.k) == [(1, 2, None), (3, None, "s")]
    c = spark.createDataFrame([(3, "s")], "k int, x string")
    with pytest.raises(TypeError):
        concat_diagonal([a, c])


def test_wide_long_wide_identity(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "k long, `v (HD2020)` double, `v (HD2021)` double")
    long = wide_years_to_long(df, ["k"])
    back = pivot_strict(long, ["k"], "year", "v", categories=[2020, 2021],
                        names={2020: "v (HD2020)", 2021: "v (HD2021)"})
    assert sorted(back.collect()) == sorted(df.collect())


def test_melt_and_pivot_counts(spark):
    df = spark.createDataFrame([("R1", "pub"), ("R1", "pub"), ("R2", "priv")], "d string, c string")
    wide = pivot_counts(df, ["d"], "c")
    assert {r["d"]: (r["priv"], r["pub"]) for r in wide.collect()} == {"R1": (0, 2), "R2": (1, 0)}
    long = melt(wide, ["d"], None, "c", "n")
    assert long.count() == 4


def test_one_hot_string_and_codes(spark):
    df = spark.createDataFrame([(1, "a", 11), (2, "b", 42), (3, None, 11)], "k int, s string, code int")
    out = one_hot(df, ["s", "code"])
    assert out.columns == ["k", "code", "s_a", "s_b"]
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, 11, 1, 0), (2, 42, 0, 1), (3, 11, 0, 0)]
    enc = one_hot(df, ["code"], numeric="encode")
    assert "code_11" in enc.columns and "code_42" in enc.columns


def test_one_hot_vector(spark):
    from peerpanel.operators.reshape import one_hot_vector
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, s string")
    out = {r["k"]: r["s_vec"].toArray().tolist() for r in one_hot_vector(df, ["s"]).collect()}
    assert out == {1: [0.0, 1.0, 0.0], 2: [1.0, 0.0, 0.0], 3: [0.0, 0.0, 1.0]}


def test_union_form_prunes_years(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)],
                               "k long, `v (HD2020)` double, `v (HD2021)` double, `v (HD2022)` double")
    long = wide_years_to_long(df, ["k"], method="union").where(F.col("year") == 2021)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # constant folding left a single branch
    assert [r["v"] for r in long.collect()] == [2.0]


def test_pivots_lose_no_rows(spark):
    import pytest

    from peerpanel.operators.reshape import one_hot, pivot_counts, pivot_strict

    df = spark.createDataFrame([(1, "a", 2.0), (1, None, 4.0), (2, "zz", 9.0)], "k int, c string, v double")
    for lost in (lambda: pivot_strict(df, ["k"], "c", "v", categories=["a"]), lambda: pivot_strict(df, ["k"], "c", "v"),
                 lambda: pivot_counts(df, ["k"], "c", categories=["a"]), lambda: pivot_counts(df, ["k"], "c")):
        with pytest.raises(Exception, match="in the list"):
            lost().collect()
    wide = {r["k"]: r.asDict() for r in pivot_strict(df, ["k"], "c", "v", null_name="none").collect()}
    assert wide == {1: {"k": 1, "a": 2.0, "zz": None, "none": 4.0}, 2: {"k": 2, "a": None, "zz": 9.0, "none": None}}
    counts = {r["k"]: r.asDict() for r in pivot_counts(df, ["k"], "c", null_name="none").collect()}
    assert counts == {1: {"k": 1, "a": 1, "zz": 0, "none": 1}, 2: {"k": 2, "a": 0, "zz": 1, "none": 0}}
    with pytest.raises(ValueError, match="more than 1"):
        one_hot(df, ["c"], max_categories=1)
