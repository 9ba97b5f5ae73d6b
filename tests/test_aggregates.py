from pyspark.sql import functions as F

from peerpanel.operators.aggregates import (change_counts, count_by, dedupe, entity_profile, latest, modal_by_group,
                                            modal_value, rollup_by, value_counts, value_shares)


def test_latest_null_wins(spark):
    df = spark.createDataFrame([(1, 2020, "x"), (1, 2021, None)], "k long, year int, a string")
    assert latest(df, ["k"], ["a"]).first()["a"] is None


def test_entity_profile_latest_and_mean(spark):
    df = spark.createDataFrame([(1, 2020, "old", 1.0), (1, 2021, "new", 3.0), (1, 2019, "older", None)],
                               "k long, year int, a string, m double")
    r = entity_profile(df, "k", ["a"], ["m"]).first()
    assert (r["year"], r["a"], r["m"]) == (2021, "new", 2.0)


def test_change_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "a"), (1, "b")], "k long, c string")
    assert change_counts(df, ["k"], ["c"]).first()["c_unique_count"] == 2


def test_count_by_null_rules(spark):
    df = spark.createDataFrame([("x",), (None,), (None,)], "g string")
    keep = {r["g"]: r["count"] for r in count_by(df, ["g"]).collect()}
    drop = {r["g"]: r["count"] for r in count_by(df, ["g"], dropna=True).collect()}
    assert keep == {"x": 1, None: 2} and drop == {"x": 1}


def test_value_shares_sum_to_one_and_counts(spark):
    df = spark.createDataFrame([("a", "p"), ("a", None), ("b", "p"), (None, "q")], "s string, t string")
    vs = value_shares(df, ["s", "t"])
    tot = {r["variable"]: r["s"] for r in vs.groupBy("variable").agg(F.sum("share").alias("s")).collect()}
    assert all(abs(v - 1) < 1e-12 for v in tot.values())
    vc = [tuple(r) for r in value_counts(df, "s").collect()]
    assert vc == [("a", 2), ("b", 1)]


def test_mode_tie_breaks_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "c string")
    r = modal_value(df, ["c"]).first()
    assert (r["mode"], r["mode_count"], r["mode_share"]) == ("a", 2, 0.5)
    g = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "z")], "g int, c string")
    assert {r["g"]: r["c"] for r in modal_by_group(g, "g", ["c"]).collect()} == {1: "y", 2: "z"}


def test_dedupe_first_by_order(spark):
    df = spark.createDataFrame([(1, 5, "late"), (1, 2, "early"), (2, 9, "only")], "k long, o int, v string")
    out = {r["k"]: r["v"] for r in dedupe(df, "k", ["o"]).collect()}
    assert out == {1: "early", 2: "only"}
    last = {r["k"]: r["v"] for r in dedupe(df, "k", ["o"], descending=True).collect()}
    assert last == {1: "late", 2: "only"}


def test_rollup_drops_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, m double")
    assert {r["g"]: r["m"] for r in rollup_by(df, "g", ["m"]).collect()} == {"a": 2.0}
    assert {r["g"]: r["m"] for r in rollup_by(df, "g", ["m"], how="sum").collect()} == {"a": 4.0}
