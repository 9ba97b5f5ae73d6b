import pytest
from pyspark.sql import functions as F

from peerpanel.operators.aggregates import club
from peerpanel.operators.columns import override_key, row_total
from peerpanel.operators.filters import require_key
from peerpanel.operators.joins import flag_members, keep_members
from peerpanel.operators.reshape import pivot_strict


def test_override_key_cases(spark):
    df = spark.createDataFrame([("A", 1), ("B", None), ("C", None), ("D", 4)], "name string, k long")
    ov = spark.createDataFrame([("A", 10), ("C", 30), ("C", 31), ("D", None)], "name string, k long")
    out = require_key(override_key(df, ov, on="name", key="k"), "k")
    got = sorted((r["name"], r["k"]) for r in out.collect())
    # A overridden; B has no key and no override -> dropped; C listed twice -> two rows;
    # D's override is NULL -> ignored, original kept
    assert got == [("A", 10), ("C", 30), ("C", 31), ("D", 4)]


def test_pivot_strict_raises_on_duplicate_cell(spark):
    df = spark.createDataFrame([(1, 2020, "x", 1.0), (1, 2020, "x", 2.0), (1, 2020, "y", 3.0)],
                               "k long, year int, src string, v double")
    with pytest.raises(Exception) as err:
        pivot_strict(df, ["k", "year"], "src", "v").collect()
    assert "more than one row" in str(err.value) and "src=x" in str(err.value)


def test_pivot_strict_values_and_missing(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 3.0), (2, "x", 5.0)], "k long, src string, v double")
    out = {r["k"]: (r["x"], r["y"]) for r in pivot_strict(df, ["k"], "src", "v").collect()}
    assert out == {1: (1.0, 3.0), 2: (5.0, None)}


def test_club_all_null_is_zero(spark):
    df = spark.createDataFrame([(1, 2020, "b", None), (1, 2020, "a", None), (2, 2020, "c", 2.0)],
                               "k long, year int, name string, v double")
    out = {r["k"]: (r["name"], r["v"]) for r in club(df, ["k", "year"], carry=["name"]).collect()}
    assert out == {1: ("a", 0.0), 2: ("c", 2.0)}


def test_flag_members_all_years(spark):
    df = spark.createDataFrame([(1, 2020, "Old name"), (1, 2021, "Member U."), (2, 2021, "Other")],
                               "k long, year int, name string")
    members = spark.createDataFrame([("Member U.",), (None,)], "name string")
    out = {(r["k"], r["year"]): r["member"] for r in flag_members(df, members, "name", "k").collect()}
    assert out == {(1, 2020): True, (1, 2021): True, (2, 2021): False}
    kept = sorted((r["k"], r["year"]) for r in keep_members(df, members, "name", "k").collect())
    assert kept == [(1, 2020), (1, 2021)]


def test_row_total_nulls(spark):
    df = spark.createDataFrame([(None, 2.0, None), (None, None, None)], "a double, b double, c double")
    out = [r["t"] for r in row_total(df, "t", ["a", "b", "c"]).collect()]
    assert out == [2.0, 0.0]
