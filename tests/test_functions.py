from pyspark.sql import functions as F

from peerpanel.functions.scalar import (code_labels, fill_unknown, last_of, match_flag, money_text, percent_text,
                                        suffix_year, target_value, zero_pad)


def test_text_functions(spark):
    df = spark.createDataFrame([("Department of Energy", 5, 0.125, 1234567.6)], "s string, n int, p double, m double")
    r = df.select(last_of("s").alias("a"), last_of(F.lit("Nonfederal")).alias("b"), zero_pad("n").alias("c"),
                  zero_pad(F.lit(123)).alias("d"), percent_text("p").alias("e"), money_text("m").alias("f")).first()
    assert tuple(r) == ("Energy", "Nonfederal", "05", "123", "12.5%", "$1,234,568")
    assert suffix_year("Degree of urbanization (Urban-centric locale) (HD2021)") == 2021


def test_code_labels_and_match(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (-2, None)], "c int, s string")
    out = [tuple(r) for r in df.select(code_labels("c", {1: "Yes", 2: "No"}).alias("l"),
                                       match_flag("s", F.lit("a")).alias("m")).collect()]
    assert out == [("Yes", "Yes"), ("No", "No"), (None, "No")]
    filled = [r["s"] for r in fill_unknown(df, ["s"]).collect()]
    assert filled == ["a", "b", "Unknown"]


def test_target_value_absent_default(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "k int, s string, v double")
    present = target_value(df, "k", 1, ["s", "v"]).first()
    absent = target_value(df, "k", 9, ["s"], default="N/A").first()
    assert (present["target_s"], present["target_v"], absent["target_s"]) == ("x", 2.0, "N/A")


def test_fill_unknown_numeric_columns(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    out = fill_unknown(df, ["a"], "Unknown")
    assert dict(out.dtypes)["a"] == "string" and [r["a"] for r in out.collect()] == ["1", "Unknown"]
    zero = fill_unknown(df, ["b"], "0")
    assert dict(zero.dtypes)["b"] == "int" and [r["b"] for r in zero.collect()] == [0, 2]


def test_target_present_with_null_is_not_absent(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, s string")
    assert target_value(df, "k", 1, ["s"], default="N/A").first()["target_s"] is None
    assert target_value(df, "k", 9, ["s"], default="N/A").first()["target_s"] == "N/A"
