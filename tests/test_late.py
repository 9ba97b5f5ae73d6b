import datetime as dt

import pytest
from pyspark.sql import functions as F

from peerpanel.operators import late
from peerpanel.operators.aggregates import dedupe, latest
from peerpanel.operators.late import latest_rows, packed_order, pick_rows
from peerpanel.session import scratch_path


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def orders(spark):
    return spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("year", F.year("o_orderdate"))


@pytest.mark.parametrize("descending", [False, True])
def test_picked_rows_are_those_of_dedupe(spark, descending):
    o = orders(spark)
    got = pick_rows(o, "o_custkey", ["year", "o_orderkey"], descending)
    want = dedupe(o, "o_custkey", ["year", "o_orderkey"], descending)
    assert got.columns == o.columns
    assert rows(got.select(*want.columns)) == rows(want)


def test_latest_rows_are_those_of_latest(spark):
    o = orders(spark).withColumn("status", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")))
    by = ["year", "o_orderkey"]
    assert rows(latest_rows(o, "o_custkey", ["status", "year"], by)) == rows(latest(o, ["o_custkey"], ["status", "year"], by))
    gone = o.withColumn("year", F.when(F.col("o_custkey") % 2 > 0, F.col("year"))).dropDuplicates(["o_custkey", "year"])
    gone.write.mode("overwrite").parquet(p := scratch_path(spark, "late-test"))
    gone = spark.read.parquet(p)
    assert rows(latest_rows(gone, "o_custkey", ["status"])) == rows(latest(gone, ["o_custkey"], ["status"]))


def test_no_sort_aggregate_and_no_text_in_the_first_scan(spark):
    o = orders(spark)
    chosen = (o.withColumn("_place", F.monotonically_increasing_id()).groupBy("o_custkey")
              .agg(F.min_by("_place", packed_order(o, ["year", "o_orderkey"])).alias("place")))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert "o_orderpriority" not in plan


def test_order_of_extremes_nulls_and_types(spark):
    big = 2 ** 63
    data = [(None, None), (None, big - 1), (-2 ** 31, None), (-2 ** 31, -big), (-2 ** 31, big - 1), (-1, 0), (0, -1), (0, 0),
            (2 ** 31 - 1, big - 1)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, a int, b long")
    got = [r["i"] for r in df.select("i", packed_order(df, ["a", "b"]).alias("p")).orderBy("p").collect()]
    assert got == list(range(len(data)))
    kinds = spark.createDataFrame([(1, False, dt.date(1960, 1, 1)), (2, False, dt.date(2020, 1, 1)), (3, True, None)],
                                  "i int, f boolean, d date")
    assert [r["i"] for r in kinds.orderBy(packed_order(kinds, ["f", "d"])).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        packed_order(df.withColumn("t", F.lit("x")), ["t"])
    with pytest.raises(ValueError):
        packed_order(df, ["b", "b"])


def test_keys_names_ties_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), (7, None, "n"), (7, 5, "m"), (8, 1, "s"), (8, 1, "s")],
                               "`a.k` int, _place int, _bits string")
    got = rows(pick_rows(df, "a.k", "_place"))
    assert got == sorted(map(repr, [(None, 1, "x"), (7, None, "n"), (8, 1, "s")]))
    assert pick_rows(df.where("false"), "a.k", "_place").collect() == []


def test_hot_key_and_places_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(100_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id",
                                     F.concat(F.lit("text "), F.col("id")).alias("text"))
    want = rows(dedupe(df, "k", ["id"], descending=True))
    assert rows(pick_rows(df, "k", "id", descending=True)) == want
    monkeypatch.setattr(late, "MAX_BITMAPS", 0)
    assert rows(pick_rows(df, "k", "id", descending=True)) == want
