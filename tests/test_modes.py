from pyspark.sql import functions as F

from peerpanel.operators import modes
from peerpanel.operators.aggregates import modal_value
from peerpanel.operators.modes import modes_by_candidates


def same(a, b):
    cols = a.columns
    assert sorted(cols) == sorted(b.columns)
    assert sorted(map(repr, (tuple(r) for r in a.collect()))) == sorted(map(repr, (tuple(r) for r in b.select(*cols).collect())))


def mixed(spark, n=60_000):
    """A hot value in a third of the rows among unique ones, a flat key, few values, ties, NULLs, numbers."""
    i = F.col("id")
    return spark.range(n).repartition(7).select(
        (i % 3).cast("string").alias("g"),
        F.when(F.xxhash64(i) % 3 == 0, F.lit("hot")).otherwise(i.cast("string")).alias("heavy"),
        i.cast("string").alias("flat"),
        F.when(i % 5 > 0, F.concat(F.lit("v"), (i % 4).cast("string"))).alias("few"),
        (i % 30_000).alias("pairs"),
        F.lit(None).cast("string").alias("none"),
        (F.sqrt(i).cast("int") / 2).alias("a.b"))


COLUMNS = ["heavy", "flat", "few", "pairs", "none", "a.b"]


def test_modes_equal_full_counts(spark):
    df = mixed(spark)
    same(modes_by_candidates(df, COLUMNS), modal_value(df, COLUMNS))
    same(modes_by_candidates(df, COLUMNS, counters=16), modal_value(df, COLUMNS))


def test_modes_by_group(spark):
    df = mixed(spark).withColumn("g", F.when(F.col("g") != "2", F.col("g")))
    same(modes_by_candidates(df, COLUMNS, "g", counters=64), modal_value(df, COLUMNS, "g"))


def test_modes_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(modes, "MAX_BYTES", 100)
    df = mixed(spark, 3000)
    same(modes_by_candidates(df, COLUMNS, "g"), modal_value(df, COLUMNS, "g"))


def test_modes_of_nothing(spark):
    df = spark.createDataFrame([], "g string, a string, b long")
    assert modes_by_candidates(df, ["a", "b"]).collect() == []
    assert modes_by_candidates(df, ["a", "b"], "g").collect() == []
