import numpy as np
import pytest

from peerpanel.operators.quantiles import box_stats, median_impute, quantile_bin, quantiles_long


def test_qcut_parity_on_1_to_7(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 8)] + [(8, None)], "k int, x double")
    out = {r["k"]: r["x_quartile"] for r in quantile_bin(df, ["x"], index=True).collect()}
    assert [out[i] for i in range(1, 8)] == [1, 1, 2, 2, 3, 4, 4]
    assert out[8] is None


def test_qcut_equal_edges_raise(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 5.0])], "k int, x double")
    with pytest.raises(Exception) as err:
        quantile_bin(df, ["x"]).collect()
    assert "unique" in str(err.value)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.zeros(2000), rng.integers(0, 40, 1000).astype(float)])
    rows = [(int(i), float(v), int(i % 3)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id int, x double, g int")
    ps = [0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in quantiles_long(df, ["x"], ps).collect()}
    for p, e in zip(ps, np.quantile(vals, ps)):
        assert got[p] == pytest.approx(e, abs=1e-12)
    grouped = {(r["g"], r["prob"]): r["value"] for r in quantiles_long(df, ["x"], ps, by=["g"]).collect()}
    ids = np.arange(len(vals))
    for g in range(3):
        for p, e in zip(ps, np.quantile(vals[ids % 3 == g], ps)):
            assert grouped[(g, p)] == pytest.approx(e, abs=1e-12)


def test_box_stats(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = box_stats(df, ["x"]).first()
    q1, med, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
    assert r["upper_whisker"] == 7.0 and r["lower_whisker"] == 1.0 and r["n_outliers"] == 1
    assert r["mean"] == pytest.approx(np.mean(vals))


def test_median_impute(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 10.0)], "k int, x double")
    out = {r["k"]: r["x"] for r in median_impute(df, ["x"]).collect()}
    assert out == {1: 1.0, 2: 3.0, 3: 3.0, 4: 10.0}


def test_grouped_cut_points_and_outliers(spark):
    from peerpanel.operators.quantiles import box_outliers, cut_points
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", float(v)) for v in [10, 11, 12, 13]]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "k int, g string, x double")
    cp = {r["g"]: r["x_p50"] for r in cut_points(df, ["x"], [0.5], by=["g"]).collect()}
    assert cp == {"a": 3.0, "b": 11.5}
    out = [(r["g"], r["value"]) for r in box_outliers(df, "k", ["x"], by=["g"]).collect()]
    assert out == [("a", 100.0)]


def test_null_group_is_a_group_and_infinities_count(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 5.0), ("a", float("inf")), ("a", float("inf")), ("b", None)] + [("c", float("-inf"))] * 300
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {(r["g"], r["prob"]): (r["value"], r["n"]) for r in quantiles_long(df, ["x"], [0.0, 0.5, 1.0], by=["g"]).collect()}
    assert got[(None, 0.5)] == (2.0, 2) and got[("a", 0.0)] == (5.0, 3)
    assert got[("a", 0.5)] == (float("inf"), 3) and got[("c", 0.5)] == (float("-inf"), 300)
    assert not any(g == "b" for g, _ in got)
    box = {r["g"]: r["median"] for r in box_stats(df.where("g IS NULL OR g = 'a'"), ["x"], by=["g"]).collect()}
    assert box[None] == 2.0


def test_integer_median_need_not_be_whole(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    out = median_impute(df, ["x"])
    assert dict(out.dtypes)["x"] == "double"
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_order_bits_keep_every_double_and_its_order(spark):
    from peerpanel.operators.quantiles import from_order_bits, with_order_bits

    rng = np.random.default_rng(0)
    powers = 2.0 ** np.arange(-1074, 1024)
    vals = np.concatenate([rng.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64), rng.normal(size=500), powers, -powers,
                           np.nextafter(powers, 0), [0.0, np.inf, -np.inf, 5e-324, 1.7976931348623157e308]])
    vals = vals[~np.isnan(vals)]
    df = spark.createDataFrame([(float(v), float(v)) for v in vals], "v double, `a b` double")
    rows = with_order_bits(df, ["a b"]).withColumn("back", from_order_bits("`a b`")).collect()
    assert all(r["v"] == r["back"] for r in rows)
    ordered = sorted(rows, key=lambda r: r["v"])
    assert all((x["v"] < y["v"]) == (x["a b"] < y["a b"]) for x, y in zip(ordered, ordered[1:]))


def test_hot_value_and_narrow_range(spark):
    """A value with a third of all rows, beside values that differ in their last bits only."""
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.full(3000, 7.25), 1e9 + np.arange(3000) * 2.0**-20, -rng.random(3000)])
    rng.shuffle(vals)
    df = spark.createDataFrame([(float(v), int(k % 2)) for k, v in enumerate(vals)], "x double, g int")
    ps = [0.0, 0.01, 0.3333, 0.5, 0.6667, 0.9, 0.999, 1.0]
    for write in (True, False):
        got = {r["prob"]: r["value"] for r in quantiles_long(df, ["x"], ps, write=write).collect()}
        assert [got[p] for p in ps] == pytest.approx(list(np.quantile(vals, ps)), abs=1e-15, rel=1e-15)
