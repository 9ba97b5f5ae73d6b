"""One key holding a third of all rows: results stay whole and exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerpanel.operators.aggregates import club, dedupe, modal_value, value_shares
from peerpanel.operators.quantiles import quantiles_long
from peerpanel.operators.windows import share_within, standardize


@pytest.fixture(scope="module")
def skewed(spark):
    n = 9000
    rows = [(0 if i % 3 == 0 else i, i, float(i % 101), "hot" if i % 3 == 0 else f"v{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows, "k long, o long, x double, s string").repartition(6), rows


def test_skewed_key_aggregates(spark, skewed):
    df, rows = skewed
    c = {r["k"]: r["x"] for r in club(df.drop("s"), ["k"], values=["x"]).collect()}
    assert c[0] == sum(r[2] for r in rows if r[0] == 0)
    d = {r["k"]: r["o"] for r in dedupe(df, "k", ["o"]).collect()}
    assert d[0] == 0 and len(d) == 1 + sum(1 for r in rows if r[0] != 0)
    sh = share_within(df, "k", "x").where("k = 0").agg(F.sum("share")).first()[0]
    assert sh == pytest.approx(1.0)


def test_skewed_value_mode_and_quantiles(spark, skewed):
    df, rows = skewed
    m = modal_value(df, ["s"]).first()
    assert (m["mode"], m["mode_count"]) == ("hot", 3000)
    vs = value_shares(df, ["s"]).where("value = 'hot'").first()
    assert vs["share"] == pytest.approx(1 / 3)
    xs = np.array([r[2] for r in rows])
    got = {r["prob"]: r["value"] for r in quantiles_long(df, ["x"], [0.1, 0.5, 0.9]).collect()}
    assert [got[p] for p in (0.1, 0.5, 0.9)] == pytest.approx(list(np.quantile(xs, [0.1, 0.5, 0.9])))


def test_standardize_by_skewed_group(spark, skewed):
    df, _ = skewed
    z = standardize(df, ["x"], by="k").where("k = 0").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert z[0] == pytest.approx(0.0, abs=1e-9) and z[1] == pytest.approx(1.0)
