"""Property checks against pandas / numpy on random inputs (hypothesis)."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from peerpanel.operators.aggregates import value_shares
from peerpanel.operators.quantiles import quantile_bin, quantiles_long
from peerpanel.operators.windows import standardize

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=60)


@SETTINGS
@given(values)
def test_quantile_bin_matches_pandas_qcut(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, x double")
    s = pd.Series([np.nan if x is None else x for x in xs], dtype=float)
    try:
        expected = pd.qcut(s, q=4, labels=False)
    except ValueError:
        with pytest.raises(Exception):
            quantile_bin(df, ["x"], index=True).collect()
        return
    got = {r["k"]: r["x_quartile"] for r in quantile_bin(df, ["x"], index=True).collect()}
    for i, e in enumerate(expected):
        assert got[i] == (None if np.isnan(e) else int(e) + 1)


@SETTINGS
@given(values)
def test_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    clean = np.array([x for x in xs if x is not None])
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in quantiles_long(df, ["x"], ps).collect()}
    if clean.size == 0:
        assert got == {}
        return
    for p, e in zip(ps, np.quantile(clean, ps)):
        assert got[p] == pytest.approx(e, rel=1e-12, abs=1e-9)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c"])), min_size=1, max_size=40))
def test_value_shares_match_pandas(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "s string")
    expected = pd.Series(xs, dtype=object).value_counts(normalize=True).to_dict()
    got = {r["value"]: r["share"] for r in value_shares(df, ["s"]).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v)


@SETTINGS
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=40))
def test_standardize_matches_population_zscore(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, x double")
    a = np.array(xs)
    sd = a.std()
    expected = (a - a.mean()) / (sd if sd > 0 else 1.0)
    got = {r["k"]: r["x"] for r in standardize(df, ["x"]).collect()}
    for i, e in enumerate(expected):
        assert got[i] == pytest.approx(e, abs=1e-6)
