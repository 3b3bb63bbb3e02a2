import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel.operators.windows import (
    add_abs_change,
    add_future_target,
    add_lags,
    add_rolling,
)

KEYS = ["prov", "maladie"]
SCHEMA = "prov string, maladie string, debutsem date, x double"


def frame(spark, groups):
    """{(prov, maladie): values} as weekly rows."""
    start = dt.date(2006, 1, 2)
    rows = [
        (p, m, start + dt.timedelta(weeks=i), v)
        for (p, m), values in groups.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, column, prov):
    rows = df.where(F.col("prov") == prov).orderBy("debutsem").select(column).collect()
    return [r[0] for r in rows]


def test_windows_do_not_cross_groups(spark):
    df = frame(spark, {("a", "m"): [1000.0] * 12, ("b", "m"): [1.0] * 12})
    out = add_rolling(df, "x", "mean", [8], KEYS, "debutsem", "roll{w}")
    assert values(out, "roll8", "b") == [None] + [1.0] * 11
    lagged = add_lags(df, ["x"], [1, 4], KEYS, "debutsem")
    assert values(lagged, "x_lag4", "b")[:4] == [None] * 4


def test_rolling_minimum_periods(spark):
    df = frame(spark, {("a", "m"): [1.0, 3.0, None, 5.0, 7.0]})
    one = add_rolling(df, "x", "mean", [2], KEYS, "debutsem", "r", min_periods=1)
    assert values(one, "r", "a") == [None, 1.0, 2.0, 3.0, 5.0]
    full = add_rolling(df, "x", "mean", [2], KEYS, "debutsem", "r", min_periods=None)
    assert values(full, "r", "a") == [None, None, 2.0, None, None]


def test_std_of_one_and_two_rows(spark):
    df = frame(spark, {("a", "m"): [1.0, 3.0, 5.0, 7.0]})
    two = add_rolling(df, "x", "std", [4], KEYS, "debutsem", "s", shift=0, min_periods=2)
    assert values(two, "s", "a") == pytest.approx(
        [None, np.std([1, 3], ddof=1), 2.0, np.std([1, 3, 5, 7], ddof=1)]
    )
    four = add_rolling(df, "x", "std", [4], KEYS, "debutsem", "s", shift=0, min_periods=4)
    assert values(four, "s", "a")[:3] == [None] * 3


def test_future_target_ends_with_the_group(spark):
    df = frame(spark, {("a", "m"): [0.0, 0.0, 1.0, 0.0]})
    out = add_future_target(df, "x", 2, KEYS, "debutsem", "ahead")
    assert values(out, "ahead", "a") == [1.0, 0.0, None, None]


def test_abs_change(spark):
    df = frame(spark, {("a", "m"): [5.0, 1.0, 2.0]})
    out = add_abs_change(df, {"x": "d"}, 1, KEYS, "debutsem")
    assert values(out, "d", "a") == [None, 4.0, 1.0]


@pytest.mark.parametrize("mode", ["keep", "drop"])
@pytest.mark.parametrize("kw", [{}, {"limit": 1}, {"weekly_groups": True}])
def test_rows_without_a_key_form_no_group(spark, mode, kw):
    df = frame(spark, {("a", "m"): [1.0, 2.0], (None, "m"): [7.0, 8.0, 9.0]})
    out = add_lags(df, ["x"], [1], KEYS, "debutsem", null_keys=mode, **kw)
    rows = [(r.prov, r.x, r.x_lag1) for r in out.collect()]
    expected = [("a", 1.0, None), ("a", 2.0, 1.0)]
    if mode == "keep":
        expected += [(None, 7.0, None), (None, 8.0, None), (None, 9.0, None)]
    assert sorted(rows, key=str) == sorted(expected, key=str)
    assert out.columns == [*df.columns, "x_lag1"]


def test_hot_groups_in_runs_match_pandas(spark):
    """One group holds most rows and is cut into runs; the other stays whole."""
    rng = np.random.default_rng(7)
    groups = {("hot", "m"): rng.normal(size=400).tolist(), ("cold", "m"): [1.0, 2.0, 3.0]}
    groups[("hot", "m")][50:90] = [None] * 40
    df = frame(spark, groups)
    kw = {"limit": 25}
    out = add_rolling(df, "x", "mean", [4, 12], KEYS, "debutsem", "roll{w}", **kw)
    out = add_lags(out, ["x"], [1, 16], KEYS, "debutsem", **kw)
    out = add_future_target(out, "x", 4, KEYS, "debutsem", "ahead", **kw)
    got = out.toPandas().sort_values(["prov", "debutsem"]).reset_index(drop=True)
    want = df.toPandas().sort_values(["prov", "debutsem"]).reset_index(drop=True)
    g = want.groupby("prov").x
    for w in (4, 12):
        want[f"roll{w}"] = g.transform(lambda s, w=w: s.shift(1).rolling(w, min_periods=1).mean())
    want["x_lag1"], want["x_lag16"], want["ahead"] = g.shift(1), g.shift(16), g.shift(-4)
    assert len(got) == len(want)
    for c in ("roll4", "roll12", "x_lag1", "x_lag16", "ahead"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-12)


def test_runs_must_cover_the_frame(spark):
    df = frame(spark, {("a", "m"): [1.0] * 10})
    with pytest.raises(ValueError):
        add_lags(df, ["x"], [8], KEYS, "debutsem", limit=4)


def test_group_shorter_than_the_lag_leaves_nothing(spark):
    df = frame(spark, {("a", "m"): [1.0, 2.0, 3.0]})
    out = add_lags(df, ["x"], [4], KEYS, "debutsem").dropna(subset=["x_lag4"])
    assert out.count() == 0


def test_lag_matches_pandas_on_ragged_groups(spark):
    rng = np.random.default_rng(3)
    groups = {(f"p{i}", "m"): rng.normal(size=n).tolist() for i, n in enumerate((1, 5, 17, 60))}
    df = frame(spark, groups)
    got = add_lags(df, ["x"], [3], KEYS, "debutsem").toPandas()
    pdf = got.sort_values(["prov", "debutsem"])
    want = pdf.groupby("prov").x.shift(3)
    pd.testing.assert_series_equal(pdf["x_lag3"], want, check_names=False)
