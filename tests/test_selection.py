import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel.operators import encode as E
from vigipanel.operators import selection as L


def features(n=500, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n) + 1000
    y = (a + rng.normal(scale=0.5, size=n) > 1000.8).astype(int)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(scale=0.01, size=n), "c": rng.normal(size=n),
                        "flat": 1.0, "y": y})
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    return pdf


@pytest.fixture
def df(spark):
    frame = spark.createDataFrame(features())
    return frame.withColumn("c", F.when(~F.isnan("c"), F.col("c")))


def test_correlations_skip_missing_pairs(df):
    want = features()[["a", "b", "c"]].corr()
    for r in L.correlations(df.repartition(3), ["a", "b", "c"]).collect():
        assert r.r == pytest.approx(want.loc[r.a, r.b], abs=1e-9)


def test_constant_column_has_no_correlation(df):
    rows = L.correlations(df, ["a", "flat"]).collect()
    assert rows[0].r is None


def test_filters(df):
    assert L.drop_low_variance(df, ["a", "b", "c", "flat"]) == ["a", "b", "c"]
    assert L.drop_correlated(df, ["a", "b", "c"]) == ["a", "c"]
    assert L.drop_correlated(df, ["b", "c", "a"]) == ["b", "c"]


def test_mutual_information_ranks_the_informative_feature(df):
    mi = {r.feature: r.mi for r in L.mutual_information(df, ["a", "c"], "y").collect()}
    assert mi["a"] > 5 * mi["c"] >= 0


def test_select_features(df):
    assert L.select_features(df, ["a", "b", "c", "flat"], "y", k=1) == ["a"]


def test_scaling_uses_training_rows_and_population_std(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    test = spark.createDataFrame([(5.0,)], "x double")
    scaled_train, scaled_test = E.standardise(train, [train, test], ["x"])
    assert sorted(r.x for r in scaled_train.collect()) == [-1.0, 1.0]
    assert scaled_test.first().x == 3.0


def test_impute_median(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "x double")
    (out,) = E.impute_median(train, [train], ["x"])
    assert sorted(r.x for r in out.collect()) == [1.0, 2.0, 3.0, 4.0, 9.0]


def test_ordinal_codes_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), ("ab",), ("c",), (None,), ("a",)], "d string")
    coded = E.ordinal_encode(df, ["d"])
    assert {r.d: r.d_code for r in coded.collect()} == {"a": 0, "ab": 1, "b": 2, "c": 3, None: None}
    back = E.decode(coded.drop("d"), E.ordinal_codes(df, "d"), "d_code", "d")
    assert sorted(r.d or "" for r in back.collect()) == ["", "a", "a", "ab", "b", "c"]


def test_one_hot_drops_the_first_level(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "d string")
    out = E.one_hot(df, ["d"])
    assert out.columns == ["d_b", "d_c"]
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (0, 0), (0, 1), (1, 0)]
