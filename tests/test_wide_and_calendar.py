"""Wide statistics, sketches, dictionaries, weeks by the calendar, doubled weeks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel.operators import calendar_weeks as W
from vigipanel.operators import encode as E
from vigipanel.operators import selection as L
from vigipanel.operators import sketches as K
from vigipanel.operators.wide import joint_counts, wide_quantiles
from vigipanel.operators.windows import add_lags, lag, with_ordered
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.schema import KEYS, WEATHER, WEEK, WIND
from vigipanel.session import materialise
from vigipanel.sources import weather as wx

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": rng.lognormal(size=n), "d": 1.0, "y": rng.integers(0, 2, n)})
    pdf.loc[rng.random(n) < 0.2, "a"] = None
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in pdf.astype(object).itertuples(index=False)]
    df = spark.createDataFrame([(*r, None) for r in rows], "a double, b double, c double, d double, y int, e double")
    return materialise(df.repartition(5)), pdf


@pytest.mark.parametrize("steps", [None, 1, 4])
def test_wide_quantiles_are_exact(numbers, steps):
    df, pdf = numbers
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "high": 1.0}
    got = {r.feature: r for r in wide_quantiles(df, ["a", "b", "c", "d", "e"], probs, steps=steps).collect()}
    for c in "abcd":
        for name, q in probs.items():
            assert got[c][name] == pytest.approx(pdf[c].dropna().quantile(q), abs=1e-12)
    assert got["e"].median is None


def test_wide_quantiles_of_an_empty_table(numbers):
    df, _ = numbers
    for steps in (None, 2):
        got = wide_quantiles(df.limit(0), ["a", "b"], {"m": 0.5}, steps=steps).collect()
        assert sorted((r.feature, r.m) for r in got) == [("a", None), ("b", None)]


def test_rows_are_not_multiplied(numbers):
    df, _ = numbers
    for made in (E.medians(df, ["a", "b", "c"]), L.mutual_information(df, ["a", "b", "c"], "y"), joint_counts(df, ["a"], "y", {"a": [0.0]})):
        plan = physical(made)
        assert "Expand" not in plan
        # What is generated is one row of aggregates, never a scan.
        assert "Generate" not in plan.split("MapInArrow")[-1] if "MapInArrow" in plan else "Aggregate" in plan.split("Generate")[-1]


def test_joint_counts(numbers):
    df, pdf = numbers
    got = {(r.feature, r.bin, r.label): r.n for r in joint_counts(df, ["a", "b"], "y", {"a": [0.0], "b": [0.0, 2.0]}).collect()}
    want = {}
    for c, cuts in (("a", [0.0]), ("b", [0.0, 2.0])):
        own = pdf[[c, "y"]].dropna()
        for v, y in zip(own[c], own.y):
            key = (c, sum(t < v for t in cuts), float(y))
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_sketches_merge_within_the_stated_error(spark):
    rng = np.random.default_rng(2)
    rows = [("g", int(i % 40), float(v)) for i, v in enumerate(rng.lognormal(size=20_000))] + [("g", 3, None), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "g string, w int, v double")
    stored = materialise(K.sketch_values(df, ["g", "w"], "v"))
    (got,) = K.sketch_thresholds(stored, ["g"]).collect()
    values = np.sort([r[2] for r in rows if r[0] and r[2] is not None])
    for name, q in (("q1", 0.25), ("q3", 0.75), ("p90", 0.9)):
        assert abs(np.searchsorted(values, got[name]) / len(values) - q) <= K.RANK_ERROR
    assert got.n == 20_000 and got.threshold == max(got.q3 + 1.5 * (got.q3 - got.q1), got.p90)
    assert stored.count() == 40


def test_one_dictionary_for_all_columns(spark):
    rows = [("b", "x", 3), ("a", None, 10), ("b", "y", 3), (None, "x", 2)]
    df = materialise(spark.createDataFrame(rows, "p string, q string, n int"))
    coded = E.ordinal_encode(df, ["p", "q", "n"])
    got = sorted(((r.p, r.q, r.n, r.p_code, r.q_code, r.n_code) for r in coded.collect()), key=str)
    assert got == sorted([("b", "x", 3, 1, 0, 1), ("a", None, 10, 0, None, 2), ("b", "y", 3, 1, 1, 1), (None, "x", 2, None, 0, 0)], key=str)
    assert "Expand" not in physical(coded) and "Generate" not in physical(coded)


# weeks


def monday(i):
    return dt.date(2000, 1, 3) + dt.timedelta(weeks=i)


@pytest.fixture(scope="module")
def gappy(spark):
    draw = random.Random(1)
    rows = [(g, monday(i), float(draw.randrange(9))) for g in "abc" for i in range(60) if draw.random() < 0.6]
    rows += [("d", monday(0), 1.0), ("d", monday(1500), 2.0), (None, monday(3), 5.0), ("e", None, 6.0)]
    return rows, spark.createDataFrame(rows, "g string, w date, v double")


@pytest.mark.parametrize("span", [7, 520])
def test_dense_weeks(gappy, span):
    rows, df = gappy
    weeks = sorted((r.g, r.w) for r in W.group_weeks(df, ["g"], "w", span).collect())
    want = []
    for g in "abcd":
        own = [w for k, w, _ in rows if k == g]
        want += [(g, min(own) + dt.timedelta(weeks=i)) for i in range((max(own) - min(own)).days // 7 + 1)]
    assert weeks == want


def test_densify_keeps_every_row(gappy):
    rows, df = gappy
    dense = W.densify(df, ["g"], "w", {"v": F.lit(0.0)}).collect()
    assert sorted(((r.g, r.w, r.v) for r in dense if r.reported), key=str) == sorted(rows, key=str)
    assert all(r.v == 0.0 for r in dense if not r.reported) and any(not r.reported for r in dense)


def test_lags_by_date_are_row_lags_of_the_dense_panel(gappy):
    _, df = gappy
    named = df.where("g is not null and w is not null")
    made = {"l3": W.calendar_lag("v", 3, ["g"], "w"), "m4": W.calendar_rolling("v", "mean", 4, 1, ["g"], "w"), "ahead": W.calendar_lag("v", -2, ["g"], "w")}
    by_date = {(r.g, r.w): (r.l3, r.m4, r.ahead) for r in W.add_calendar(named, made, ["g"], "w", 4, 2).collect()}
    dense = W.densify(named, ["g"], "w")
    rowwise = with_ordered(
        dense,
        {"l3": lag("v", 3), "m4": lambda w: F.avg("v").over(w.rowsBetween(-4, -1)), "ahead": lag("v", -2)},
        ["g"], "w", back=4, ahead=2, weekly_groups=True,
    )
    for r in rowwise.where("reported").collect():
        assert by_date[r.g, r.w] == pytest.approx((r.l3, r.m4, r.ahead))


# doubled weeks


@pytest.mark.parametrize("build", [ft.features_v3, ft.features_v4, ft.features_v5, ft.features_fallback, lambda m: ft.forecast_table(m, 1999)])
def test_a_doubled_week_fails_every_feature_table(spark, build):
    master = materialise(fx.master(spark, SF))
    twice = master.unionByName(master.where("prov = 'ASIA' and maladie = 'BUILDING'").limit(1))
    with pytest.raises(Exception, match="two rows of one debutsem: ASIA, BUILDING"):
        build(twice).count()


def test_rows_without_a_key_may_repeat(spark):
    rows = [("a", monday(0), 1.0), (None, monday(0), 2.0), (None, monday(0), 3.0)]
    df = spark.createDataFrame(rows, "g string, w date, v double")
    assert add_lags(df, ["v"], [1], ["g"], "w", weekly_groups=True).count() == 3
    with pytest.raises(Exception, match="two rows of one w: a"):
        add_lags(df.unionByName(df.limit(1)), ["v"], [1], ["g"], "w", weekly_groups=True).count()


# training-only statistics, and a fourth measure


def test_late_rows_do_not_reach_training_statistics(spark):
    master = materialise(fx.master(spark, SF))
    early = F.col("annee") <= 1999
    changed = master.withColumns({c: F.when(early, F.col(c)).otherwise(F.col(c) * 7) for c in ("totalcas", *WEATHER)})
    names = ["is_outbreak", "t2m_anom", "rh2m_anom"]
    for df in (ft.features_v3(master, early), ft.features_v5(master, early)):
        plan = physical(df)
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    before, after = (ft.features_v3(m, early).where(early).select(*KEYS, WEEK, *names) for m in (master, changed))
    assert before.exceptAll(after).count() == 0
    without = ft.features_v3(changed).where(early).select(*KEYS, WEEK, *names)
    assert before.exceptAll(without).count() > 0


def test_wind_passes_from_the_reader_to_the_climate_study(spark):
    long = fx.weather_rows(spark, SF)
    wind = long.where("param = 't2m'").withColumns({"param": F.lit(WIND), "value": F.col("value") / 10})
    four = wx.pivot_weather(long.unionByName(wind), (*WEATHER, WIND))
    table = ft.features_v5(wx.join_weather(fx.panel(spark, SF), four))
    made = ft.climate_only_table(table, "MACHINERY", weather=(*WEATHER, WIND))
    assert {f"{WIND}_lag4", f"{WIND}_roll4", f"{WIND}_anom"} <= set(made.columns)
    assert made.where(F.abs(F.col(f"{WIND}_lag4") * 10 - F.col("t2m_lag4")) > 1e-9).count() == 0 and made.count() > 0
