"""Physical plans and whole feature tables."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel.functions import columns as C
from vigipanel.operators import groups as G
from vigipanel.operators.splits import expanding_folds
from vigipanel.operators.windows import add_lags
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.schema import (
    CLIMATE_EXCLUDE,
    CLIMATE_EXCLUDE_PREFIXES,
    FORECAST_EXCLUDE,
    KEYS,
    NOWCAST_EXCLUDE,
    WEEK,
)
from vigipanel.session import materialise

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def master(spark):
    return materialise(fx.master(spark, SF))


@pytest.mark.parametrize("build", [ft.features_v3, ft.features_v4, ft.features_v5])
def test_one_exchange_and_one_sort_per_feature_table(master, build):
    plan = physical(build(master))
    assert plan.count("Exchange hashpartitioning") == 1
    assert re.search(r"Exchange hashpartitioning\(prov#\d+, maladie#\d+", plan)
    assert len(re.findall(r"\bSort \[", plan)) == 1
    assert "SinglePartition" not in plan


def test_forecast_table_stays_on_the_same_exchange(master):
    plan = physical(ft.forecast_table(master, 1999))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_small_statistics_are_broadcast(master):
    plan = physical(G.add_anomaly(master, ["t2m"], ["mois"]))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan


def test_large_statistics_are_not_broadcast(master, monkeypatch):
    import vigipanel.session as session

    monkeypatch.setattr(session.small_side, "__defaults__", (2,))
    spark = master.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(G.add_anomaly(master, ["t2m"], ["mois"]))
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only_counts_reach_a_single_partition(master):
    """Global positions: the rows are shuffled by slice, only the slice counts meet."""
    plan = physical(expanding_folds(master.select("prov", "maladie", "debutsem"), 3))
    for block in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in block.split("FileScan")[0]


def test_columns_and_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderpriority = 'x'")
    plan = physical(add_lags(df.select("o_custkey", "o_orderdate", "o_totalprice"),
                             ["o_totalprice"], [1], ["o_custkey"], "o_orderdate",
                             null_keys="drop", weekly_groups=True))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,x)" in plan
    assert "o_orderstatus" not in plan


def test_shapes_of_the_feature_tables(master):
    n = master.count()
    groups = master.select(*KEYS).distinct().count()
    for build, width, lost in (
        (ft.features_v3, 38, 4), (ft.features_v4, 62, 8), (ft.features_v5, 52, 8),
    ):
        out = build(master)
        assert len(out.columns) == width
        assert out.count() == n - lost * groups  # every group is longer than that


def test_label_counts_match_the_fixture(spark):
    out = ft.features_v3(fx.master(spark, SF))
    assert out.agg(F.count("*"), F.sum("is_outbreak")).first()[:] == (1235, 34)


def test_no_leaking_columns(master):
    v4, v5 = ft.features_v4(master), ft.features_v5(master)
    now = set(C.feature_columns(v4, NOWCAST_EXCLUDE))
    assert not now & {"is_outbreak", "incidence", "totalcas", "totaldeces", "debutsem"}
    assert "target_outbreak_future" not in C.feature_columns(v5, NOWCAST_EXCLUDE)
    assert not set(C.feature_columns(v5, FORECAST_EXCLUDE)) & set(FORECAST_EXCLUDE)
    climate = C.feature_columns(v4, CLIMATE_EXCLUDE, CLIMATE_EXCLUDE_PREFIXES)
    assert not [c for c in climate if c.startswith(("inc", "total"))]


def test_climate_table_works_without_optional_columns(master):
    v5 = ft.features_v5(master)
    out = ft.climate_only_table(v5, "MACHINERY", weather=("t2m", "ws2m"))
    assert "t2m_roll4" in out.columns and "ws2m_roll4" not in out.columns


@pytest.mark.parametrize("spec", [ft.V3, ft.V5])
def test_hot_group_build_equals_the_weekly_build(master, spec):
    """No assumption on the groups, every group cut into runs: the same table."""
    names = ["prov", "maladie", "debutsem"]
    weekly = ft.build_features(master, spec)
    runs = ft.build_features(master, spec, weekly_groups=False, limit=20)
    a = weekly.toPandas().sort_values(names).reset_index(drop=True)
    b = runs.toPandas().sort_values(names).reset_index(drop=True)[a.columns]
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-12)


def test_weather_of_another_group_is_kept(master):
    one = add_lags(master, ["t2m"], [1], KEYS, WEEK).where("maladie = 'MACHINERY'")
    assert one.count() == master.where("maladie = 'MACHINERY'").count()


def test_a_query_fits_the_models_it_names_only(monkeypatch):
    from types import SimpleNamespace

    from vigipanel.plans import q_models

    calls = []

    def fitted(train, columns, label, specs):
        calls.append([s.name for s in specs])
        return [SimpleNamespace(spec=s) for s in specs]

    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="fits its models only"))
    monkeypatch.setattr(q_models, "split_v3", lambda spark, sf: (None, None, []))
    monkeypatch.setattr(q_models.M, "fit_models", fitted)
    assert q_models.trained(session, "", "Random Forest").spec.name == "Random Forest"
    six = [s.name for s in q_models.M.fixed_specs()]
    assert list(q_models.all_trained(session, "", six)) == six
    assert calls == [["Random Forest"], [n for n in six if n != "Random Forest"]]
