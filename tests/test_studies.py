"""Whole studies with small settings."""

import pytest

from vigipanel.ml import models as M
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.plans import studies
from vigipanel.session import materialise

SF = "/root/testdata/sf0.001"
CUT = 1999
GB = M.ModelSpec("GB", "boosted", {"maxIter": 2, "maxDepth": 2}, "ratio")
LR = M.ModelSpec("LR", "logistic", {"c": 0.1, "maxIter": 20}, "balanced", True)
GRID = {"maxIter": (2,), "maxDepth": (2, 3)}


@pytest.fixture(scope="module")
def master(spark):
    return materialise(fx.master(spark, SF))


@pytest.fixture(scope="module")
def v5(master):
    return materialise(ft.features_v5(master))


def test_nowcast_comparison(master):
    table = studies.nowcast_comparison(ft.features_v3(master), CUT, [GB, LR]).toPandas()
    assert set(table.model) == {"GB", "LR"}
    assert table.auc.between(0, 1).all() and table.auc.is_monotonic_decreasing


def test_nowcast_comparison_with_selection(master):
    table = studies.nowcast_comparison(ft.features_v4(master), CUT, [LR], select=5).collect()
    assert len(table) == 1


def test_forecast_comparison(v5):
    table = studies.forecast_comparison(v5, CUT, [GB, LR]).toPandas()
    assert list(table.columns) == ["model", "auc", "recall", "threshold"]
    assert len(table) == 2


def test_forecast_matrix_has_no_leaks(v5):
    matrix, columns = studies.forecast_matrix(v5)
    assert not {"is_outbreak", "incidence", "debutsem", studies.TARGET} & set(columns)
    assert "prov_AMERICA" in columns and "prov_AFRICA" not in columns
    assert all(t != "string" for n, t in matrix.dtypes if n in columns)


def test_forecast_grid(master):
    out = studies.forecast_grid(ft.forecast_table(master, CUT), CUT, GB, GRID)
    assert out.grid.count() == 2
    assert out.report.count() == 5
    assert out.threshold in (0.05, 0.1, 0.15, 0.2, 0.25)


@pytest.mark.parametrize("study", [studies.climate_only_study, studies.climate_driven_study])
def test_climate_studies(v5, study):
    out = study(v5, "MACHINERY", GB, GRID)
    names = {r.feature for r in out.importances.collect()}
    assert names and not [n for n in names if n.startswith(("inc", "total", "is_"))]


def test_disease_models(master):
    table = studies.disease_models(master, CUT, GB, min_rows=50, min_positives=3)
    assert table.columns[0] == "maladie"
    assert table.count() >= 1


def test_attribution(master):
    out = studies.attribution(ft.features_v3(master), CUT, GB)
    assert out.by_disease.where("feature = 'maladie_code'").count() == 0
    assert out.top_by_disease.count() == 15
    assert out.examples.groupBy("example").count().count() == 2
    assert out.dependence.select("feature").distinct().count() == 4
