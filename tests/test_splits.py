import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel.operators import splits


def panel(spark, n, seed=0, rate=0.2):
    rng = np.random.default_rng(seed)
    cells = [
        (w, p, m) for w in range(60) for p in ("a", "b", "c") for m in ("x", "y")
    ]
    chosen = sorted(rng.choice(len(cells), n, replace=False))
    start = dt.date(2006, 1, 2)
    rows = [
        (p, m, day := start + dt.timedelta(weeks=w), day.year, day.month, int(rng.random() < rate))
        for w, p, m in (cells[i] for i in chosen)
    ]
    pdf = pd.DataFrame(rows, columns=["prov", "maladie", "debutsem", "annee", "mois", "y"])
    return spark.createDataFrame(pdf)


def in_order(df):
    return df.toPandas().sort_values(["debutsem", "prov", "maladie"]).reset_index(drop=True)


@pytest.mark.parametrize("n", [40, 101, 203])
def test_expanding_folds(spark, n):
    pdf = in_order(splits.expanding_folds(panel(spark, n), 3))
    size = n // 4
    first = n - 3 * size
    want = [0] * first + [1] * size + [2] * size + [3] * size
    assert pdf.block.tolist() == want


def brute_force_stratified(y, k):
    """Deal each class to the folds the way an unshuffled stratified k-fold does."""
    order = list(dict.fromkeys(y))
    laid = sorted(order.index(v) for v in y)
    allocation = [np.bincount(laid[i::k], minlength=len(order)) for i in range(k)]
    fold = np.empty(len(y), dtype=int)
    for c, value in enumerate(order):
        dealt = np.concatenate([np.full(allocation[f][c], f) for f in range(k)])
        fold[[i for i, v in enumerate(y) if v == value]] = dealt
    return fold.tolist()


@pytest.mark.parametrize(("n", "seed"), [(50, 1), (100, 2), (151, 3), (200, 4)])
def test_stratified_folds(spark, n, seed):
    pdf = in_order(splits.stratified_folds(panel(spark, n, seed), 3, "y"))
    assert pdf.fold.tolist() == brute_force_stratified(pdf.y.tolist(), 3)


def test_split_by_fraction_is_positional(spark):
    df = splits.split_by_fraction(panel(spark, 143), 0.7).toPandas()
    pdf = df.sort_values(["annee", "mois", "debutsem", "prov", "maladie"])
    n = int(143 * 0.70)
    assert pdf.split.tolist() == ["train"] * n + ["test"] * (143 - n)


def test_split_by_date_quantile(spark):
    df = panel(spark, 180)
    pdf = df.toPandas()
    cut = pd.to_datetime(pdf.debutsem).quantile(0.8)
    got = splits.split_by_date_quantile(df, 0.8).toPandas()
    want = np.where(pd.to_datetime(got.debutsem) <= cut, "train", "test")
    assert (got.split == want).all()


def test_split_by_year(spark):
    out = splits.split_by_year(panel(spark, 100), 2006)
    assert out.where("split = 'train'").agg(F.max("annee")).first()[0] == 2006
    assert out.where("split = 'test'").agg(F.min("annee")).first()[0] == 2007
