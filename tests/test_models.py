import inspect
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigipanel.ml import explain as X
from vigipanel.ml import models as M
from vigipanel.ml.certify import certified
from vigipanel.ml.staged import staged_scores

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=COLUMNS)
    pdf["y"] = ((pdf.a + 0.5 * pdf.b * (pdf.c > 0) + 0.3 * rng.normal(size=400)) > 0.4).astype(int)
    pdf["id"] = range(400)
    pdf["g"] = np.where(pdf.id % 3 == 0, "x", "y")
    pdf["annee"] = np.where(pdf.id < 280, 1999, 2000)
    return spark.createDataFrame(pdf).cache()


def spec(name, **params):
    (one,) = [s for s in M.fixed_specs() if s.name == name]
    small = {
        "XGBoost": {"maxIter": 4, "maxDepth": 3},
        "Random Forest": {"numTrees": 8, "maxDepth": 4},
        "Gradient Boosting": {"maxIter": 4, "maxDepth": 3},
        "Logistic Regression": {"maxIter": 30},
        "SVM": {"maxIter": 20, "random_features": 24},
        "Neural Network": {"hidden": (6,), "maxIter": 40},
    }
    return one.with_params(**{**small[name], **params})


@pytest.mark.parametrize("name", [s.name for s in M.fixed_specs()])
def test_every_model_beats_chance_on_its_training_rows(rows, name):
    from vigipanel.operators.metrics import auc

    scored = M.fit(rows, COLUMNS, "y", spec(name)).score(rows)
    assert scored.columns == [*rows.columns, "p"]
    low, high = scored.agg(F.min("p"), F.max("p")).first()
    assert 0 <= low <= high <= 1
    assert auc(scored.withColumn("m", F.lit(1)), ["m"]).first().auc > 0.7


def test_weights(rows):
    n, pos = rows.count(), rows.where("y = 1").count()
    for mode, (one, zero) in {
        "ratio": ((n - pos) / pos, 1.0),
        "balanced": (n / (2 * pos), n / (2 * (n - pos))),
        4: (4.0, 1.0),
    }.items():
        weight = M.weight_column(rows, "y", mode)
        got = {r.y: r.w for r in rows.select("y", weight.alias("w")).distinct().collect()}
        assert got == pytest.approx({1: one, 0: zero})


def conditional_value(nodes, x, known):
    """Expected prediction of one tree when only the features in `known` are seen."""
    by_id = {r.node: r for r in nodes.itertuples()}

    def walk(i):
        r = by_id[i]
        if r.left < 0:
            return r.prediction
        if r.feature in known:
            return walk(r.left if x[r.feature] <= r.threshold else r.right)
        left, right = by_id[r.left].cover, by_id[r.right].cover
        return (left * walk(r.left) + right * walk(r.right)) / r.cover

    return walk(0)


def test_tree_contributions_are_the_shapley_values(rows):
    model = M.fit(rows, COLUMNS, "y", spec("Gradient Boosting")).model
    wide, base = X.tree_contributions(model, rows, COLUMNS, ["id"])
    got = wide.where("id < 12").toPandas().set_index("id")
    nodes = X.ensemble_nodes(model, rows.sparkSession).toPandas()
    weights = model.treeWeights
    x_rows = rows.where("id < 12").toPandas().set_index("id")[COLUMNS]
    d = len(COLUMNS)
    for i, x in x_rows.iterrows():
        x = x.to_numpy()

        def value(known, x=x):
            return sum(
                2 * weights[t] * conditional_value(part, x, known)
                for t, part in nodes.groupby("tree")
            )

        for j, c in enumerate(COLUMNS):
            others = [k for k in range(d) if k != j]
            want = sum(
                factorial(s) * factorial(d - s - 1) / factorial(d)
                * (value({*known, j}) - value(set(known)))
                for s in range(d)
                for known in combinations(others, s)
            )
            assert got.loc[i, f"phi_{c}"] == pytest.approx(want, abs=1e-9)
        assert base == pytest.approx(value(set()), abs=1e-9)


def test_tree_contributions_add_up_to_the_margin(rows):
    fitted = M.fit(rows, COLUMNS, "y", spec("Gradient Boosting"))
    wide, base = X.tree_contributions(fitted.model, rows, COLUMNS, ["id"])
    total = sum(F.col(f"phi_{c}") for c in COLUMNS) + F.lit(base)
    both = fitted.score(rows).select("id", "p").join(wide.select("id", total.alias("m")), "id")
    gap = both.agg(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-F.col("m")))))).first()[0]
    assert gap < 1e-9
    raw = fitted.model.transform(fitted.prepare(rows)).select(
        vector_to_array("rawPrediction")[1].alias("r")
    )
    assert raw.count() == rows.count()


def test_linear_contributions_add_up(rows):
    coefficients = {"a": 2.0, "b": -1.0}
    means = X.feature_means(rows, list(coefficients))
    wide = X.linear_contributions(rows, coefficients, means, ["id"])
    margin = 2.0 * F.col("a") - F.col("b")
    base = 2.0 * means["a"] - means["b"]
    gap = wide.join(rows, "id").agg(
        F.max(F.abs(F.col("phi_a") + F.col("phi_b") + F.lit(base) - margin))
    )
    assert gap.first()[0] < 1e-9
    long = X.to_long(wide, ["id"])
    back = X.to_wide(long, ["id"], ["a", "b"])
    assert back.join(wide, "id").where("abs(a - phi_a) + abs(b - phi_b) > 1e-12").count() == 0


def test_model_per_group(rows):
    table = M.train_per_group(
        rows, "g", COLUMNS, "y", spec("XGBoost"), 1999, min_rows=200, min_positives=10
    ).collect()
    assert [r.g for r in table] == ["y"]  # "x" has too few rows
    assert table[0].samples == rows.where("g = 'y'").count()
    assert table[0].auc > 0.7


def test_model_per_group_without_support(rows):
    out = M.train_per_group(rows, "g", COLUMNS, "y", spec("XGBoost"), 1999, min_rows=10_000)
    assert out.count() == 0
    assert out.columns == [
        "g", "samples", "outbreaks", "status", "auc", "precision", "recall", "f1", "threshold",
    ]


def test_grid_search(rows):
    blocked = rows.withColumn("block", F.floor(F.col("id") / 100))
    grid = {"maxIter": (1, 4), "maxDepth": (2, 3)}
    base = M.ModelSpec("GB", "boosted", {}, 4.0)
    folds = M.expanding_conditions(3)
    found = M.grid_search(blocked, COLUMNS, "y", base, grid, folds)
    table = {r.option: r.mean_f1 for r in found.results.collect()}
    assert set(table) == {0, 1, 2, 3}
    assert found.option == max(table, key=lambda o: (table[o], -o))
    for i, option in enumerate(M.combinations(grid)):
        f1 = []
        for train, test in folds:
            own = M.fit(blocked.where(train), COLUMNS, "y", base.with_params(**option))
            hits = own.score(blocked.where(test)).select("y", (F.col("p") >= 0.5).alias("h")).toPandas()
            tp = int((hits.h & (hits.y == 1)).sum())
            f1.append(2 * tp / max(1, int(hits.h.sum() + hits.y.sum())))
        assert table[i] == pytest.approx(np.mean(f1))
    assert found.best.spec.params == {**base.params, **M.combinations(grid)[found.option]}


def test_stages_are_the_shorter_models(rows):
    long = M.fit(rows, COLUMNS, "y", spec("Gradient Boosting", maxIter=6))
    made = {r.id: r.stages for r in staged_scores(long.model, long.prepare(rows), "__features", [2, 6], ["id"]).collect()}
    for at, n in enumerate((2, 6)):
        short = M.fit(rows, COLUMNS, "y", spec("Gradient Boosting", maxIter=n)).score(rows)
        assert all(abs(r.p - made[r.id][at]) < 1e-12 for r in short.select("id", "p").collect())


def test_stages_send_missing_values_right(rows):
    model = M.fit(rows, COLUMNS, "y", spec("Gradient Boosting"))
    gaps = rows.withColumn("a", F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("a")))
    prepared = M.VectorAssembler(inputCols=COLUMNS, outputCol="__features", handleInvalid="keep").transform(gaps)
    own = {r.id: r.stages[0] for r in staged_scores(model.model, prepared, "__features", [4], ["id"]).collect()}
    library = model.model.transform(prepared).select("id", vector_to_array("probability")[1].alias("p")).collect()
    assert all(abs(own[r.id] - r.p) < 1e-12 for r in library)


def test_scoring_leaves_the_columns_as_they_are(rows):
    for name in ("Logistic Regression", "SVM"):
        scored = M.fit(rows, COLUMNS, "y", spec(name)).score(rows)
        assert scored.select("id", *COLUMNS).exceptAll(rows.select("id", *COLUMNS)).count() == 0


@pytest.mark.parametrize("name", [s.name for s in M.fixed_specs()])
def test_certificates_tell_a_fitted_model_from_a_constant(rows, name):
    wanted = spec(name, **({"maxIter": 300} if name == "Logistic Regression" else {}))
    assert certified(M.fit(rows, COLUMNS, "y", wanted), rows, "y")
    # A model of labels that have nothing to do with the columns is no better than a constant.
    shuffled = rows.withColumn("y", (F.xxhash64("id") % 3 == 0).cast("int"))
    assert not certified(M.fit(shuffled, COLUMNS, "y", wanted), rows, "y")


def test_full_size_grids():
    sizes = {name: len(M.combinations(grid)) for name, grid in M.GRIDS.items()}
    assert sizes == {"gradient_boosting": 16, "xgboost": 96, "lightgbm": 4, "climate": 8}


def test_importances(rows):
    table = M.fit(rows, COLUMNS, "y", spec("Random Forest")).importances().collect()
    assert {r.feature for r in table} == set(COLUMNS)
    assert sum(r.importance for r in table) == pytest.approx(1)


def test_forecast_settings():
    specs = {s.name: s.params for s in M.forecast_specs({"SVM": {"maxIter": 3}})}
    assert specs["Random Forest"]["numTrees"] == 200 and specs["Gradient Boosting"]["maxDepth"] == 3
    assert specs["Neural Network"]["hidden"] == (64, 32) and specs["SVM"]["maxIter"] == 3
    assert specs["XGBoost"] == {s.name: s.params for s in M.fixed_specs()}["XGBoost"]


def test_registered_models_and_searches_are_full():
    from vigipanel.plans import q_models

    source = inspect.getsource(q_models)
    assert "with_params" not in source and "TRIAL" not in source
    assert set(q_models.MODEL_IDS.values()) == {s.name for s in M.fixed_specs()}
    assert q_models.options_sql("gradient_boosting").count("maxDepth") == 16


def test_fits_grown_together_are_the_librarys_trees(rows):
    from vigipanel.ml import grown as G

    marked = M.assemble(rows.select("id", "y", "annee", *COLUMNS), COLUMNS, "__features").repartition(3)
    trains = {0: marked, 1: marked.where("annee = 1999")}
    weights = {0: None, 1: M.weight_column(trains[1], "y", "ratio")}
    settings = [{"maxIter": 12, "maxDepth": 3, "minInstancesPerNode": 7}, {"maxIter": 5, "maxDepth": 2, "stepSize": 0.05}]
    plans = [G.Plan(r, s) for r in trains for s in settings]
    # Blocks of several tasks go level by level, those of one task stay in it.
    many = G.grow(trains, weights, plans, "y")
    one = G.grow({r: t.coalesce(1) for r, t in trains.items()}, weights, plans, "y")
    for plan, a, b in zip(plans, many, one, strict=True):
        weight = weights[plan.rows]
        train = trains[plan.rows].withColumn("w", F.lit(1.0) if weight is None else weight)
        library = GBTClassifier(featuresCol="__features", labelCol="y", weightCol="w", seed=42, **plan.params).fit(train)
        scored = library.transform(marked).orderBy("id")
        want = [r.p for r in scored.select(vector_to_array("probability")[1].alias("p")).collect()]
        nodes = X.ensemble_nodes(library, rows.sparkSession).toPandas()
        for made in (a, b):
            own = made.transform(marked).orderBy("id")
            assert [r.p for r in own.select(vector_to_array("probability")[1].alias("p")).collect()] == pytest.approx(want, abs=1e-9)
            # The same leaves with the same rows; nodes are numbered otherwise.
            leaves = [sorted(zip(n.tree, n.prediction.round(9), n.cover)) for n in (nodes[nodes.left < 0], made.nodes()[made.nodes().left < 0])]
            assert np.array(leaves[0]) == pytest.approx(np.array(leaves[1]), abs=1e-8)
            assert made.getNumTrees == plan["maxIter"]
            assert made.featureImportances.toArray() == pytest.approx(library.featureImportances.toArray(), abs=1e-9)


def test_a_search_takes_no_fit_of_the_library(rows, monkeypatch):
    """Dozens of fits of a few jobs a tree took longer than any limit."""

    def refused(*args, **kwargs):
        raise AssertionError("a fit on its own")

    monkeypatch.setattr(GBTClassifier, "fit", refused)
    blocked = rows.withColumn("block", F.floor(F.col("id") / 100))
    grid = {"maxIter": (2, 30), "maxDepth": (2,), "subsamplingRate": (0.8,), "featureSubsetStrategy": ("0.8",)}
    found = M.grid_search(blocked, COLUMNS, "y", M.ModelSpec("GB", "boosted", {}, "ratio"), grid, M.expanding_conditions(3))
    assert found.results.where("mean_f1 > 0.5").count() == 2
    assert found.best.importances().agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_candidate_splits_of_all_sets_come_from_one_job(spark):
    from vigipanel.ml import grown as G

    rows = spark.createDataFrame([(float(i % 7), float(i % 3), 1.0) for i in range(40)], "a double, b double, __w double")
    train = M.assemble(rows, ["a", "b"], "__features")
    sets = {0: train, 3: train.where("a < 4")}
    found = G.candidates(sets, {n: t.count() for n, t in sets.items()}, "__features", 1)
    assert {n: [p.tolist() for p in points] for n, points in found.items()} == {
        0: [[0.5, 1.5, 2.5, 3.5, 4.5, 5.5], [0.5, 1.5]],
        3: [[0.5, 1.5, 2.5], [0.5, 1.5]],
    }
