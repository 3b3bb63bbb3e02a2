"""Classifiers on Spark ML, and the loops that compare and tune them.

Hyper-parameters come in through the specs; the presets below state the values used
for full-size runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigipanel.functions.scalar import class_weight
from vigipanel.ml.grown import Plan, grow
from vigipanel.ml.staged import STAGES, staged_rows
from vigipanel.operators.encode import scale, scaling_stats
from vigipanel.operators.groups import eligible_groups
from vigipanel.operators.metrics import (
    DEFAULT_LONG,
    GRID_LONG,
    auc,
    best_threshold,
    threshold_sweep,
)
from vigipanel.session import materialise, scratch_path
from vigipanel.sources.panel import write_table

Params = Mapping[str, Any]

# Rows of a task in a search: small tables stay in few tasks, so that many fits run at once.
ROWS_PER_TASK = 100_000
# Fits side by side: a fit on a small table waits for its many small steps rather than for
# cores, while one on a large table fills the cluster and keeps its rows in memory.
PARALLEL_SMALL, PARALLEL_LARGE = 24, 4


def side_by_side(rows: int) -> int:
    return PARALLEL_SMALL if rows <= ROWS_PER_TASK else PARALLEL_LARGE

# Full-size hyper-parameters.
FULL: dict[str, dict[str, Any]] = {
    "xgboost": {
        "maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
    },
    "random_forest": {"numTrees": 300, "maxDepth": 15, "minInstancesPerNode": 5},
    "gradient_boosting": {
        "maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
    },
    "logistic_regression": {"c": 0.1, "maxIter": 1000},
    "svm": {"c": 1.0, "maxIter": 100},
    "neural_network": {"hidden": (128, 64, 32), "maxIter": 500},
    "lightgbm": {
        "maxIter": 200, "maxDepth": 5, "stepSize": 0.03, "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
    },
}

# Where the forecast of a future outbreak departs from these.
FORECAST: dict[str, dict[str, Any]] = {
    "Random Forest": {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 1},
    "Gradient Boosting": {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 1.0},
    "Logistic Regression": {"c": 1.0, "maxIter": 1000},
    "Neural Network": {"hidden": (64, 32), "maxIter": 300},
}

# Search grids, in the names of the Spark parameters.  Two axes of the originals
# have no Spark parameter, the rows a node needs before it is split and the number of leaves of
# a tree grown leaf by leaf; without them the first and the last grid have half as many options.
GRIDS: dict[str, dict[str, Sequence[Any]]] = {
    "gradient_boosting": {
        "maxIter": (200, 300), "stepSize": (0.03, 0.05), "maxDepth": (3, 4),
        "minInstancesPerNode": (5, 10),
    },
    "xgboost": {
        "maxIter": (200, 300), "maxDepth": (3, 4, 5), "stepSize": (0.03, 0.05),
        "subsamplingRate": (0.8, 1.0), "featureSubsetStrategy": ("0.8", "all"),
        "minInstancesPerNode": (3, 5),
    },
    "lightgbm": {
        "maxIter": (200,), "stepSize": (0.03, 0.05), "maxDepth": (3, 5),
        "subsamplingRate": (0.8,), "featureSubsetStrategy": ("0.8",),
    },
    "climate": {
        "maxIter": (100, 200), "stepSize": (0.03, 0.05), "maxDepth": (3, 5),
        "subsamplingRate": (0.8,), "featureSubsetStrategy": ("0.8",),
    },
}


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def weight_column(df: DataFrame, label: str, mode: str | float | None) -> Column | None:
    """None, "ratio" (negatives/positives on positives), "balanced", or a fixed positive weight."""
    if mode is None:
        return None
    if isinstance(mode, int | float):
        return class_weight(label, mode)
    n, pos = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    pos = int(pos or 0)
    neg = n - pos
    if not pos or not neg:
        return F.lit(1.0)
    if mode == "ratio":
        return class_weight(label, neg / pos)
    return class_weight(label, n / (2 * pos), n / (2 * neg))


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str
    params: Params = field(default_factory=dict)
    weight: str | float | None = None
    scaled: bool = False
    seed: int = 42

    def with_params(self, **params: Any) -> ModelSpec:
        return replace(self, params={**self.params, **params})


def fixed_specs(overrides: Mapping[str, Params] | None = None) -> list[ModelSpec]:
    """The six classifiers of the comparison; `overrides` shrinks them for trials."""
    made = [
        ModelSpec("XGBoost", "boosted", FULL["xgboost"], "ratio"),
        ModelSpec("Random Forest", "forest", FULL["random_forest"], "balanced"),
        ModelSpec("Gradient Boosting", "boosted", FULL["gradient_boosting"]),
        ModelSpec("Logistic Regression", "logistic", FULL["logistic_regression"], "balanced", True),
        ModelSpec("SVM", "svm", FULL["svm"], "balanced", True),
        ModelSpec("Neural Network", "network", FULL["neural_network"], None, True),
    ]
    overrides = overrides or {}
    return [s.with_params(**overrides.get(s.name, {})) for s in made]


def forecast_specs(overrides: Mapping[str, Params] | None = None) -> list[ModelSpec]:
    """The six classifiers as the forecast study sets them."""
    made = [s.with_params(**FORECAST.get(s.name, {})) for s in fixed_specs()]
    return [s.with_params(**(overrides or {}).get(s.name, {})) for s in made]


# ---- radial kernel by random features --------------------------------------------------


def random_features(df: DataFrame, columns: Sequence[str], out: str, size: int, gamma: float,
                    seed: int) -> DataFrame:
    """cos(Wx + b): a linear model on these approximates a radial-basis kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(len(columns), size))
    b = rng.uniform(0, 2 * np.pi, size)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        z = np.sqrt(2 / size) * np.cos(np.stack(x.to_numpy()) @ w + b)
        return pd.Series(list(z))

    values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(out, array_to_vector(project(values)))


# ---- one model ---------------------------------------------------------------------------


@dataclass
class Fitted:
    """A fitted classifier: `score` adds the probability `p` of the positive class."""

    spec: ModelSpec
    columns: list[str]
    model: Any
    prepare: Callable[[DataFrame], DataFrame]
    calibrate: Any = None

    def score(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.prepare(df))
        if self.calibrate is not None:
            margin = vector_to_array("rawPrediction")[1]
            out = out.withColumn("__margin", array_to_vector(F.array(margin)))
            out = self.calibrate.transform(out.drop("probability", "prediction", "rawPrediction"))
        return out.select(*df.columns, vector_to_array("probability")[1].alias("p"))

    def importances(self) -> DataFrame:
        """(feature, importance) of a tree model."""
        values = self.model.featureImportances.toArray()
        rows = [(c, float(v)) for c, v in zip(self.columns, values, strict=True)]
        session = SparkSession.getActiveSession()
        return session.createDataFrame(rows, "feature string, importance double")


def fit(train: DataFrame, columns: Sequence[str], label: str, spec: ModelSpec) -> Fitted:
    """Fit one classifier.  Scaling is fitted on the training rows only."""
    columns = list(columns)
    params = dict(spec.params)
    stats = scaling_stats(train, columns) if spec.scaled else {}
    features = "__features"

    def scaled(df: DataFrame) -> tuple[DataFrame, list[str]]:
        """The model's inputs beside the columns of `df`, which stay as they are."""
        if not stats:
            return df, columns
        names = {c: f"__scaled_{c}" for c in columns}
        copies = df.withColumns({n: F.col(c) for c, n in names.items()})
        return scale(copies, {n: stats[c] for c, n in names.items()}), list(names.values())

    def prepare(df: DataFrame) -> DataFrame:
        return assemble(*scaled(df), features)

    if spec.kind == "svm" and params.pop("kernel", "rbf") == "rbf":
        size = params.pop("random_features", 64)

        def prepare(df: DataFrame) -> DataFrame:  # noqa: F811
            return random_features(*scaled(df), features, size, 1 / len(columns), spec.seed)

    rows = prepare(train)
    common = {"featuresCol": features, "labelCol": label}
    weight = weight_column(train, label, spec.weight)
    if weight is not None:
        rows = rows.withColumn("__weight", weight)
        common["weightCol"] = "__weight"
    if spec.kind == "boosted":
        own = None if weight is None else F.col("__weight")
        (model,) = grow({0: rows}, {0: own}, [Plan(0, params, spec.seed)], label, features)
        return Fitted(spec, columns, model, prepare)
    if spec.kind == "forest":
        estimator = RandomForestClassifier(seed=spec.seed, **common, **params)
    elif spec.kind in ("logistic", "svm"):
        penalty = 1 / (params.pop("c", 1.0) * max(train.count(), 1))
        if spec.kind == "logistic":
            estimator = LogisticRegression(
                regParam=penalty, elasticNetParam=0.0, standardization=False, **common, **params
            )
        else:
            estimator = LinearSVC(regParam=penalty, standardization=False, **common, **params)
    elif spec.kind == "network":
        layers = [len(columns), *params.pop("hidden"), 2]
        estimator = MultilayerPerceptronClassifier(
            layers=layers, seed=spec.seed, **common, **params
        )
    else:
        raise ValueError(f"unknown kind {spec.kind}")
    rows = rows.select(features, F.col(label).cast("double").alias(label),
                       *(["__weight"] if weight is not None else []))
    model = estimator.fit(rows)
    calibrate = None
    if spec.kind == "svm":
        margins = model.transform(rows).select(
            array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("__margin"), label
        )
        calibrate = LogisticRegression(featuresCol="__margin", labelCol=label).fit(margins)
    return Fitted(spec, columns, model, prepare, calibrate)


# ---- many models -------------------------------------------------------------------------


def compare_models(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    label: str,
    specs: Sequence[ModelSpec],
    keep: Sequence[str],
) -> DataFrame:
    """(model, keep, y, p) of all models in one long table, so one pass evaluates them all.

    A few models are fitted side by side, for each spends much of its time on small steps.
    """
    test = materialise(test.select(*dict.fromkeys([*keep, label, *columns])))
    return score_models(fit_models(train, columns, label, specs), test, label, keep)


def fit_models(
    train: DataFrame, columns: Sequence[str], label: str, specs: Sequence[ModelSpec]
) -> list[Fitted]:
    """Every model on the same stored rows, several at a time."""
    train = materialise(train.select(label, *columns))
    n = train.count()
    train = train.coalesce(max(1, -(-n // ROWS_PER_TASK)))
    with ThreadPoolExecutor(side_by_side(n)) as pool:
        return [*pool.map(lambda spec: fit(train, columns, label, spec), specs)]


def score_models(fitted: Sequence[Fitted], test: DataFrame, label: str, keep: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [scored_rows(f, test, label, keep) for f in fitted])


def scored_rows(fitted: Fitted, test: DataFrame, label: str, keep: Sequence[str]) -> DataFrame:
    """(model, keep, y, p) of one model."""
    return fitted.score(test).select(
        F.lit(fitted.spec.name).alias("model"), *keep, F.col(label).alias("y"), "p"
    )


def train_per_group(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    label: str,
    spec: ModelSpec,
    cut: int,
    *,
    min_rows: int = 300,
    min_positives: int = 20,
    thresholds: Sequence[float] = GRID_LONG,
    year: str = "annee",
) -> DataFrame:
    """One model per group with enough support; a result row per group, best AUC first.

    `status` is "trained", or says why there are no metrics: the training years hold a
    single class, or there are no rows to test on.  The driver walks the groups, so their
    number should be that of diseases, not of rows.

    Each fit is a distributed Spark ML job, so a group may be of any size.  The rows are
    stored partitioned by group first, so that a fit reads its own group only.  A few
    fits run side by side to keep the cluster busy while one waits on its driver step.
    """
    df = df.select(*dict.fromkeys([key, year, label, *columns]))
    stored = scratch_path(df.sparkSession, "per-group")
    write_table(df, stored, partition_by=[key])
    df = df.sparkSession.read.schema(df.schema).parquet(stored)
    support = materialise(eligible_groups(df, [key], label, min_rows, min_positives))
    names = [r[key] for r in support.select(key).toLocalIterator()]

    scored = scratch_path(df.sparkSession, "per-group-scores")
    schema = T.StructType(
        [df.schema[key], T.StructField("y", T.DoubleType()), T.StructField("p", T.DoubleType())]
    )

    def one(job: tuple[int, Any]) -> str | None:
        number, name = job
        rows = df.where(F.col(key) == name)
        train, test = rows.where(F.col(year) <= cut), rows.where(F.col(year) > cut)
        if train.select(label).distinct().count() < 2:
            return None
        part = fit(train, columns, label, spec).score(test)
        path = f"{scored}/{number}"
        write_table(part.select(key, F.col(label).cast("double").alias("y"), "p"), path)
        return path

    with ThreadPoolExecutor(side_by_side(df.count())) as pool:
        paths = [path for path in pool.map(one, enumerate(names)) if path is not None]
    session = df.sparkSession
    pred = (
        session.read.schema(schema).parquet(*paths)
        if paths
        else session.createDataFrame([], schema)
    )
    sweep = threshold_sweep(pred, sorted({*thresholds, DEFAULT_LONG}), [key])
    best = best_threshold(sweep, [key], "f1", DEFAULT_LONG).drop("best")
    classes = F.count_distinct(F.when(F.col(year) <= cut, F.col(label)))
    tests = F.count_if(F.col(year) > cut)
    state = df.groupBy(key).agg(classes.alias("__classes"), tests.alias("__tests"))
    status = (
        F.when(F.col("__classes") < 2, "one class in training")
        .when(F.col("__tests") == 0, "no rows to test")
        .otherwise("trained")
    )
    return (
        support.join(state, key)
        .join(auc(pred, [key]), key, "left")
        .join(sweep.join(best, [key, "threshold"]), key, "left")
        .withColumn("status", status)
        .select(key, "samples", "outbreaks", "status", "auc", "precision", "recall", "f1", "threshold")
        .orderBy(F.desc_nulls_last("auc"), key)
    )


def combinations(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


@dataclass
class Search:
    """A finished grid search: mean F1 per option, the folds' predictions, the refitted best."""

    results: DataFrame
    predictions: DataFrame
    option: int
    best: Fitted


def fold_matrix(df: DataFrame, columns: Sequence[str], label: str, folds: Sequence[tuple[Column, Column]]) -> tuple[DataFrame, int]:
    """The rows as every fit reads them, stored once: vector, label, and two flags per fold; and their number."""
    flags = {f"__{part}{i}": pair[side] for i, pair in enumerate(folds) for side, part in enumerate(("train", "test"))}
    rows = assemble(df, columns, "__features").withColumns(flags)
    stored = materialise(rows.select("__features", F.col(label).cast("double").alias(label), *flags))
    n = stored.count()
    return stored.coalesce(max(1, -(-n // ROWS_PER_TASK))), n


def staged_options(options: Sequence[Mapping[str, Any]]) -> dict[tuple, list[int]]:
    """Options that differ in the number of trees only, together: one fit serves them all."""
    shared: dict[tuple, list[int]] = {}
    for i, option in enumerate(options):
        shared.setdefault(tuple((k, v) for k, v in option.items() if k != "maxIter"), []).append(i)
    return shared


def grid_search(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    spec: ModelSpec,
    grid: Mapping[str, Sequence[Any]],
    folds: Sequence[tuple[Column, Column]],
    *,
    threshold: float = 0.5,
) -> Search:
    """Mean F1 per option of a grid of boosted models, and the best refitted on all rows.

    `folds` are (train, test) conditions on `df`, for example over the block column of
    `expanding_folds`.  The longest model of each combination of the other parameters is fitted
    once per fold and its stages stand for the shorter ones.  The fits of all folds are grown
    together; each leaves its test rows' probabilities at every stage in one stored table, and
    one pass over that table gives the counts of all options.
    """
    if spec.kind != "boosted":
        raise ValueError("stages are those of boosted trees")
    options = combinations(grid)
    trees = [int({**spec.params, **o}.get("maxIter", 20)) for o in options]
    shared = staged_options(options)
    matrix, n_rows = fold_matrix(df, columns, label, folds)
    stored = scratch_path(df.sparkSession, "fold-predictions")
    jobs = [(fold, dict(params), members) for params, members in shared.items() for fold in range(len(folds))]

    def plan(rows: int, params: Params, longest: int) -> Plan:
        return Plan(rows, {**spec.params, **params, "maxIter": longest}, spec.seed)

    trains = {fold: matrix.where(f"__train{fold}") for fold in range(len(folds))}
    weights = {fold: weight_column(train, label, spec.weight) for fold, train in trains.items()}
    plans = [plan(fold, params, max(trees[i] for i in members)) for fold, params, members in jobs]
    models = grow(trains, weights, plans, label)

    def scored(number: int) -> str:
        fold, _, members = jobs[number]
        test = matrix.where(f"__test{fold}")
        rows = staged_rows(models[number].trees, test, "__features", [trees[i] for i in members], [label])
        marks = F.array(*[F.lit(i) for i in members])
        path = f"{stored}/{members[0]}-{fold}"
        rows.select(F.lit(fold).alias("fold"), marks.alias("options"), F.col(label).alias("y"), STAGES).write.parquet(path)
        return path

    with ThreadPoolExecutor(side_by_side(n_rows)) as pool:
        paths = [*pool.map(scored, range(len(jobs)))]
    predictions = df.sparkSession.read.parquet(*paths)
    results = option_scores(predictions, options, threshold)
    ranked = results.orderBy(F.desc("mean_f1"), "option").first()  # the first of equals
    option = options[ranked["option"]]
    weight = weight_column(matrix, label, spec.weight)
    (model,) = grow({0: matrix}, {0: weight}, [plan(0, option, trees[ranked["option"]])], label)
    own = list(columns)
    best = Fitted(spec.with_params(**option), own, model, lambda rows: assemble(rows, own, "__features"))
    return Search(results, predictions, ranked["option"], best)


def option_scores(predictions: DataFrame, options: Sequence[Mapping[str, Any]], threshold: float) -> DataFrame:
    """(option, params, mean_f1) from the folds' predictions: counts per fold and fit, then per option."""
    most = max(map(len, staged_options(options).values()))
    y = F.col("y") == 1
    counts = {}
    for s in range(most):
        hit = F.coalesce(F.get(STAGES, F.lit(s)) >= threshold, F.lit(False))
        counts |= {f"tp{s}": F.count_if(y & hit), f"fp{s}": F.count_if(~y & hit), f"fn{s}": F.count_if(y & ~hit)}
    by_fit = predictions.groupBy("fold", "options").agg(*[c.alias(n) for n, c in counts.items()])
    f1 = [F.coalesce(F.try_divide(F.lit(2.0) * F.col(f"tp{s}"), 2 * F.col(f"tp{s}") + F.col(f"fp{s}") + F.col(f"fn{s}")), F.lit(0.0)) for s in range(most)]
    by_fold = by_fit.select("fold", F.inline(F.arrays_zip(F.col("options").alias("option"), F.array(*f1).alias("f1"))).alias("option", "f1"))
    means = by_fold.where("option is not null").groupBy("option").agg(F.avg("f1").alias("mean_f1"))
    names = F.array(*[F.lit(str(o)) for o in options])
    return materialise(means.select("option", F.get(names, "option").alias("params"), "mean_f1"))


def expanding_conditions(n_splits: int, block: str = "block") -> list[tuple[Column, Column]]:
    return [(F.col(block) < i, F.col(block) == i) for i in range(1, n_splits + 1)]


def stratified_conditions(n_splits: int, fold: str = "fold") -> list[tuple[Column, Column]]:
    return [(F.col(fold) != i, F.col(fold) == i) for i in range(n_splits)]
