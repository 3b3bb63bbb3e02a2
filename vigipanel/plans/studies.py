"""Whole studies: from a feature table to a result table.

Each takes model specs or grids as arguments, so the same study runs as a quick trial or
at full size (`ml.models.FULL`, `GRIDS`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.functions.columns import drop_any_null, drop_if_exists, feature_columns
from vigipanel.functions.scalar import classify
from vigipanel.ml import explain as X
from vigipanel.ml import models as M
from vigipanel.operators import metrics as V
from vigipanel.operators import splits, topk
from vigipanel.operators.encode import impute_median, one_hot, ordinal_encode
from vigipanel.operators.groups import in_both_periods
from vigipanel.operators.selection import select_features
from vigipanel.plans import features as ft
from vigipanel.schema import (
    CLIMATE_EXCLUDE,
    CLIMATE_EXCLUDE_PREFIXES,
    CLIMATE_WHITELIST,
    DISEASE,
    FORECAST_EXCLUDE,
    KEYS,
    LABEL,
    NOISY_INTERACTIONS,
    NOWCAST_EXCLUDE,
    PROV,
    ROW_KEY,
    TARGET,
    WEATHER,
    WEEK,
    WIND,
    YEAR,
)
from vigipanel.session import materialise

PLACES = (PROV, DISEASE)


def _train_test(rows: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(YEAR) <= cut), rows.where(F.col(YEAR) > cut)


def nowcast_matrix(features: DataFrame, cut: int) -> tuple[DataFrame, list[str]]:
    """Diseases of both periods, province and disease as codes; label columns excluded."""
    common = in_both_periods(features, [DISEASE], cut)
    coded = materialise(ordinal_encode(common, PLACES))
    columns = feature_columns(coded, {*NOWCAST_EXCLUDE, *PLACES})
    return coded, columns


def nowcast_comparison(
    features: DataFrame, cut: int, specs: Sequence[M.ModelSpec], *, select: int | None = None
) -> DataFrame:
    """Models for the label of the same week, compared at a threshold of 0.2.

    `select=k` first picks features on the training rows.  Missing values are filled with
    training medians.
    """
    rows, columns = nowcast_matrix(features, cut)
    train, test = _train_test(rows, cut)
    if select is not None:
        columns = select_features(train, columns, LABEL, k=select)
    train, test = impute_median(train, [train, test], columns)
    pred = materialise(M.compare_models(train, test, columns, LABEL, specs, ROW_KEY))
    return V.comparison(pred, ["model"], 0.2, strict=True)


def forecast_matrix(
    rows: DataFrame, exclude: Sequence[str] = (*FORECAST_EXCLUDE, *NOISY_INTERACTIONS)
) -> tuple[DataFrame, list[str]]:
    """Complete rows with 0/1 columns for province and disease.

    The row key stays beside the features, as `row_*` columns, to order folds and to
    identify predictions.
    """
    whole = materialise(drop_any_null(rows))
    named = whole.withColumns({f"row_{c}": F.col(c) for c in ROW_KEY})
    hot = one_hot(named, [c for c in PLACES if c in named.columns])
    kept = {TARGET, *(f"row_{c}" for c in ROW_KEY)}
    matrix = drop_if_exists(hot, [c for c in exclude if c not in kept])
    return matrix, feature_columns(matrix, kept)


def validation_split(train: DataFrame, share: float, day: str) -> tuple[DataFrame, DataFrame]:
    """(fitting rows, validation rows): the last `share` of the training weeks validate."""
    marked = splits.split_by_date_quantile(train, 1 - share, day, "__part")
    return marked.where("__part = 'train'").drop("__part"), marked.where("__part = 'test'").drop("__part")


def forecast_comparison(
    features: DataFrame, cut: int, specs: Sequence[M.ModelSpec], *, validate: float = 0.2
) -> DataFrame:
    """Models for the future target; thresholds chosen for recall, best recall first.

    The last `validate` of the training weeks is kept from the fits and chooses the thresholds;
    the test rows are only reported on.  `validate=0` chooses them on the test rows.
    """
    common = in_both_periods(features, KEYS, cut, weekly_groups=True)
    matrix, columns = forecast_matrix(common)
    train, test = _train_test(matrix, cut)
    keep = [f"row_{c}" for c in ROW_KEY]
    if validate:
        train, held = validation_split(materialise(train), validate, f"row_{WEEK}")
    fitted = M.fit_models(train, columns, TARGET, specs)
    pred = materialise(M.score_models(fitted, test, TARGET, keep))
    tune = materialise(M.score_models(fitted, held, TARGET, keep)) if validate else pred
    table = V.tuned_comparison(
        tune, pred, ["model"], V.GRID_RECALL, "recall", V.DEFAULT_RECALL
    )
    return table.select("model", "auc", "recall", "threshold").orderBy(F.desc("recall"), "model")


@dataclass
class Tuned:
    """A grid search and its test evaluation; `sweep` is what the threshold was chosen on."""

    grid: DataFrame
    sweep: DataFrame
    threshold: float
    report: DataFrame
    importances: DataFrame
    search: M.Search


def held_out(search: M.Search, option: int, name: str) -> DataFrame:
    """(model, y, p) of the search's held-out folds for one option: rows that no fit has seen."""
    at = F.array_position("options", F.lit(option)).cast("int")
    rows = search.predictions.where(at > 0)
    return rows.select(F.lit(name).alias("model"), "y", F.get("stages", at - 1).alias("p"))


def _tuned(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    spec: M.ModelSpec,
    grid: Mapping[str, Sequence[Any]],
    folds,
    thresholds: Sequence[float],
    default: float,
    tune_on: str = "folds",
) -> Tuned:
    """The search, the threshold with the best F1, and the refitted model on the test rows.

    The threshold is chosen on the held-out folds of the best option, or with `tune_on="test"`
    on the rows that it is reported on.
    """
    search = M.grid_search(train, columns, TARGET, spec, grid, folds)
    best = search.best
    pred = materialise(
        best.score(test).select(F.lit(spec.name).alias("model"), F.col(TARGET).alias("y"), "p")
    )
    sweep = V.threshold_sweep(
        pred if tune_on == "test" else held_out(search, search.option, spec.name), thresholds, ["model"]
    )
    chosen = V.best_threshold(sweep, ["model"], "f1", default).first()["threshold"]
    flagged = pred.withColumn("yhat", classify("p", chosen, strict=False))
    report = V.classification_report(flagged, ["model"], "y", "yhat").join(
        V.auc(pred, ["model"]), "model"
    )
    return Tuned(search.results, sweep, chosen, report, topk.top_features(best.importances(), 20), search)


def forecast_grid(
    rows: DataFrame,
    cut: int,
    spec: M.ModelSpec,
    grid: Mapping[str, Sequence[Any]],
    thresholds: Sequence[float] = V.GRID_SHORT,
    default: float = V.DEFAULT_SHORT,
    tune_on: str = "folds",
) -> Tuned:
    """Grid search over expanding folds of the training years, evaluated on the rest."""
    matrix, columns = forecast_matrix(rows)
    train, test = _train_test(matrix, cut)
    blocked = splits.expanding_folds(
        train, 3, slices=("row_debutsem", "row_prov"), order=("row_maladie",)
    )
    return _tuned(
        blocked, test, columns, spec, grid, M.expanding_conditions(3), thresholds, default, tune_on
    )


def disease_models(master: DataFrame, cut: int, spec: M.ModelSpec, **gates: Any) -> DataFrame:
    """One model per disease on the forecast table, provinces as 0/1 columns."""
    table = materialise(ft.forecast_table(master, cut))
    hot = one_hot(table, [PROV])
    columns = feature_columns(hot, {*FORECAST_EXCLUDE, DISEASE})
    return M.train_per_group(hot, DISEASE, columns, TARGET, spec, cut, **gates)


def climate_only_study(
    features: DataFrame,
    disease: str,
    spec: M.ModelSpec,
    grid: Mapping[str, Sequence[Any]],
    weather: Sequence[str] = (*WEATHER, WIND),
) -> Tuned:
    """Weather, place and season only; split at the 80th percentile of the weeks.

    A weather column that the feature table does not have, such as the optional wind speed,
    is left out.
    """
    table = ordinal_encode(ft.climate_only_table(features, disease, weather=weather), [PROV])
    columns = feature_columns(table, {*CLIMATE_EXCLUDE, PROV}, CLIMATE_EXCLUDE_PREFIXES)
    rows = materialise(splits.split_by_date_quantile(table, 0.8))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    folded = splits.stratified_folds(train, 3, TARGET)
    return _tuned(
        folded, test, columns, spec, grid, M.stratified_conditions(3), V.GRID_LONG,
        V.DEFAULT_CLIMATE,
    )


def climate_driven_study(
    features: DataFrame, disease: str, spec: M.ModelSpec, grid: Mapping[str, Sequence[Any]]
) -> Tuned:
    """Whitelisted climate columns; the first 70 % of the rows in time order train."""
    table = ft.climate_driven_table(features, disease)
    columns = [c for c in CLIMATE_WHITELIST if c in table.columns]
    rows = materialise(splits.split_by_fraction(table, 0.7))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    folded = splits.stratified_folds(train, 3, TARGET)
    return _tuned(
        folded, test, columns, spec, grid, M.stratified_conditions(3), V.GRID_LONG,
        V.DEFAULT_CLIMATE,
    )


@dataclass
class Attribution:
    """Contributions of a boosted-tree model on the test rows."""

    base: float
    contributions: DataFrame
    importance: DataFrame
    by_disease: DataFrame
    top_by_disease: DataFrame
    examples: DataFrame
    dependence: DataFrame


def attribution(features: DataFrame, cut: int, spec: M.ModelSpec) -> Attribution:
    """Train on the early years, explain the late ones."""
    rows, columns = nowcast_matrix(features, cut)
    train, test = impute_median(rows.where(F.col(YEAR) <= cut), _train_test(rows, cut), columns)
    fitted = M.fit(train, columns, LABEL, spec)
    wide, base = X.tree_contributions(fitted.model, test, columns, [*ROW_KEY, *columns])
    wide = materialise(wide)
    importance = X.global_importance(wide)
    by_disease = X.group_importance(wide, DISEASE, exclude=(f"{DISEASE}_code",))
    scored = fitted.score(test).select(*ROW_KEY, F.col(LABEL).alias("y"), "p")
    flagged = scored.withColumn("yhat", classify("p", 0.2, strict=True))
    examples = topk.example_rows(flagged, ROW_KEY)
    shown = wide.join(F.broadcast(examples), list(ROW_KEY))  # two rows
    return Attribution(
        base,
        wide,
        importance,
        by_disease,
        topk.top_per_group(by_disease, [DISEASE], 3),
        topk.waterfall(shown, ["example", *ROW_KEY], 10),
        topk.dependence(wide, importance, ROW_KEY, 4),
    )
