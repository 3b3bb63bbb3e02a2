"""Feature tables: which lags, windows and signals each variant has.

Every build is one exchange on (prov, maladie): thresholds and climate means are
windows over the same keys as the lags, and the label's own lead or lag comes from
the sorted rows that are already there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.functions import scalar as S
from vigipanel.functions.columns import drop_any_null, drop_warmup
from vigipanel.operators.groups import add_anomaly, attach_stats, in_both_periods
from vigipanel.operators.labels import label_outbreaks, outbreak_thresholds, window_threshold
from vigipanel.operators.windows import Built, lag, lead, rolling, with_ordered
from vigipanel.schema import (
    CLIMATE_WHITELIST,
    KEYS,
    LABEL,
    TARGET,
    WEATHER,
    WEEK,
)
from vigipanel.session import TASK_ROWS, materialise, small_side


@dataclass(frozen=True)
class FeatureSpec:
    """What one feature table holds."""

    inc_lags: Sequence[int]
    inc_rolls: Sequence[int]
    weather_lags: Sequence[int]
    volatility_min: int
    warmup: Sequence[str]
    interactions: bool = True
    long_trend: bool = False
    early_signals: bool = False
    horizon: int | None = None
    weather: Sequence[str] = field(default=WEATHER)


V3 = FeatureSpec((1, 2, 3, 4), (4, 8, 12), (1, 2), 4, ("inc_lag4",))
V4 = FeatureSpec(
    tuple(range(1, 9)),
    (4, 8, 12, 16),
    tuple(range(1, 9)),
    2,
    ("inc_lag8",),
    long_trend=True,
)
V5 = FeatureSpec(
    (1, 2, 3, 4),
    (4, 8, 12),
    (1, 2, 3, 4, 6, 8),
    4,
    ("inc_lag4", TARGET),
    interactions=False,
    early_signals=True,
    horizon=4,
)

# One row per key and week; rows without a key are dropped, as the warm-up rule would do.
WEEKLY = {"weekly_groups": True, "null_keys": "drop"}
VOLATILITY = {"temp_volatility": "t2m", "rain_volatility": "prectotcorr"}


def _season() -> dict[str, Column]:
    sin, cos = S.cyclic("mois", 12)
    return {"month_sin": sin, "month_cos": cos}


def _names(spec: FeatureSpec) -> list[str]:
    """Column order of the finished table."""
    names = ["incidence", LABEL] + ([TARGET] if spec.horizon else [])
    names += [f"inc_lag{k}" for k in spec.inc_lags] + [f"inc_roll{w}" for w in spec.inc_rolls]
    if spec.early_signals:
        names += ["inc_acceleration", "inc_growth", "inc_anomaly"]
    names += ["inc_trend"] + (["inc_trend_long"] if spec.long_trend else [])
    names += [f"{c}_lag{k}" for c in spec.weather for k in spec.weather_lags]
    names += [f"{c}_anom" for c in spec.weather]
    names += ["rain_temp", "hum_temp"] if spec.interactions else []
    return names + [*VOLATILITY, "month_sin", "month_cos"]


def build_features(
    master: DataFrame,
    spec: FeatureSpec,
    keys: Sequence[str] = KEYS,
    order: str = WEEK,
    *,
    keep_warmup: bool = False,
    weekly_groups: bool = True,
    limit: int = TASK_ROWS,
    fit_until: Column | None = None,
) -> DataFrame:
    """Incidence, label, lags, rolling means, signals, climate columns, season.

    `fit_until` is a condition on the rows, for example the training years: thresholds and the
    means that anomalies refer to are then taken from these rows alone, still as windows over
    the same exchange.  A group without such rows has no threshold (label 0) and no anomalies.

    With `weekly_groups=False` nothing is assumed about the groups: thresholds and means
    are aggregated and joined back, and groups over `limit` rows are cut into runs.
    """
    base = master.withColumn("incidence", S.incidence("totalcas", "pop"))
    reach = {"null_keys": "drop", "weekly_groups": weekly_groups, "limit": limit}
    ordered: dict[str, Built] = {f"inc_lag{k}": lag("incidence", k) for k in spec.inc_lags}
    for w in spec.inc_rolls:
        ordered[f"inc_roll{w}"] = rolling("incidence", "mean", w, 1, 1)
    for c in spec.weather:
        ordered |= {f"{c}_lag{k}": lag(c, k) for k in spec.weather_lags}
    for name, c in VOLATILITY.items():
        ordered[name] = rolling(c, "std", 4, 0, spec.volatility_min)
    back = max(*spec.inc_lags, *spec.inc_rolls, *spec.weather_lags, 4)
    fitted = (lambda c: F.col(c)) if fit_until is None else (lambda c: F.when(fit_until, F.col(c)))
    means = {f"__{c}_mean": F.avg(fitted(c)) for c in spec.weather}
    if weekly_groups:
        group = Window.partitionBy(*keys)
        ordered["__limit"] = lambda w: window_threshold(keys, "incidence", fit_until)
        ordered |= {n: (lambda w, m=m: m.over(group)) for n, m in means.items()}
    else:
        base = materialise(base)
        source = base if fit_until is None else base.where(fit_until)
        limits = outbreak_thresholds(source, keys, "incidence").withColumnRenamed(
            "threshold", "__limit"
        )
        base = base.join(small_side(limits), list(keys), "left")
        base = attach_stats(base, keys, means)
    wide = with_ordered(base, ordered, keys, order, back=back, **reach)

    derived = {
        LABEL: S.exceeds("incidence", F.col("__limit")),
        "inc_trend": S.difference("inc_lag1", "inc_roll4"),
        **{f"{c}_anom": S.difference(c, f"__{c}_mean") for c in spec.weather},
        **_season(),
    }
    if spec.long_trend:
        derived["inc_trend_long"] = S.difference("inc_lag1", "inc_roll12")
    if spec.early_signals:
        derived["inc_acceleration"] = S.difference("inc_lag1", "inc_lag3")
        derived["inc_growth"] = S.growth("inc_lag1", "inc_lag2", 1e-6)
        derived["inc_anomaly"] = S.difference("inc_lag1", "inc_roll12")
    if spec.interactions:
        derived["rain_temp"] = S.product("prectotcorr", "t2m")
        derived["hum_temp"] = S.product("rh2m", "t2m")
    out = wide.withColumns(derived)
    if spec.horizon:
        target = {TARGET: lead(LABEL, spec.horizon)}
        out = with_ordered(out, target, keys, order, back=0, ahead=spec.horizon, **reach)
    out = out.select(*master.columns, *_names(spec))
    return out if keep_warmup else drop_warmup(out, spec.warmup)


def features_v3(master: DataFrame, fit_until: Column | None = None) -> DataFrame:
    return build_features(master, V3, fit_until=fit_until)


def features_v4(master: DataFrame, fit_until: Column | None = None) -> DataFrame:
    return build_features(master, V4, fit_until=fit_until)


def features_v5(master: DataFrame, fit_until: Column | None = None) -> DataFrame:
    return build_features(master, V5, fit_until=fit_until)


def features_fallback(master: DataFrame, fit_until: Column | None = None) -> DataFrame:
    """Count-based features, with a label per disease on raw counts.

    A disease is a coarse key, so its threshold is found without gathering it.
    """
    labelled = label_outbreaks(master, ["maladie"], "totalcas", fit_until=fit_until)
    made: dict[str, Built] = {f"{c}_lag{k}": lag(c, k) for c in WEATHER for k in (1, 2)}
    made |= {f"cases_lag{k}": lag("totalcas", k) for k in (1, 2, 3, 4)}
    made |= {f"cases_roll{w}": rolling("totalcas", "mean", w, 1, 1) for w in (4, 8, 12)}
    made |= {f"outbreak_lag{k}": lag(LABEL, k) for k in (1, 2)}
    out = with_ordered(labelled, made, KEYS, WEEK, back=12, **WEEKLY).withColumns(
        {"cases_trend": S.difference("cases_lag1", "cases_roll4"), **_season()}
    )
    return drop_warmup(out, ["cases_lag4", "outbreak_lag2"])


def history_columns(value: str = "incidence", label: str = LABEL) -> dict[str, Built]:
    """Longer lags, full-window rolling statistics and the count of recent outbreaks."""
    made: dict[str, Built] = {f"case_lag_{k}": lag(value, k) for k in (1, 2, 3, 4, 8, 12)}
    for w in (4, 8):
        made[f"rolling_mean_{w}"] = rolling(value, "mean", w, 1, w)
        made[f"rolling_std_{w}"] = rolling(value, "std", w, 1, w)
    made["outbreak_persistence"] = rolling(label, "sum", 4, 1, 4)
    return made


def add_history(df: DataFrame) -> DataFrame:
    return with_ordered(df, history_columns(), KEYS, WEEK, back=12, **WEEKLY).withColumn(
        "case_growth", S.growth("case_lag_1", "case_lag_4", 1.0)
    )


def forecast_table(master: DataFrame, cut: int, fit_until: Column | None = None) -> DataFrame:
    """v5 features of groups present in both periods, plus history, without missing values.

    The history is taken after the warm-up rows are gone, so it has a warm-up of its own.
    """
    common = in_both_periods(features_v5(master, fit_until), KEYS, cut, weekly_groups=True)
    return drop_any_null(add_history(common))


def climate_only_table(
    features: DataFrame, disease: str, horizon: int = 2, weather: Sequence[str] = WEATHER
) -> DataFrame:
    """One disease, target `horizon` rows ahead per province, weather and season columns.

    The last rows of a province have no target and go before lags and the monthly
    climatology are taken.  The climatology has twelve groups, so it is an aggregate
    joined back; a window would leave it to twelve tasks.
    """
    one = features.where(F.col("maladie") == disease).drop(TARGET)
    target = {TARGET: lead(LABEL, horizon)}
    targeted = with_ordered(
        one, target, ["prov"], WEEK, back=0, ahead=horizon, **WEEKLY
    ).dropna(subset=[TARGET])
    sin_week, cos_week = S.cyclic("week", 52)
    sin_month, cos_month = S.cyclic("month", 12)
    dated = targeted.withColumns({"week": S.iso_week(WEEK), "month": F.month(WEEK)}).withColumns(
        {
            "sin_week": sin_week,
            "cos_week": cos_week,
            "sin_month": sin_month,
            "cos_month": cos_month,
        }
    )
    weather = [c for c in weather if c in dated.columns]
    made: dict[str, Built] = {f"{c}_lag{k}": lag(c, k) for c in weather for k in (1, 2, 4, 6)}
    made |= {f"{c}_roll4": rolling(c, "mean", 4, 0, 4) for c in weather}
    lagged = with_ordered(dated, made, ["prov"], WEEK, back=6, **WEEKLY)
    return drop_any_null(add_anomaly(lagged, weather, ["month"]))


def add_climate_volatility(df: DataFrame, k: int = 4) -> DataFrame:
    """|value k rows ago - value| from the lag columns of the feature table."""
    names: Mapping[str, str] = {
        "t2m": "temp_volatility",
        "prectotcorr": "rain_volatility",
        "rh2m": "rh_volatility",
    }
    return df.withColumns(
        {new: F.abs(F.col(f"{c}_lag{k}") - F.col(c)) for c, new in names.items()}
    )


def climate_driven_table(features: DataFrame, disease: str) -> DataFrame:
    """One disease with the whitelisted climate columns and the future target."""
    one = add_climate_volatility(features.where(F.col("maladie") == disease))
    kept = [c for c in CLIMATE_WHITELIST if c in one.columns]
    order = [c for c in ("annee", "mois", "prov", "maladie", WEEK) if c not in kept]
    return one.select(*order, *kept, TARGET).dropna(subset=[*kept, TARGET])
