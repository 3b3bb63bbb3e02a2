"""Queries: wide statistics, sketches, weeks by the calendar, training-only statistics, studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel.operators import calendar_weeks as W
from vigipanel.operators import sketches as K
from vigipanel.operators.encode import dictionary, medians
from vigipanel.operators.labels import outbreak_thresholds
from vigipanel.operators.wide import wide_quantiles
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.plans.catalog import CUT, INC, PANEL, feature_sql, items, query, r
from vigipanel.plans.q_groups import FORECAST, LINE_NUMBERS, THRESHOLD_BY, V5_KEPT
from vigipanel.plans.q_models import forecast_study
from vigipanel.plans.q_tables import ROW, V3_NAMES, V5_NAMES, incident
from vigipanel.schema import KEYS, WEEK
from vigipanel.session import materialise

# ---- wide statistics ---------------------------------------------------------------------------

V3_NUMBERS = [c for c in V3_NAMES if c not in ("prov", "maladie", "debutsem")]


@query(
    "a11_medians_of_all_features",
    f"""with {feature_sql(ft.V3, 'v3')}, wide as (select {', '.join(f'median({c}::double) as {c}' for c in V3_NUMBERS)}
      from v3 where inc_lag4 is not null)
    select feature, round(median, 6) + 0.0 as median
    from (select * from wide unpivot include nulls (median for feature in ({', '.join(V3_NUMBERS)})))""",
)
def a11_all(spark, sf):
    """Every numeric column of the v3 table, one pass, no row multiplied."""
    v3 = materialise(ft.features_v3(fx.master(spark, sf)).select(*V3_NUMBERS))
    return medians(v3, V3_NUMBERS)


@query(
    "a11_quantiles_by_cells",
    f"""with wide as (select {', '.join(f"quantile_cont({c}, {q}) as {c}_{n}" for c in LINE_NUMBERS for n, q in
        (('q1', 0.25), ('median', 0.5), ('p90', 0.9)))} from lineitem)
    {' union all '.join(f"select '{c}' as feature, " + ', '.join(f'round({c}_{n}, 6) + 0.0 as {n}' for n in ('q1', 'median', 'p90'))
        + ' from wide' for c in LINE_NUMBERS)}""",
)
def a11_cells(spark, sf):
    """The path for tables of any size: cells counted in one pass, then the cells that matter."""
    probs = {"q1": 0.25, "median": 0.5, "p90": 0.9}
    return wide_quantiles(fx.table(spark, sf, "lineitem"), LINE_NUMBERS, probs, steps=6)


@query(
    "a04_threshold_by_cells",
    THRESHOLD_BY.format(key="l_returnflag", v="l_extendedprice", t="lineitem"),
)
def a04_cells(spark, sf):
    """Three groups over all order lines, none of them gathered."""
    return outbreak_thresholds(fx.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", steps=6)


@query(
    "f01_dictionary",
    f"""with {PANEL}, v as (select distinct 'prov' as feature, prov as value from panel
      union all select distinct 'maladie', maladie from panel)
    select feature, value, cast(row_number() over (partition by feature order by value) - 1 as int) as code from v""",
)
def f01_dictionary(spark, sf):
    return dictionary(fx.panel(spark, sf), ["prov", "maladie"])


# ---- sketches -----------------------------------------------------------------------------------

RANKS = {"q1": 0.25, "q3": 0.75, "p90": 0.9}


def near_ranks(spark, sf, keys, rows, value, sketches):
    """Whether each quantile of the merged sketches lies within the stated rank error."""
    found = K.sketch_thresholds(sketches, keys)
    joined = rows.dropna(subset=[*keys, value]).join(found, keys)
    at = {n: (F.sum((F.col(value) < F.col(n)).cast("int")), F.sum((F.col(value) <= F.col(n)).cast("int"))) for n in RANKS}
    counts = joined.groupBy(*keys).agg(F.count("*").alias("size"), *[c.alias(f"{n}_{i}") for n, pair in at.items() for i, c in enumerate(pair)])
    # One row of a small group is more than the error of a large one.
    slack = F.greatest(K.RANK_ERROR * F.col("size"), F.lit(1.0))
    near = F.lit(True)
    for n, q in RANKS.items():
        near = near & (F.col(f"{n}_0") - slack <= q * F.col("size")) & (F.col(f"{n}_1") + slack >= q * F.col("size"))
    return counts.select(*keys, "size", near.alias("within"))


@query(
    "a04_sketch_thresholds",
    "select l_returnflag, count(*) as size, true as within from lineitem group by 1",
)
def a04_sketch(spark, sf):
    """Sketches per flag and ship month, merged per flag: no rows are read for the thresholds."""
    rows = fx.table(spark, sf, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    stored = materialise(K.sketch_values(rows, ["l_returnflag", "month"], "l_extendedprice"))
    return near_ranks(spark, sf, ["l_returnflag"], rows, "l_extendedprice", stored)


@query(
    "a03_sketch_thresholds",
    f"with {INC} select prov, maladie, count(incidence) as size, true as within from inc where annee <= {CUT} group by 1, 2 having count(incidence) > 0",
)
def a03_sketch(spark, sf):
    """Sketches per group and week, merged over the training weeks of each group."""
    rows = incident(spark, sf)
    stored = materialise(K.sketch_values(rows, [*KEYS, WEEK], "incidence"))
    early = F.year(WEEK) <= CUT
    return near_ranks(spark, sf, list(KEYS), rows.where(early), "incidence", stored.where(early))


# ---- weeks by the calendar ----------------------------------------------------------------------

DENSE = f"""{INC}, ends as (select prov, maladie, min(debutsem) as low, max(debutsem) as high from inc group by 1, 2),
weeks as (select prov, maladie, cast(unnest(generate_series(low, high, interval 7 day)) as date) as debutsem from ends),
dense as (select w.prov, w.maladie, w.debutsem, totalcas, incidence, totalcas is not null as reported
  from weeks w left join inc using (prov, maladie, debutsem))"""
DENSE_W = "partition by prov, maladie order by debutsem"


@query(
    "w14_dense_weeks",
    f"""with {DENSE} select prov, maladie, debutsem, totalcas, reported, cast(month(debutsem) as int) as mois from dense""",
)
def w14_dense(spark, sf):
    """A row for every week of a group, also for those that were not reported."""
    panel = fx.panel(spark, sf).select(*ROW, "mois", "totalcas")
    return W.densify(panel, KEYS, WEEK, {"mois": F.month(WEEK)}, "reported")


CALENDAR = ", ".join(
    [f"lag(incidence, {k}) over ({DENSE_W}) as inc_lag{k}" for k in (1, 4)]
    + [f"avg(incidence) over ({DENSE_W} rows between 8 preceding and 1 preceding) as inc_roll8"]
    + [f"lead(totalcas, 4) over ({DENSE_W}) as cases_in_4"]
)
CALENDAR_ROWS = f"with {DENSE}, c as (select *, {CALENDAR} from dense) select prov, maladie, debutsem, {r('inc_lag1', 'inc_lag4', 'inc_roll8')}, cases_in_4 from c"


def calendar_columns():
    made = {f"inc_lag{k}": W.calendar_lag("incidence", k, KEYS, WEEK) for k in (1, 4)}
    made["inc_roll8"] = W.calendar_rolling("incidence", "mean", 8, 1, KEYS, WEEK)
    return made | {"cases_in_4": W.calendar_lag("totalcas", -4, KEYS, WEEK)}


@query("w14_calendar_lags", f"{CALENDAR_ROWS} where reported")
def w14_calendar(spark, sf):
    """Lags, means and a target by date, on the panel as it is."""
    out = W.add_calendar(incident(spark, sf), calendar_columns(), KEYS, WEEK, back=8, ahead=4)
    return out.select(*ROW, *calendar_columns())


@query("w14_calendar_lags_dense", CALENDAR_ROWS)
def w14_calendar_dense(spark, sf):
    """The same over the dense panel, where row and date agree."""
    dense = W.densify(incident(spark, sf).select(*ROW, "totalcas", "incidence"), KEYS, WEEK)
    return W.add_calendar(dense, calendar_columns(), KEYS, WEEK, back=8, ahead=4).select(*ROW, *calendar_columns())


# ---- training-only statistics ---------------------------------------------------------------------


def early_sql(spec, name):
    """The feature table with thresholds and means of the training years only."""
    sql = feature_sql(spec, name)
    for q in (0.25, 0.75, 0.9):
        sql = sql.replace(f"quantile_cont(incidence, {q})", f"quantile_cont(case when annee <= {CUT} then incidence end, {q})")
    for c in ("prectotcorr", "t2m", "rh2m"):
        sql = sql.replace(f"- avg({c}) over", f"- avg(case when annee <= {CUT} then {c} end) over")
    return sql


@query(
    "features_v3_fit_on_train",
    f"with {early_sql(ft.V3, 'v3')} select {items(V3_NAMES)} from v3 where inc_lag4 is not null",
)
def features_v3_early(spark, sf):
    return ft.features_v3(fx.master(spark, sf), F.col("annee") <= CUT).select(*V3_NAMES)


@query(
    "features_v5_fit_on_train",
    f"with {early_sql(ft.V5, 'v5')} select {items(V5_NAMES)} from v5 where {V5_KEPT}",
)
def features_v5_early(spark, sf):
    return ft.features_v5(fx.master(spark, sf), F.col("annee") <= CUT).select(*V5_NAMES)


# ---- studies -----------------------------------------------------------------------------------------

REPORTED = """select class, cast(case class when '0' then n0 when '1' then n1 else n0 + n1 end as bigint) as support, true as rates_fit
  from t, (values ('0'), ('1'), ('accuracy'), ('macro avg'), ('weighted avg')) c(class)"""


def report_of(found):
    fit = F.lit(True)
    for name in ("precision", "recall", "f1", "auc"):
        fit = fit & F.coalesce(F.col(name).between(0, 1), F.lit(True))
    return found.report.select("class", "support", fit.alias("rates_fit"))


@query(
    "study_forecast_grid",
    f"""with {FORECAST}, t as (select count_if(target_outbreak_future = 0) as n0, count_if(target_outbreak_future = 1) as n1
      from forecast where annee > {CUT}) {REPORTED}""",
)
def study_forecast_grid(spark, sf):
    """Full grid over expanding folds, threshold from the held-out folds, report on the late years."""
    return report_of(forecast_study(spark, sf))
