"""Queries: joins, aggregations, windows, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel.functions import scalar as S
from vigipanel.operators import groups as G
from vigipanel.operators import reports as R
from vigipanel.operators.encode import decode, medians, ordinal_codes, ordinal_encode
from vigipanel.operators.labels import label_outbreaks, outbreak_thresholds, window_threshold
from vigipanel.operators.selection import correlations, variances
from vigipanel.operators.splits import split_by_year
from vigipanel.operators.windows import (
    add_future_target, add_lags, add_rolling, lag, rolling, with_ordered,
)
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.plans.catalog import (
    CUT, INC, K, MASTER, MASTER_COLUMNS, PANEL, PANEL_COLUMNS, W, WEATHER_CTE, feature_sql, items,
    lag_sql, query, r, roll,
)
from vigipanel.plans.q_tables import ROW, V3_NAMES, V4_NAMES, V5_NAMES, incident, labelled
from vigipanel.schema import KEYS, WEATHER, WEEK
from vigipanel.session import materialise
from vigipanel.sources import weather as wx

# ---- joins ----------------------------------------------------------------------------------


@query("j01_join_weather", f"with {MASTER} select {items(MASTER_COLUMNS)} from master")
def j01(spark, sf):
    return fx.master(spark, sf).select(*MASTER_COLUMNS)


@query(
    "j02_attach_group_stats",
    f"""with {PANEL} select prov, maladie, debutsem,
        round(avg(totalcas) over ({K}), 6) + 0.0 as mean_cases,
        max(totalcas) over ({K}) as max_cases from panel""",
)
def j02(spark, sf):
    stats = {"mean_cases": F.avg("totalcas"), "max_cases": F.max("totalcas")}
    return G.attach_stats(fx.panel(spark, sf), KEYS, stats).select(*ROW, *stats)


@query(
    "j03_diseases_in_both_periods",
    f"""with {PANEL} select {items(PANEL_COLUMNS)} from panel where maladie in (
      select maladie from panel where annee <= 1994 intersect
      select maladie from panel where annee > 1994)""",
)
def j03(spark, sf):
    return G.in_both_periods(fx.panel(spark, sf), ["maladie"], 1994).select(*PANEL_COLUMNS)


@query(
    "j04_groups_in_both_periods",
    f"""with {PANEL}, both_keys as (
      select prov, maladie from panel where annee <= 1994 intersect
      select prov, maladie from panel where annee > 1994)
    select {items(PANEL_COLUMNS)} from panel semi join both_keys using (prov, maladie)""",
)
def j04(spark, sf):
    both = G.in_both_periods(fx.panel(spark, sf), KEYS, 1994, weekly_groups=True)
    return both.select(*PANEL_COLUMNS)


@query(
    "j05_one_period_only",
    f"""with {PANEL} select prov, maladie from panel group by 1, 2
    having max(cast(annee <= 1994 as int)) + max(cast(annee > 1994 as int)) = 1""",
)
def j05(spark, sf):
    return G.only_one_period(fx.panel(spark, sf), KEYS, 1994)


@query(
    "j07_decode",
    f"""with {PANEL} select prov, debutsem, maladie, totalcas from panel""",
)
def j07(spark, sf):
    panel = fx.panel(spark, sf)
    coded = ordinal_encode(panel, ["maladie"]).drop("maladie")
    codes = ordinal_codes(panel, "maladie")
    return decode(coded, codes, "maladie_code", "maladie").select(
        "prov", "debutsem", "maladie", "totalcas"
    )


# ---- aggregations ------------------------------------------------------------------------------


@query("a01_distinct_locations", f"with {PANEL} select distinct prov, {r('lat', 'lon')} from panel")
def a01(spark, sf):
    return wx.distinct_locations(fx.panel(spark, sf))


@query(
    "a02_pivot_weather",
    f"""with {WEATHER_CTE}, long as (
      unpivot weather on prectotcorr, t2m, rh2m into name param value value)
    select prov, annee, mois,
      round(avg(value) filter (param = 'prectotcorr'), 8) + 0.0 as prectotcorr,
      round(avg(value) filter (param = 't2m'), 8) + 0.0 as t2m,
      round(avg(value) filter (param = 'rh2m'), 8) + 0.0 as rh2m from long group by all""",
)
def a02(spark, sf):
    return wx.pivot_weather(fx.weather_rows(spark, sf))


LIMITS = f"select prov, maladie, round(threshold, 9) + 0.0 as threshold_inc from limits"


@query("a03_hybrid_threshold", f"with {INC} {LIMITS}")
def a03(spark, sf):
    limits = outbreak_thresholds(incident(spark, sf), KEYS, "incidence", weekly_groups=True)
    return limits.withColumnRenamed("threshold", "threshold_inc")


THRESHOLD_BY = """select {key}, round(greatest(q3 + 1.5 * (q3 - q1), p90), 6) + 0.0 as threshold
  from (select {key}, quantile_cont({v}, 0.25) as q1, quantile_cont({v}, 0.75) as q3,
               quantile_cont({v}, 0.9) as p90 from {t} group by 1)"""


@query(
    "a04_threshold_per_disease",
    f"with {PANEL} " + THRESHOLD_BY.format(key="maladie", v="totalcas::double", t="panel"),
)
def a04(spark, sf):
    return outbreak_thresholds(fx.panel(spark, sf), ["maladie"], "totalcas")


@query(
    "a04_threshold_hot_groups",
    THRESHOLD_BY.format(key="l_returnflag", v="l_extendedprice", t="lineitem"),
)
def a04_hot(spark, sf):
    """Three groups over all order lines: each holds a third of the rows."""
    return outbreak_thresholds(
        fx.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"
    )


@query(
    "a05_group_means",
    f"""with {MASTER} select prov, maladie, {', '.join(f'round(avg({c}), 6) + 0.0 as mean_{c}' for c in WEATHER)}
    from master group by 1, 2""",
)
def a05(spark, sf):
    return fx.master(spark, sf).groupBy(*KEYS).agg(*[F.avg(c).alias(f"mean_{c}") for c in WEATHER])


@query(
    "a06_month_climatology",
    f"""with {MASTER} select mois, {', '.join(f'round(avg({c}), 6) + 0.0 as mean_{c}' for c in WEATHER)}
    from master group by 1""",
)
def a06(spark, sf):
    return fx.master(spark, sf).groupBy("mois").agg(*[F.avg(c).alias(f"mean_{c}") for c in WEATHER])


@query(
    "a07_profile",
    f"""with {INC} select count(*) as n_rows, 12 as n_columns, min(annee) as first_year,
      max(annee) as last_year, count(distinct prov) as provinces,
      count(distinct maladie) as diseases, round(avg(is_outbreak), 6) + 0.0 as outbreak_rate
    from labelled""",
)
def a07(spark, sf):
    return R.profile(labelled(spark, sf))


@query(
    "a08_null_report",
    f"""with {MASTER}, wide as (select
      {', '.join(f'count(*) - count({c}) as {c}' for c in MASTER_COLUMNS)} from master)
    select column_name, missing from
      (unpivot wide on {', '.join(MASTER_COLUMNS)} into name column_name value missing)
    where missing > 0""",
)
def a08(spark, sf):
    return R.null_report(fx.master(spark, sf), MASTER_COLUMNS)


@query(
    "a09_class_balance",
    f"""with {INC} select count(*) filter (is_outbreak = 0) as negatives,
      count(*) filter (is_outbreak = 1) as positives,
      round(count(*) filter (is_outbreak = 0) / (count(*) filter (is_outbreak = 1)), 6) + 0.0 as ratio
    from labelled where annee <= {CUT}""",
)
def a09(spark, sf):
    return R.class_balance(labelled(spark, sf).where(F.col("annee") <= CUT), "is_outbreak")


@query(
    "a10_split_report",
    f"""with {INC} select case when annee <= {CUT} then 'train' else 'test' end as split,
      count(*) as n_rows, round(avg(is_outbreak), 6) + 0.0 as outbreak_rate
    from labelled group by 1""",
)
def a10(spark, sf):
    return R.split_report(split_by_year(labelled(spark, sf), CUT), "is_outbreak")


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "a11_medians",
    f"""with wide as (select {', '.join(f'median({c}) as {c}' for c in LINE_NUMBERS)} from lineitem)
    select feature, round(median, 6) + 0.0 as median
    from (unpivot wide on {', '.join(LINE_NUMBERS)} into name feature value median)""",
)
def a11(spark, sf):
    return medians(fx.table(spark, sf, "lineitem"), LINE_NUMBERS)


@query(
    "a12_variances",
    f"""with wide as (select {', '.join(f'var_samp({c}) as {c}' for c in LINE_NUMBERS)} from lineitem)
    select feature, round(variance, 4) + 0.0 as variance
    from (unpivot wide on {', '.join(LINE_NUMBERS)} into name feature value variance)""",
)
def a12(spark, sf):
    return variances(fx.table(spark, sf, "lineitem"), LINE_NUMBERS).select(
        "feature", F.round("variance", 4).alias("variance")
    )


CORR = ("inc_lag1", "inc_lag2", "inc_lag3", "inc_roll4", "inc_roll8", "inc_trend", "t2m", "t2m_lag1",
        "rh2m", "prectotcorr", "temp_volatility", "month_sin")


def corr_sql(columns=CORR) -> str:
    parts = [
        f"select {i} as i, {j} as j, '{a}' as a, '{b}' as b, corr({a}, {b}) as r from train"
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    return " union all ".join(parts)


TRAIN_V3 = f"""{feature_sql(ft.V3, 'v3')},
train as (select * from v3 where inc_lag4 is not null and annee <= {CUT})"""


def train_v3(spark, sf):
    return ft.features_v3(fx.master(spark, sf)).where(F.col("annee") <= CUT)


@query(
    "a13_correlations",
    f"with {TRAIN_V3}, p as ({corr_sql()}) select i, j, a, b, round(r, 6) + 0.0 as r from p",
)
def a13(spark, sf):
    return correlations(materialise(train_v3(spark, sf).select(*CORR)), CORR)


@query(
    "a14_scaling_stats",
    f"""with {MASTER} select {', '.join(
        f"round(avg({c}), 6) + 0.0 as m_{c}, round(stddev_pop({c}), 6) + 0.0 as s_{c}" for c in WEATHER
    )} from master where annee <= {CUT}""",
)
def a14(spark, sf):
    train = fx.master(spark, sf).where(F.col("annee") <= CUT)
    return train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in WEATHER],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in WEATHER],
    )


@query(
    "a18_positive_count",
    f"""with {INC} select maladie, cast(sum(is_outbreak) as bigint) as outbreaks from labelled
    group by 1""",
)
def a18(spark, sf):
    return labelled(spark, sf).groupBy("maladie").agg(
        F.sum("is_outbreak").cast("bigint").alias("outbreaks")
    )


@query(
    "a19_drop_report",
    f"""with {INC}, t as (select {lag_sql('incidence', 4)} as inc_lag4 from labelled)
    select count(*) as before, count(inc_lag4) as after, count(*) - count(inc_lag4) as dropped
    from t""",
)
def a19(spark, sf):
    made = {"inc_lag4": lag("incidence", 4)}
    lagged = with_ordered(incident(spark, sf), made, KEYS, WEEK, back=4, weekly_groups=True)
    return R.drop_report(lagged, R.complete(["inc_lag4"]))


# ---- windows -----------------------------------------------------------------------------------


@query(
    "w01_incidence_lags",
    f"""with {INC}, t as (select prov, maladie, debutsem,
      {', '.join(f"{lag_sql('incidence', k)} as inc_lag{k}" for k in (1, 2, 3, 4, 8, 12))} from inc)
    select prov, maladie, debutsem, {r(*[f'inc_lag{k}' for k in (1, 2, 3, 4, 8, 12)])} from t""",
)
def w01(spark, sf):
    lags = (1, 2, 3, 4, 8, 12)
    out = add_lags(incident(spark, sf), ["incidence"], lags, KEYS, WEEK, "inc_lag{k}", weekly_groups=True)
    return out.select(*ROW, *[f"inc_lag{k}" for k in lags])


@query(
    "w02_weather_lags",
    f"""with {MASTER}, t as (select prov, maladie, debutsem,
      {', '.join(f"{lag_sql(c, k)} as {c}_lag{k}" for c in WEATHER for k in (1, 2, 8))} from master)
    select prov, maladie, debutsem, {r(*[f'{c}_lag{k}' for c in WEATHER for k in (1, 2, 8)])} from t""",
)
def w02(spark, sf):
    out = add_lags(fx.master(spark, sf), WEATHER, (1, 2, 8), KEYS, WEEK, weekly_groups=True)
    return out.select(*ROW, *[f"{c}_lag{k}" for c in WEATHER for k in (1, 2, 8)])


@query(
    "w03_future_target",
    f"""with {INC} select prov, maladie, debutsem, is_outbreak,
      cast(lead(is_outbreak, 4) over ({W}) as double) as target_outbreak_future from labelled""",
)
def w03(spark, sf):
    out = add_future_target(
        labelled(spark, sf), "is_outbreak", 4, KEYS, WEEK, "target_outbreak_future",
        weekly_groups=True,
    )
    return out.select(*ROW, "is_outbreak", F.col("target_outbreak_future").cast("double"))


@query(
    "w03_future_target_per_province",
    f"""with {INC} select prov, maladie, debutsem,
      cast(lead(is_outbreak, 2) over (partition by prov order by debutsem) as double)
        as target_outbreak_future
    from labelled where maladie = 'MACHINERY'""",
)
def w03b(spark, sf):
    one = labelled(spark, sf).where("maladie = 'MACHINERY'")
    out = add_future_target(
        one, "is_outbreak", 2, ["prov"], WEEK, "target_outbreak_future", weekly_groups=True
    )
    return out.select(*ROW, F.col("target_outbreak_future").cast("double"))


@query(
    "w04_case_lags",
    f"""with {PANEL} select prov, maladie, debutsem,
      {', '.join(f"cast({lag_sql('totalcas', k)} as double) as cases_lag{k}" for k in (1, 2, 3, 4))}
    from panel""",
)
def w04(spark, sf):
    out = add_lags(
        fx.panel(spark, sf), ["totalcas"], (1, 2, 3, 4), KEYS, WEEK, "cases_lag{k}",
        weekly_groups=True,
    )
    return out.select(*ROW, *[F.col(f"cases_lag{k}").cast("double") for k in (1, 2, 3, 4)])


@query(
    "w05_outbreak_lags",
    f"""with {INC} select prov, maladie, debutsem,
      cast({lag_sql('is_outbreak', 1)} as double) as outbreak_lag1,
      cast({lag_sql('is_outbreak', 2)} as double) as outbreak_lag2 from labelled""",
)
def w05(spark, sf):
    out = add_lags(
        labelled(spark, sf), ["is_outbreak"], (1, 2), KEYS, WEEK, "outbreak_lag{k}",
        weekly_groups=True,
    )
    return out.select(*ROW, *[F.col(f"outbreak_lag{k}").cast("double") for k in (1, 2)])


@query(
    "w06_rolling_mean_lagged",
    f"""with {INC}, t as (select prov, maladie, debutsem,
      {', '.join(f"{roll('avg', 'incidence', w)} as inc_roll{w}" for w in (4, 8, 12, 16))} from inc)
    select prov, maladie, debutsem, {r(*[f'inc_roll{w}' for w in (4, 8, 12, 16)])} from t""",
)
def w06(spark, sf):
    out = add_rolling(
        incident(spark, sf), "incidence", "mean", (4, 8, 12, 16), KEYS, WEEK, "inc_roll{w}",
        weekly_groups=True,
    )
    return out.select(*ROW, *[f"inc_roll{w}" for w in (4, 8, 12, 16)])


ROLL_FULL = ", ".join(
    f"{roll(fn, 'incidence', w, 1, w)} as rolling_{n}_{w}"
    for w in (4, 8)
    for n, fn in (("mean", "avg"), ("std", "stddev_samp"))
)
ROLL_NAMES = ("rolling_mean_4", "rolling_std_4", "rolling_mean_8", "rolling_std_8")


@query(
    "w07_rolling_full_window",
    f"""with {INC}, t as (select prov, maladie, debutsem, {ROLL_FULL} from inc)
    select prov, maladie, debutsem, {r(*ROLL_NAMES)} from t""",
)
def w07(spark, sf):
    out = incident(spark, sf)
    for how in ("mean", "std"):
        out = add_rolling(
            out, "incidence", how, (4, 8), KEYS, WEEK, f"rolling_{how}_{{w}}", min_periods=None,
            **ft.WEEKLY,
        )
    return out.select(*ROW, *ROLL_NAMES)


ANOM = tuple(f"{c}_anom" for c in WEATHER)


@query(
    "w08_group_anomaly",
    f"""with {MASTER}, t as (select prov, maladie, debutsem,
      {', '.join(f'{c} - avg({c}) over ({K}) as {c}_anom' for c in WEATHER)} from master)
    select prov, maladie, debutsem, {r(*ANOM)} from t""",
)
def w08(spark, sf):
    out = G.add_anomaly(fx.master(spark, sf), WEATHER, KEYS, weekly_groups=True)
    return out.select(*ROW, *ANOM)


@query(
    "w09_month_anomaly",
    f"""with {MASTER}, t as (select prov, maladie, debutsem,
      {', '.join(f'{c} - avg({c}) over (partition by mois) as {c}_anom' for c in WEATHER)} from master)
    select prov, maladie, debutsem, {r(*ANOM)} from t""",
)
def w09(spark, sf):
    return G.add_anomaly(fx.master(spark, sf), WEATHER, ["mois"]).select(*ROW, *ANOM)


VOL = {f"{n}_volatility{m}": (c, m) for n, c in (("t2m", "t2m"), ("prectotcorr", "prectotcorr"))
       for m in (4, 2)}


@query(
    "w10_volatility",
    f"""with {MASTER}, t as (select prov, maladie, debutsem, {', '.join(
        f"{roll('stddev_samp', c, 4, 0, m)} as {n}" for n, (c, m) in VOL.items())} from master)
    select prov, maladie, debutsem, {', '.join(f'round({n}, 6) + 0.0 as vol_{n}' for n in VOL)} from t""",
)
def w10(spark, sf):
    out = fx.master(spark, sf)
    for n, (c, m) in VOL.items():
        out = add_rolling(
            out, c, "std", (4,), KEYS, WEEK, f"vol_{n}", shift=0, min_periods=m, **ft.WEEKLY
        )
    return out.select(*ROW, *[f"vol_{n}" for n in VOL])


def roll_prov(c: str) -> str:
    f = "(partition by prov order by debutsem rows between 3 preceding and current row)"
    return f"case when count({c}) over {f} >= 4 then avg({c}) over {f} end as {c}_roll4"


@query(
    "w11_rolling_mean_current",
    f"""with {MASTER}, t as (select prov, maladie, debutsem, {', '.join(map(roll_prov, WEATHER))}
      from master where maladie = 'MACHINERY')
    select prov, maladie, debutsem, {r(*[f'{c}_roll4' for c in WEATHER])} from t""",
)
def w11(spark, sf):
    out = fx.master(spark, sf).where("maladie = 'MACHINERY'")
    for c in WEATHER:
        out = add_rolling(
            out, c, "mean", (4,), ["prov"], WEEK, f"{c}_roll{{w}}", shift=0, min_periods=4,
            **ft.WEEKLY,
        )
    return out.select(*ROW, *[f"{c}_roll4" for c in WEATHER])


@query(
    "w12_outbreak_persistence",
    f"""with {INC} select prov, maladie, debutsem,
      cast({roll('sum', 'is_outbreak', 4, 1, 4)} as double) as outbreak_persistence from labelled""",
)
def w12(spark, sf):
    out = add_rolling(
        labelled(spark, sf), "is_outbreak", "sum", (4,), KEYS, WEEK, "outbreak_persistence",
        min_periods=None, weekly_groups=True,
    )
    return out.select(*ROW, F.col("outbreak_persistence").cast("double"))


@query(
    "w13_outbreak_label",
    f"with {INC} select prov, maladie, debutsem, is_outbreak from labelled",
)
def w13(spark, sf):
    return labelled(spark, sf).select(*ROW, "is_outbreak")


@query(
    "w13_label_per_disease",
    f"""with {PANEL}, q as ({THRESHOLD_BY.format(key='maladie', v='totalcas::double', t='panel')
        .replace('round(', '(').replace(', 6) + 0.0', ')')})
    select prov, maladie, debutsem, cast(totalcas > threshold as int) as is_outbreak
    from panel join q using (maladie)""",
)
def w13b(spark, sf):
    return label_outbreaks(fx.panel(spark, sf), ["maladie"], "totalcas").select(*ROW, "is_outbreak")


@query(
    "w13_label_fit_on_train",
    f"""with {INC}, train_limits as (
      select prov, maladie, greatest(q3 + 1.5 * (q3 - q1), p90) as cut
      from (select prov, maladie, quantile_cont(incidence, 0.25) as q1,
              quantile_cont(incidence, 0.75) as q3, quantile_cont(incidence, 0.9) as p90
            from inc where annee <= {CUT} group by 1, 2))
    select prov, maladie, debutsem, coalesce(cast(incidence > cut as int), 0) as is_outbreak
    from inc left join train_limits using (prov, maladie)""",
)
def w13c(spark, sf):
    out = label_outbreaks(
        incident(spark, sf), KEYS, "incidence", weekly_groups=True, fit_until=F.col("annee") <= CUT
    )
    return out.select(*ROW, "is_outbreak")


BRAND = """brand as (
  select n_name as prov, p_brand as maladie, cast(date_trunc('week', o_orderdate) as date) as debutsem,
         cast(sum(l_quantity) as bigint) as totalcas
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
                join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by all)"""


@query(
    "w_brand_panel",
    f"""with {BRAND}, q as (
      select prov, maladie, greatest(q3 + 1.5 * (q3 - q1), p90) as threshold from (
        select prov, maladie, quantile_cont(totalcas::double, 0.25) as q1,
          quantile_cont(totalcas::double, 0.75) as q3, quantile_cont(totalcas::double, 0.9) as p90
        from brand group by 1, 2)),
    t as (select *, {', '.join(f"{lag_sql('totalcas', k)} as cases_lag{k}" for k in (1, 4))},
      {', '.join(f"{roll('avg', 'totalcas', w)} as cases_roll{w}" for w in (4, 12))} from brand)
    select prov, maladie, debutsem, cast(totalcas > threshold as int) as is_outbreak,
      cast(cases_lag1 as double) as cases_lag1, cast(cases_lag4 as double) as cases_lag4,
      {r('cases_roll4', 'cases_roll12')} from t join q using (prov, maladie)""",
)
def w_brand(spark, sf):
    """Label, lags and rolling means over nation x brand: many groups, one exchange."""
    made = {f"cases_lag{k}": lag("totalcas", k) for k in (1, 4)}
    made |= {f"cases_roll{w}": rolling("totalcas", "mean", w, 1, 1) for w in (4, 12)}
    made["limit"] = lambda w: window_threshold(KEYS, "totalcas")
    out = with_ordered(fx.brand_panel(spark, sf), made, KEYS, WEEK, back=12, **ft.WEEKLY)
    return out.select(
        *ROW,
        S.exceeds("totalcas", F.col("limit")).alias("is_outbreak"),
        F.col("cases_lag1").cast("double"),
        F.col("cases_lag4").cast("double"),
        "cases_roll4",
        "cases_roll12",
    )


# The same operators where five groups hold all rows: each is cut into runs of rows.
EVENT_W = "partition by event_type order by ts"


def events(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")


@query(
    "w01_lags_hot_groups",
    f"""select event_id, round(lag(value, 1) over ({EVENT_W}), 8) + 0.0 as prectotcorr_lag1,
      round(lag(value, 12) over ({EVENT_W}), 8) + 0.0 as prectotcorr_lag12 from events""",
)
def w01_hot(spark, sf):
    out = add_lags(
        events(spark, sf), ["value"], (1, 12), ["event_type"], "ts", "prectotcorr_lag{k}",
        limit=500,
    )
    return out.select("event_id", "prectotcorr_lag1", "prectotcorr_lag12")


@query(
    "w03_future_hot_groups",
    f"""select event_id, round(lead(value, 4) over ({EVENT_W}), 8) + 0.0 as value from events""",
)
def w03_hot(spark, sf):
    out = add_future_target(
        events(spark, sf), "value", 4, ["event_type"], "ts", "ahead", limit=500
    )
    return out.select("event_id", F.col("ahead").alias("value"))


@query(
    "w06_rolling_hot_groups",
    f"""select event_id, round(avg(value) over ({EVENT_W} rows between 8 preceding and 1 preceding), 6)
      + 0.0 as mean8, round(avg(value) over ({EVENT_W} rows between 16 preceding and 1 preceding), 6)
      + 0.0 as mean16 from events""",
)
def w06_hot(spark, sf):
    out = add_rolling(
        events(spark, sf), "value", "mean", (8, 16), ["event_type"], "ts", "mean{w}",
        limit=500,
    )
    return out.select("event_id", "mean8", "mean16")


@query(
    "w07_std_hot_groups",
    f"""select event_id, case when
        count(value) over ({EVENT_W} rows between 8 preceding and 1 preceding) >= 8 then
        round(stddev_samp(value) over ({EVENT_W} rows between 8 preceding and 1 preceding), 6)
        + 0.0 end as std8 from events""",
)
def w07_hot(spark, sf):
    out = add_rolling(
        events(spark, sf), "value", "std", (8,), ["event_type"], "ts", "std{w}", min_periods=None,
        limit=500,
    )
    return out.select("event_id", "std8")


# ---- feature tables --------------------------------------------------------------------------


@query(
    "features_v3",
    f"with {feature_sql(ft.V3, 'v3')} select {items(V3_NAMES)} from v3 where inc_lag4 is not null",
)
def features_v3(spark, sf):
    return ft.features_v3(fx.master(spark, sf)).select(*V3_NAMES)


@query(
    "features_v4",
    f"with {feature_sql(ft.V4, 'v4')} select {items(V4_NAMES)} from v4 where inc_lag8 is not null",
)
def features_v4(spark, sf):
    return ft.features_v4(fx.master(spark, sf)).select(*V4_NAMES)


V5_KEPT = "inc_lag4 is not null and target_outbreak_future is not null"


@query(
    "features_v5",
    f"with {feature_sql(ft.V5, 'v5')} select {items(V5_NAMES)} from v5 where {V5_KEPT}",
)
def features_v5(spark, sf):
    return ft.features_v5(fx.master(spark, sf)).select(*V5_NAMES)


FALLBACK = [f"{c}_lag{k}" for c in WEATHER for k in (1, 2)]
FALLBACK_INT = [f"cases_lag{k}" for k in (1, 2, 3, 4)] + ["outbreak_lag1", "outbreak_lag2"]
FALLBACK_ROLL = ["cases_roll4", "cases_roll8", "cases_roll12"]


@query(
    "features_fallback",
    f"""with {MASTER}, q as ({THRESHOLD_BY.format(key='maladie', v='totalcas::double', t='panel')
        .replace('round(', '(').replace(', 6) + 0.0', ')')}),
    lab as (select master.*, cast(totalcas > threshold as int) as is_outbreak
            from master join q using (maladie)),
    t as (select *,
      {', '.join(f"{lag_sql(c, k)} as {c}_lag{k}" for c in WEATHER for k in (1, 2))},
      {', '.join(f"{lag_sql('totalcas', k)} as cases_lag{k}" for k in (1, 2, 3, 4))},
      {', '.join(f"{lag_sql('is_outbreak', k)} as outbreak_lag{k}" for k in (1, 2))},
      {', '.join(f"{roll('avg', 'totalcas', w)} as cases_roll{w}" for w in (4, 8, 12))} from lab)
    select prov, maladie, debutsem, is_outbreak, {', '.join(FALLBACK_INT)}, {r(*FALLBACK)},
      {r(*FALLBACK_ROLL)}, round(cases_lag1 - cases_roll4, 6) + 0.0 as cases_trend
    from t where cases_lag4 is not null and outbreak_lag2 is not null""",
)
def features_fallback(spark, sf):
    return ft.features_fallback(fx.master(spark, sf)).select(
        *ROW, "is_outbreak", *FALLBACK_INT, *FALLBACK, *FALLBACK_ROLL, "cases_trend"
    )


HISTORY = [f"case_lag_{k}" for k in (1, 2, 3, 4, 8, 12)] + list(ROLL_NAMES)
# Columns of the v5 table that can be missing after its warm-up rule.
COMPLETE = " and ".join(
    f"{c} is not null" for c in [*V5_NAMES, *HISTORY, "outbreak_persistence"]
)
FORECAST = f"""{feature_sql(ft.V5, 'v5')},
kept as (select * from v5 where {V5_KEPT}),
common as (
  select * from kept where (prov, maladie) in (
    select (prov, maladie) from kept where annee <= {CUT} intersect
    select (prov, maladie) from kept where annee > {CUT})),
history as (
  select *, {', '.join(f"{lag_sql('incidence', k)} as case_lag_{k}" for k in (1, 2, 3, 4, 8, 12))},
    {ROLL_FULL}, {roll('sum', 'is_outbreak', 4, 1, 4)} as outbreak_persistence
  from common),
forecast as (
  select *, (case_lag_1 - case_lag_4) / (case_lag_4 + 1) as case_growth
  from history where {COMPLETE})"""
FORECAST_NAMES = ["is_outbreak", "target_outbreak_future", "inc_growth", "inc_roll12", *HISTORY]


@query(
    "features_forecast",
    f"""with {FORECAST} select prov, maladie, debutsem, {items(FORECAST_NAMES)},
      cast(outbreak_persistence as bigint) as outbreak_persistence, {r('case_growth')}
    from forecast""",
)
def features_forecast(spark, sf):
    table = ft.forecast_table(fx.master(spark, sf), CUT)
    return table.select(*ROW, *FORECAST_NAMES, "outbreak_persistence", "case_growth")


CLIMATE_MADE = [f"{c}_{x}" for c in WEATHER for x in ("lag1", "lag2", "lag4", "lag6", "roll4", "anom")]


def climate_sql() -> str:
    prov_w = "partition by prov order by debutsem"
    made = []
    for c in WEATHER:
        made += [f"lag({c}, {k}) over ({prov_w}) as n_{c}_lag{k}" for k in (1, 2, 4, 6)]
        f = f"({prov_w} rows between 3 preceding and current row)"
        made.append(f"case when count({c}) over {f} >= 4 then avg({c}) over {f} end as n_{c}_roll4")
        made.append(f"{c} - avg({c}) over (partition by month(debutsem)) as n_{c}_anom")
    old = [c for c in V5_NAMES if c not in CLIMATE_MADE and c != "target_outbreak_future"]
    whole = " and ".join(f"{c} is not null" for c in [*old, *[f"n_{c}" for c in CLIMATE_MADE]])
    out = ", ".join(f"round(n_{c}, {8}) + 0.0 as {c}" for c in CLIMATE_MADE)
    return f"""with {feature_sql(ft.V5, 'v5')},
    one as (
      select * exclude (target_outbreak_future),
        lead(is_outbreak, 2) over ({prov_w}) as target_outbreak_future
      from (select * from v5 where {V5_KEPT} and maladie = 'MACHINERY')),
    made as (select *, {', '.join(made)} from one where target_outbreak_future is not null)
    select prov, maladie, debutsem, target_outbreak_future,
      cast(weekofyear(debutsem) as int) as week,
      round(sin(2 * pi() * weekofyear(debutsem) / 52), 6) + 0.0 as sin_week, {out}
    from made where {whole}"""


@query("features_climate_only", climate_sql())
def features_climate_only(spark, sf):
    v5 = ft.features_v5(fx.master(spark, sf))
    return ft.climate_only_table(v5, "MACHINERY").select(
        *ROW, "target_outbreak_future", "week", "sin_week", *CLIMATE_MADE
    )


DRIVEN = ("t2m_lag4", "rh2m_lag4", "prectotcorr_lag4", "t2m_anom")


@query(
    "features_climate_driven",
    f"""with {feature_sql(ft.V5, 'v5')}, t as (
      select * exclude (temp_volatility, rain_volatility), abs(t2m_lag4 - t2m) as temp_volatility,
        abs(prectotcorr_lag4 - prectotcorr) as rain_volatility, abs(rh2m_lag4 - rh2m) as rh_volatility
      from v5 where {V5_KEPT} and maladie = 'MACHINERY')
    select prov, debutsem, target_outbreak_future, {r(*DRIVEN)},
      round(temp_volatility, 8) + 0.0 as t2m_vol, round(rain_volatility, 8) + 0.0 as prectotcorr_vol,
      round(rh_volatility, 8) + 0.0 as rh2m_vol from t
    where {' and '.join(f'{c} is not null' for c in
        [*DRIVEN, 'temp_volatility', 'rain_volatility', 'rh_volatility', 'rh2m_anom',
         'prectotcorr_anom', 't2m', 'rh2m', 'prectotcorr'])}""",
)
def features_climate_driven(spark, sf):
    v5 = ft.features_v5(fx.master(spark, sf))
    return ft.climate_driven_table(v5, "MACHINERY").select(
        "prov",
        "debutsem",
        "target_outbreak_future",
        *DRIVEN,
        F.col("temp_volatility").alias("t2m_vol"),
        F.col("rain_volatility").alias("prectotcorr_vol"),
        F.col("rh_volatility").alias("rh2m_vol"),
    )


# ---- sorts and set operations ------------------------------------------------------------------


@query("o01_sorted_panel", f"with {PANEL} select prov, maladie, debutsem, totalcas from panel")
def o01(spark, sf):
    return fx.panel(spark, sf).select(*ROW, "totalcas").orderBy(*ROW)


@query(
    "u01_sorted_distinct",
    f"with {PANEL} select distinct maladie from panel order by maladie",
)
def u01(spark, sf):
    return G.distinct_values(fx.panel(spark, sf), ["maladie"]).orderBy("maladie")


@query(
    "u02_intersection",
    """select o_custkey from orders where o_orderdate < '1998-01-01' intersect
       select o_custkey from orders where o_orderdate >= '1998-01-01'""",
)
def u02(spark, sf):
    orders = fx.table(spark, sf, "orders")
    early = orders.where("o_orderdate < '1998-01-01'")
    late = orders.where("o_orderdate >= '1998-01-01'")
    return G.common_keys(early, late, ["o_custkey"])


@query(
    "u03_difference",
    "select c_custkey from customer except select o_custkey from orders where o_orderdate < '1996-01-01'",
)
def u03(spark, sf):
    customers = fx.table(spark, sf, "customer").select("c_custkey")
    early = fx.table(spark, sf, "orders").where("o_orderdate < '1996-01-01'")
    return G.keys_only_in(
        customers, early.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]
    )


@query(
    "u04_append_results",
    f"""with {INC} select maladie as name, cast(sum(is_outbreak) as bigint) as outbreaks
    from labelled group by 1 union all
    select prov, cast(sum(is_outbreak) as bigint) from labelled group by 1""",
)
def u04(spark, sf):
    rows = labelled(spark, sf)
    total = F.sum("is_outbreak").cast("bigint").alias("outbreaks")
    by_disease = rows.groupBy(F.col("maladie").alias("name")).agg(total)
    return by_disease.unionByName(rows.groupBy(F.col("prov").alias("name")).agg(total))


__all__ = ["CORR", "TRAIN_V3", "corr_sql", "train_v3"]
