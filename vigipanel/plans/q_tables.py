"""Queries: sources, sinks, projections, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel.functions import columns as C
from vigipanel.functions import scalar as S
from vigipanel.operators import splits
from vigipanel.operators.groups import eligible_groups, keep_members
from vigipanel.operators.labels import label_outbreaks
from vigipanel.operators.selection import variances
from vigipanel.operators.windows import add_abs_change, lag, lead, rolling, with_ordered
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.plans.catalog import (
    CUT, INC, MASTER, MASTER_COLUMNS, PANEL, PANEL_COLUMNS, W, WEATHER_CTE, feature_sql, items,
    lag_sql, query, r, roll,
)
from vigipanel.schema import CLIMATE_WHITELIST, KEYS, NOWCAST_EXCLUDE, WEEK
from vigipanel.session import scratch_path
from vigipanel.sources import panel as src
from vigipanel.sources import weather as wx

PANEL_SQL = f"with {PANEL} select {items(PANEL_COLUMNS)} from panel"
ROW = ("prov", "maladie", "debutsem")
V3_NAMES = (*MASTER_COLUMNS, *ft._names(ft.V3))
V4_NAMES = (*MASTER_COLUMNS, *ft._names(ft.V4))
V5_NAMES = (*MASTER_COLUMNS, *ft._names(ft.V5))


def incident(spark, sf):
    return fx.panel(spark, sf).withColumn("incidence", S.incidence("totalcas", "pop"))


def labelled(spark, sf):
    return label_outbreaks(incident(spark, sf), KEYS, "incidence", weekly_groups=True)


# ---- sources and sinks ---------------------------------------------------------------------


@query("s01_read_panel_csv", PANEL_SQL)
def s01(spark, sf):
    path = scratch_path(spark, "panel-csv")
    src.write_table(fx.panel(spark, sf), path, "csv")
    return src.read_panel(spark, path, "csv")


@query(
    "s02_weather_json",
    f"""with {WEATHER_CTE}
    select prov, annee, mois, param, round(value, 8) + 0.0 as value
    from (unpivot weather on prectotcorr, t2m, rh2m into name param value value)""",
)
def s02(spark, sf):
    return wx.weather_long(fx.weather_documents(spark, sf))


@query("s03_load_or_build", PANEL_SQL)
def s03(spark, sf):
    path = scratch_path(spark, "prebuilt")
    src.load_or_build(spark, path, lambda: fx.panel(spark, sf))
    return src.load_or_build(spark, path, lambda: spark.range(0).toDF("unused"))


@query("s04_write_partitioned", PANEL_SQL)
def s04(spark, sf):
    path = scratch_path(spark, "by-year")
    src.write_table(fx.panel(spark, sf), path, partition_by=["annee"])
    return src.read_panel(spark, path).select(*PANEL_COLUMNS)


# ---- projections ----------------------------------------------------------------------------


@query("p01_incidence", f"with {INC} select prov, maladie, debutsem, {r('incidence')} from inc")
def p01(spark, sf):
    return incident(spark, sf).select(*ROW, "incidence")


TRENDS = f"""{INC},
shifted as (
  select prov, maladie, debutsem, {lag_sql('incidence', 1)} as inc_lag1,
         {lag_sql('incidence', 2)} as inc_lag2, {lag_sql('incidence', 3)} as inc_lag3,
         {lag_sql('incidence', 4)} as inc_lag4, {roll('avg', 'incidence', 4)} as inc_roll4,
         {roll('avg', 'incidence', 12)} as inc_roll12
  from inc)"""


def shifted(spark, sf):
    made = {f"inc_lag{k}": lag("incidence", k) for k in (1, 2, 3, 4)}
    made |= {f"inc_roll{w}": rolling("incidence", "mean", w, 1, 1) for w in (4, 12)}
    return with_ordered(incident(spark, sf), made, KEYS, WEEK, back=12, weekly_groups=True)


@query(
    "p02_trends",
    f"""with {TRENDS}, t as (
      select prov, maladie, debutsem, inc_lag1 - inc_roll4 as inc_trend,
             inc_lag1 - inc_roll12 as inc_trend_long, inc_lag1 - inc_lag3 as inc_acceleration
      from shifted)
    select prov, maladie, debutsem, {r('inc_trend', 'inc_trend_long', 'inc_acceleration')} from t""",
)
def p02(spark, sf):
    return shifted(spark, sf).select(
        *ROW,
        S.difference("inc_lag1", "inc_roll4").alias("inc_trend"),
        S.difference("inc_lag1", "inc_roll12").alias("inc_trend_long"),
        S.difference("inc_lag1", "inc_lag3").alias("inc_acceleration"),
    )


@query(
    "p03_growth_eps",
    f"""with {TRENDS} select prov, maladie, debutsem,
        round((inc_lag1 - inc_lag2) / (inc_lag2 + 1e-6), 6) + 0.0 as growth from shifted""",
)
def p03(spark, sf):
    return shifted(spark, sf).select(*ROW, S.growth("inc_lag1", "inc_lag2", 1e-6).alias("growth"))


@query(
    "p04_growth_plus_one",
    f"""with {TRENDS} select prov, maladie, debutsem,
        round((inc_lag1 - inc_lag4) / (inc_lag4 + 1), 9) + 0.0 as inc_growth from shifted""",
)
def p04(spark, sf):
    return shifted(spark, sf).select(
        *ROW, S.growth("inc_lag1", "inc_lag4", 1.0).alias("inc_growth")
    )


@query(
    "p05_interactions",
    f"""with {MASTER} select prov, maladie, debutsem,
        round(prectotcorr * t2m, 6) + 0.0 as rain_temp, round(rh2m * t2m, 6) + 0.0 as hum_temp
    from master""",
)
def p05(spark, sf):
    return fx.master(spark, sf).select(
        *ROW,
        S.product("prectotcorr", "t2m").alias("rain_temp"),
        S.product("rh2m", "t2m").alias("hum_temp"),
    )


@query(
    "p06_abs_change",
    f"""with {MASTER} select prov, maladie, debutsem,
        round(abs({lag_sql('t2m', 4)} - t2m), 6) + 0.0 as change_t2m,
        round(abs({lag_sql('prectotcorr', 4)} - prectotcorr), 6) + 0.0 as change_prectotcorr,
        round(abs({lag_sql('rh2m', 4)} - rh2m), 6) + 0.0 as change_rh2m
    from master""",
)
def p06(spark, sf):
    names = {c: f"change_{c}" for c in ("t2m", "prectotcorr", "rh2m")}
    out = add_abs_change(fx.master(spark, sf), names, 4, KEYS, WEEK, weekly_groups=True)
    return out.select(*ROW, *names.values())


@query(
    "p07_cyclic_month",
    f"""with {PANEL} select prov, maladie, debutsem,
        round(sin(2 * pi() * mois / 12), 6) + 0.0 as month_sin,
        round(cos(2 * pi() * mois / 12), 6) + 0.0 as month_cos from panel""",
)
def p07(spark, sf):
    sin, cos = S.cyclic("mois", 12)
    return fx.panel(spark, sf).select(*ROW, sin.alias("month_sin"), cos.alias("month_cos"))


@query(
    "p08_cyclic_iso_week",
    """select o_orderkey, round(sin(2 * pi() * weekofyear(o_orderdate) / 52), 6) + 0.0 as sin_week,
       round(cos(2 * pi() * weekofyear(o_orderdate) / 52), 6) + 0.0 as cos_week,
       round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 as sin_month,
       round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 as cos_month from orders""",
)
def p08(spark, sf):
    sin_week, cos_week = S.cyclic(S.iso_week("o_orderdate"), 52)
    sin_month, cos_month = S.cyclic(F.month("o_orderdate"), 12)
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        sin_week.alias("sin_week"),
        cos_week.alias("cos_week"),
        sin_month.alias("sin_month"),
        cos_month.alias("cos_month"),
    )


NOWCAST_NAMES = [c for c in V3_NAMES if c not in NOWCAST_EXCLUDE]


@query(
    "p09_feature_columns",
    f"with {feature_sql(ft.V3, 'v3')} select {items(NOWCAST_NAMES)} from v3 "
    "where inc_lag4 is not null",
)
def p09(spark, sf):
    v3 = ft.features_v3(fx.master(spark, sf))
    return v3.select(*C.feature_columns(v3, NOWCAST_EXCLUDE))


@query(
    "p10_drop_if_exists",
    f"with {MASTER} select {items([c for c in MASTER_COLUMNS if c != 'rh2m'])} from master",
)
def p10(spark, sf):
    return C.drop_if_exists(fx.master(spark, sf), ["rh2m", "ws2m", "rain_temp"])


CLIMATE_NAMES = [
    c for c in CLIMATE_WHITELIST if c in V5_NAMES and c not in ("temp_volatility", "rain_volatility")
]


@query(
    "p11_select_existing",
    f"""with {feature_sql(ft.V5, 'v5')}
    select {items([*ROW, *CLIMATE_NAMES])}, {r('temp_volatility', 'rain_volatility')}
    from v5 where inc_lag4 is not null and target_outbreak_future is not null""",
)
def p11(spark, sf):
    v5 = ft.features_v5(fx.master(spark, sf))
    return v5.select(*ROW, *C.select_existing(v5, CLIMATE_WHITELIST))


@query("p12_for_disease", PANEL_SQL + " where maladie = 'MACHINERY'")
def p12(spark, sf):
    return splits.for_group(fx.panel(spark, sf), "maladie", "MACHINERY")


@query(
    "p13_split_by_year",
    f"""with {PANEL} select prov, maladie, debutsem,
    case when annee <= {CUT} then 'train' else 'test' end as split from panel""",
)
def p13(spark, sf):
    return splits.split_by_year(fx.panel(spark, sf), CUT).select(*ROW, "split")


@query(
    "p14_split_by_date_quantile",
    f"""with {PANEL},
    cut as (select quantile_cont(datediff('day', date '1970-01-01', debutsem), 0.8) as c from panel)
    select prov, maladie, debutsem,
      case when datediff('day', date '1970-01-01', debutsem) <= c then 'train' else 'test' end as split
    from panel, cut""",
)
def p14(spark, sf):
    return splits.split_by_date_quantile(fx.panel(spark, sf), 0.8).select(*ROW, "split")


@query(
    "p15_split_by_fraction",
    f"""with {PANEL}, ranked as (
      select *, row_number() over (order by annee, mois, debutsem, prov, maladie) as rn,
             count(*) over () as n from panel)
    select prov, maladie, debutsem,
      case when rn <= floor(0.7 * n) then 'train' else 'test' end as split from ranked""",
)
def p15(spark, sf):
    return splits.split_by_fraction(fx.panel(spark, sf), 0.7).select(*ROW, "split")


@query(
    "p16_drop_warmup",
    f"""with {TRENDS} select prov, maladie, debutsem, {r('inc_lag4')} from shifted
    where inc_lag4 is not null""",
)
def p16(spark, sf):
    return C.drop_warmup(shifted(spark, sf), ["inc_lag4"]).select(*ROW, "inc_lag4")


@query(
    "p17_drop_any_null",
    f"""with {MASTER} select {items(MASTER_COLUMNS)} from master
    where prectotcorr is not null and t2m is not null and rh2m is not null""",
)
def p17(spark, sf):
    return C.drop_any_null(fx.master(spark, sf))


@query(
    "p18_membership_filter",
    """select o_orderkey, o_custkey from orders where o_custkey in
       (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
)
def p18(spark, sf):
    members = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return keep_members(
        orders, members.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]
    )


VAR_COLUMNS = ("incidence", "totalcas", "prectotcorr", "t2m", "rh2m", "lat", "lon")


@query(
    "p21_low_variance",
    f"""with {MASTER}, train as (
      select *, totalcas / nullif(pop, 0) as incidence from master where annee <= {CUT}),
    v as (select {', '.join(f'var_samp({c}) as {c}' for c in VAR_COLUMNS)} from train),
    long as (unpivot v on {', '.join(VAR_COLUMNS)} into name feature value variance)
    select feature, round(variance, 4) + 0.0 as variance, cast(variance > 1e-6 as int) as kept
    from long""",
)
def p21(spark, sf):
    train = (
        fx.master(spark, sf)
        .withColumn("incidence", S.incidence("totalcas", "pop"))
        .where(F.col("annee") <= CUT)
    )
    return variances(train, VAR_COLUMNS).select(
        "feature",
        F.round("variance", 4).alias("variance"),
        (F.col("variance") > 1e-6).cast("int").alias("kept"),
    )


@query(
    "p22_target_cast",
    f"""with {INC}, t as (select *, lead(is_outbreak, 4) over ({W}) as target from labelled)
    select prov, maladie, debutsem, cast(target as int) as target from t where target is not null""",
)
def p22(spark, sf):
    target = {"target": lead("is_outbreak", 4)}
    ahead = with_ordered(
        labelled(spark, sf), target, KEYS, WEEK, back=0, ahead=4, weekly_groups=True
    )
    return ahead.dropna(subset=["target"]).select(*ROW, F.col("target").cast("int"))


@query(
    "p23_minimum_support",
    f"""with {INC} select maladie, count(*) as samples, cast(sum(is_outbreak) as bigint) as outbreaks
    from labelled group by maladie having count(*) >= 300 and sum(is_outbreak) >= 20""",
)
def p23(spark, sf):
    return eligible_groups(labelled(spark, sf), ["maladie"], "is_outbreak", 300, 20)


PATTERN_NAMES = [c for c in V4_NAMES if "lag" in c or "roll" in c]


@query(
    "p24_columns_like",
    f"""with {feature_sql(ft.V4, 'v4')} select {items([*ROW, *PATTERN_NAMES])} from v4
    where inc_lag8 is not null""",
)
def p24(spark, sf):
    v4 = ft.features_v4(fx.master(spark, sf))
    return v4.select(*ROW, *C.columns_like(v4, ["lag", "roll"]))


@query(
    "p25_row_identity",
    f"""with {PANEL} select count(*) as n_rows, count(distinct (prov, maladie, debutsem)) as n_ids
    from panel""",
)
def p25(spark, sf):
    return src.with_row_id(fx.panel(spark, sf)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids")
    )


@query(
    "p26_duplicate_keys",
    """select o_custkey, count(*) as rows from orders group by o_custkey having count(*) > 1""",
)
def p26(spark, sf):
    return src.duplicates(fx.table(spark, sf, "orders"), ["o_custkey"])


# ---- scalar functions -----------------------------------------------------------------------


@query(
    "c01_slice_year_month",
    """select o_orderkey, cast(substr(k, 1, 4) as int) as annee, cast(substr(k, 5, 2) as int) as mois
    from (select o_orderkey, strftime(o_orderdate, '%Y%m') as k from orders)""",
)
def c01(spark, sf):
    key = F.date_format("o_orderdate", "yyyyMM")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.substring(key, 1, 4).cast("int").alias("annee"),
        F.substring(key, 5, 2).cast("int").alias("mois"),
    )


@query(
    "c02_nested_map",
    """select event_id, key, cast(value as double) as value from (
      select event_id, unnest(json_keys(props)) as key,
             json_extract_string(props, unnest(json_keys(props))) as value from events)""",
)
def c02(spark, sf):
    parsed = F.from_json("props", "map<string,double>")
    return fx.table(spark, sf, "events").select("event_id", F.explode(parsed))


@query(
    "c03_parse_date",
    """select o_orderkey, cast(strftime(o_orderdate, '%Y-%m-%d') as date) as day from orders""",
)
def c03(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return fx.table(spark, sf, "orders").select("o_orderkey", F.to_date(text).alias("day"))


@query(
    "c04_iso_week",
    "select o_orderkey, cast(weekofyear(o_orderdate) as int) as week from orders",
)
def c04(spark, sf):
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", S.iso_week("o_orderdate").alias("week")
    )


@query("c05_month", "select o_orderkey, cast(month(o_orderdate) as int) as month from orders")
def c05(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"))


@query(
    "c06_trigonometry",
    """select event_id, round(sin(value), 6) + 0.0 as s, round(cos(value), 6) + 0.0 as c,
       round(value / pi(), 6) + 0.0 as turns from events""",
)
def c06(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id",
        F.sin("value").alias("s"),
        F.cos("value").alias("c"),
        (F.col("value") / F.pi()).alias("turns"),
    )


@query("c07_abs", "select c_custkey, round(abs(c_acctbal), 6) + 0.0 as size from customer")
def c07(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", F.abs("c_acctbal").alias("size"))


@query(
    "c08_greatest",
    """select l_orderkey, l_linenumber, round(greatest(l_discount, l_tax), 6) + 0.0 as larger
       from lineitem""",
)
def c08(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("larger")
    )


@query(
    "c09_flag_to_int",
    """select l_orderkey, l_linenumber, cast(l_quantity > 25 as int) as flag from lineitem""",
)
def c09(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.exceeds("l_quantity", F.lit(25.0)).alias("flag")
    )


@query(
    "c10_conditional_weight",
    """select doc_id, case when quality = 1 then 4.0::double else 1.0::double end as weight
    from labels""",
)
def c10(spark, sf):
    return fx.table(spark, sf, "labels").select("doc_id", S.class_weight("quality", 4).alias("weight"))


@query(
    "c11_fill_constants",
    f"""with {MASTER} select prov, maladie, debutsem, round(coalesce(t2m, 20.0), 8) + 0.0 as t2m,
        round(coalesce(rh2m, 60.0), 8) + 0.0 as rh2m from master""",
)
def c11(spark, sf):
    return fx.master(spark, sf).select(*ROW, "t2m", "rh2m").fillna({"t2m": 20.0, "rh2m": 60.0})


@query(
    "c12_composite_key",
    f"""with {PANEL} select k.prov as prov, k.maladie as maladie, count(*) as weeks
    from (select {{'prov': prov, 'maladie': maladie}} as k from panel) group by k""",
)
def c12(spark, sf):
    key = F.struct("prov", "maladie").alias("k")
    return (
        fx.panel(spark, sf)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("weeks"))
        .select("k.prov", "k.maladie", "weeks")
    )


@query(
    "c13_casts",
    """select l_orderkey, l_linenumber, cast(floor(l_quantity) as int) as whole,
       case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as code from lineitem""",
)
def c13(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.floor("l_quantity").cast("int").alias("whole"),
        F.when(F.col("l_returnflag") == "A", 0)
        .when(F.col("l_returnflag") == "N", 1)
        .otherwise(2)
        .alias("code"),
    )


__all__ = ["ROW", "V3_NAMES", "V4_NAMES", "V5_NAMES", "incident", "labelled"]
