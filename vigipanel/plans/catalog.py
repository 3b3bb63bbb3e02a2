"""Registry of the checked queries and the SQL text their oracles share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from vigipanel.plans import features as ft
from vigipanel.schema import WEATHER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = "partition by prov, maladie"
W = f"{K} order by debutsem"
CUT = 1999


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is rounded the way `rounded_sql` rounds the oracle."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def digits(column: str) -> int:
    """Decimals kept, by the magnitude of the column: far above the noise of a sum."""
    if column.startswith(("inc", "case_lag", "rolling", "threshold_inc")):
        return 9
    if column.startswith(WEATHER) or column == "value":
        return 8
    return 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.round(f.name, digits(f.name)) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, DoubleType | FloatType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def r(*columns: str) -> str:
    """Rounded select items of double columns."""
    return ", ".join(f"round({c}, {digits(c)}) + 0.0 as {c}" for c in columns)


# ---- shared table expressions --------------------------------------------------------------

PANEL = """
pop as (
  select r_name as prov, count(*) * 1000 as pop
  from customer join nation on c_nationkey = n_nationkey
                join region on n_regionkey = r_regionkey
  group by 1),
panel as (
  select r_name as prov, cast(r_regionkey * 5 - 10 as double) as lat,
         cast(r_regionkey * 10 as double) as lon, c_mktsegment as maladie,
         cast(date_trunc('week', o_orderdate) as date) as debutsem,
         cast(year(date_trunc('week', o_orderdate)) as int) as annee,
         cast(month(date_trunc('week', o_orderdate)) as int) as mois,
         cast(sum(l_quantity) as bigint) as totalcas,
         cast(sum(case when l_returnflag = 'R' then l_quantity else 0 end) as bigint) as totaldeces,
         cast(max(pop) as bigint) as pop
  from lineitem join orders on l_orderkey = o_orderkey
                join customer on o_custkey = c_custkey
                join nation on c_nationkey = n_nationkey
                join region on n_regionkey = r_regionkey
                join pop on pop.prov = r_name
  group by all)"""

WEATHER_CTE = """
weather as (
  select r_name as prov, cast(year(l_shipdate) as int) as annee,
         cast(month(l_shipdate) as int) as mois,
         round(avg(l_quantity), 10) as prectotcorr, round(avg(l_discount) * 400, 10) as t2m,
         round(avg(l_tax) * 1500, 10) as rh2m
  from lineitem join supplier on l_suppkey = s_suppkey
                join nation on s_nationkey = n_nationkey
                join region on n_regionkey = r_regionkey
  group by all)"""

MASTER = f"""{PANEL},{WEATHER_CTE},
master as (
  select panel.*, prectotcorr, t2m, rh2m
  from panel left join weather using (prov, annee, mois))"""

PANEL_COLUMNS = (
    "prov", "lat", "lon", "maladie", "debutsem", "annee", "mois", "totalcas", "totaldeces", "pop",
)
MASTER_COLUMNS = (*PANEL_COLUMNS, *WEATHER)

INC = f"""{PANEL},
inc as (select *, totalcas / nullif(pop, 0) as incidence from panel),
limits as (
  select prov, maladie, greatest(q3 + 1.5 * (q3 - q1), p90) as threshold
  from (select prov, maladie, quantile_cont(incidence, 0.25) as q1,
               quantile_cont(incidence, 0.75) as q3, quantile_cont(incidence, 0.9) as p90
        from inc group by 1, 2)),
labelled as (
  select inc.*, coalesce(cast(incidence > threshold as int), 0) as is_outbreak
  from inc join limits using (prov, maladie))"""


def roll(fn: str, column: str, width: int, shift: int = 1, min_periods: int = 1) -> str:
    frame = f"({W} rows between {width + shift - 1} preceding and {shift} preceding)"
    if shift == 0:
        frame = f"({W} rows between {width - 1} preceding and current row)"
    value = f"{fn}({column}) over {frame}"
    if min_periods <= 1:
        return value
    return f"case when count({column}) over {frame} >= {min_periods} then {value} end"


def lag_sql(column: str, k: int) -> str:
    return f"lag({column}, {k}) over ({W})"


def feature_sql(spec: ft.FeatureSpec, name: str) -> str:
    """Table expressions that end in `name`, the feature table before the warm-up drop."""
    lags = [f"{lag_sql('incidence', k)} as inc_lag{k}" for k in spec.inc_lags]
    lags += [f"{roll('avg', 'incidence', w)} as inc_roll{w}" for w in spec.inc_rolls]
    for c in WEATHER:
        lags += [f"{lag_sql(c, k)} as {c}_lag{k}" for k in spec.weather_lags]
        lags.append(f"{c} - avg({c}) over ({K}) as {c}_anom")
    m = spec.volatility_min
    lags.append(f"{roll('stddev_samp', 't2m', 4, 0, m)} as temp_volatility")
    lags.append(f"{roll('stddev_samp', 'prectotcorr', 4, 0, m)} as rain_volatility")
    return f"""{MASTER},
inc as (select *, totalcas / nullif(pop, 0) as incidence from master),
limits as (
  select prov, maladie, greatest(q3 + 1.5 * (q3 - q1), p90) as threshold
  from (select prov, maladie, quantile_cont(incidence, 0.25) as q1,
               quantile_cont(incidence, 0.75) as q3, quantile_cont(incidence, 0.9) as p90
        from inc group by 1, 2)),
ordered as (
  select inc.*, coalesce(cast(incidence > threshold as int), 0) as is_outbreak,
         {", ".join(lags)}
  from inc join limits using (prov, maladie)),
{name} as (
  select *, lead(is_outbreak, 4) over ({W}) as target_outbreak_future,
         inc_lag1 - inc_roll4 as inc_trend, inc_lag1 - inc_roll12 as inc_trend_long,
         inc_lag1 - inc_lag3 as inc_acceleration,
         (inc_lag1 - inc_lag2) / (inc_lag2 + 1e-6) as inc_growth,
         inc_lag1 - inc_roll12 as inc_anomaly,
         prectotcorr * t2m as rain_temp, rh2m * t2m as hum_temp,
         sin(2 * pi() * mois / 12) as month_sin, cos(2 * pi() * mois / 12) as month_cos
  from ordered)"""


INTEGER = {
    "annee", "mois", "totalcas", "totaldeces", "pop", "is_outbreak", "target_outbreak_future",
    "outbreak_persistence",
}
TEXT = {"prov", "maladie", "debutsem"}


def items(columns: Sequence[str]) -> str:
    """Select list: doubles rounded, the rest as they are."""
    return ", ".join(c if c in INTEGER | TEXT else r(c) for c in columns)
