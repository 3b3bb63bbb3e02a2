"""Registered queries for missing keys, gaps, other spellings and groups without a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel.ml import models as M
from vigipanel.operators import groups as G
from vigipanel.operators import topk
from vigipanel.operators.labels import label_outbreaks
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.plans.catalog import CUT, INC, MASTER, MASTER_COLUMNS, PANEL, WEATHER_CTE, feature_sql, items, query, r
from vigipanel.plans.q_models import COMPARED, e11
from vigipanel.plans.q_tables import incident
from vigipanel.schema import KEYS, LABEL, WEATHER
from vigipanel.session import scratch_path
from vigipanel.sources import panel as src
from vigipanel.sources import weather as wx

ROW = ("prov", "maladie", "debutsem")


def gaps(df):
    """Rows of February have no disease."""
    return df.withColumn("maladie", F.when(F.col("mois") != 2, F.col("maladie")))


GAPS = "case when mois <> 2 then maladie end as maladie"


@query(
    "s01_counts_with_gaps",
    f"""with {PANEL} select prov, maladie, debutsem, case when mois <> 1 then totalcas end as totalcas,
      totaldeces from panel""",
)
def s01_counts_with_gaps(spark, sf):
    """A writer that holds counts with gaps as doubles puts them as 12.0."""
    path = scratch_path(spark, "panel-gaps")
    cases = F.when(F.col("mois") != 1, F.col("totalcas").cast("double"))
    src.write_table(fx.panel(spark, sf).withColumn("totalcas", cases), path, "csv")
    return src.read_panel(spark, path, "csv").select(*ROW, "totalcas", "totaldeces")


def land(spark, sf):
    """Documents as the service spells them, a folder per province."""
    documents = fx.weather_documents(spark, sf)
    body = F.col("body")
    for name in WEATHER:
        body = F.replace(body, F.lit(f'"{name}"'), F.lit(f'"{name.upper()}"'))
    path = scratch_path(spark, "landed")
    documents.select("prov", body.alias("value")).write.partitionBy("prov").text(path)
    return path


@query(
    "s02_landed_weather",
    f"""with {WEATHER_CTE}
    select prov, annee, mois, param, round(value, 8) + 0.0 as value, false as corrupt
    from (unpivot weather on prectotcorr, t2m, rh2m into name param value value)""",
)
def s02_landed_weather(spark, sf):
    landed = wx.landed_documents(spark, land(spark, sf))
    return wx.weather_long(landed, keys=["prov", "corrupt"])


@query("j01_master_from_documents", f"with {MASTER} select {items(MASTER_COLUMNS)} from master")
def j01_master_from_documents(spark, sf):
    out = scratch_path(spark, "master")
    return wx.master_from_documents(spark, land(spark, sf), fx.panel(spark, sf), out).select(*MASTER_COLUMNS)


@query(
    "w08_anomaly_missing_keys",
    f"""with {MASTER}, g as (select prov, {GAPS}, debutsem, t2m from master),
    a as (select *, case when maladie is not null then t2m - avg(t2m) over (partition by prov, maladie) end as t2m_anom from g)
    select prov, maladie, debutsem, {r('t2m_anom')} from a""",
)
def w08_anomaly_missing_keys(spark, sf):
    out = G.add_anomaly(gaps(fx.master(spark, sf)), ["t2m"], KEYS, weekly_groups=True)
    return out.select(*ROW, "t2m_anom")


@query(
    "w13_label_missing_keys",
    f"""with {INC.split('limits as')[0].rstrip().rstrip(',')}, g as (select prov, {GAPS}, debutsem, incidence from inc),
    lim as (select prov, maladie, greatest(q3 + 1.5 * (q3 - q1), p90) as threshold from (
      select prov, maladie, quantile_cont(incidence, 0.25) as q1, quantile_cont(incidence, 0.75) as q3,
             quantile_cont(incidence, 0.9) as p90 from g where maladie is not null group by 1, 2))
    select g.prov, g.maladie, debutsem, coalesce(cast(incidence > threshold as int), 0) as is_outbreak
    from g left join lim on g.prov = lim.prov and g.maladie = lim.maladie""",
)
def w13_label_missing_keys(spark, sf):
    return label_outbreaks(gaps(incident(spark, sf)), KEYS, "incidence", weekly_groups=True).select(*ROW, LABEL)


@query(
    "o06_best_with_missing_metric",
    f"""with {COMPARED}, c as (select model, case when model <> (select min(model) from compared) then auc end as auc from compared)
    select 'auc' as metric, model, round(auc, 8) + 0.0 as value from c where auc is not null order by auc desc, model limit 1""",
)
def o06_best_with_missing_metric(spark, sf):
    results = e11(spark, sf)
    first = results.agg(F.min("model")).scalar()
    return topk.best_by(results.withColumn("auc", F.when(F.col("model") != first, F.col("auc"))), ["auc"])


@query(
    "m09_groups_without_model",
    f"""with {feature_sql(ft.V3, 'v3')}, t as (
      select maladie, annee, case when maladie = 'BUILDING' and annee <= {CUT} then 0 else is_outbreak end as y
      from v3 where inc_lag4 is not null and not (maladie = 'MACHINERY' and annee > {CUT}))
    select maladie, count(*) as samples, cast(sum(y) as bigint) as outbreaks,
      case when count(distinct case when annee <= {CUT} then y end) < 2 then 'one class in training'
           when sum(cast(annee > {CUT} as int)) = 0 then 'no rows to test' else 'trained' end as status
    from t group by maladie having count(*) >= 20""",
)
def m09_groups_without_model(spark, sf):
    """Groups that can't be trained or tested keep their row and say why."""
    one_class = (F.col("maladie") == "BUILDING") & (F.col("annee") <= CUT)
    no_test = (F.col("maladie") == "MACHINERY") & (F.col("annee") > CUT)
    rows = ft.features_v3(fx.master(spark, sf)).where(~no_test)
    rows = rows.withColumn(LABEL, F.when(one_class, F.lit(0)).otherwise(F.col(LABEL)))
    spec = M.ModelSpec("Logistic Regression", "logistic", {"c": 1.0, "maxIter": 20})
    table = M.train_per_group(rows, "maladie", ["inc_lag1", "inc_lag2", "inc_roll4"], LABEL, spec, CUT, min_rows=20, min_positives=0)
    return table.select("maladie", "samples", "outbreaks", "status")
