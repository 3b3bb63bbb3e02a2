"""Queries: encoding, selection, folds, evaluation, training, explanation."""

from __future__ import annotations

import threading

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigipanel.functions import scalar as S
from vigipanel.ml import explain as X
from vigipanel.ml import models as M
from vigipanel.ml.certify import certified
from vigipanel.operators import encode as E
from vigipanel.operators import metrics as V
from vigipanel.operators import selection as L
from vigipanel.operators import splits, topk
from vigipanel.operators.windows import lag, rolling, with_ordered
from vigipanel.plans import features as ft
from vigipanel.plans import fixtures as fx
from vigipanel.plans.catalog import (
    CUT, INC, MASTER, PANEL, feature_sql, lag_sql, query, r, roll,
)
from vigipanel.plans.q_groups import CORR, FORECAST, TRAIN_V3, corr_sql, train_v3
from vigipanel.plans.q_tables import ROW, labelled
from vigipanel.plans.studies import disease_models, forecast_grid, forecast_matrix, nowcast_matrix
from vigipanel.schema import KEYS, LABEL, WEATHER, WEEK
from vigipanel.session import materialise, scratch_path
from vigipanel.sources import panel as src

# ---- encoding and scaling --------------------------------------------------------------------


@query(
    "f01_ordinal_encode",
    f"""with {PANEL} select prov, maladie, debutsem,
      cast(dense_rank() over (order by prov) - 1 as int) as prov_code,
      cast(dense_rank() over (order by maladie) - 1 as int) as maladie_code from panel""",
)
def f01(spark, sf):
    coded = E.ordinal_encode(fx.panel(spark, sf), ["prov", "maladie"])
    return coded.select(*ROW, "prov_code", "maladie_code")


@query(
    "f01_ordinal_codes_parts",
    """select p_name as value, cast(row_number() over (order by p_name) - 1 as int) as code
       from (select distinct p_name from part)""",
)
def f01b(spark, sf):
    return E.ordinal_codes(fx.table(spark, sf, "part"), "p_name")


SCALED = ("totalcas", *WEATHER)


@query(
    "f02_standardise",
    f"""with {MASTER}, s as (select {', '.join(
        f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in SCALED)} from master where annee <= {CUT})
    select prov, maladie, debutsem,
      {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) + 0.0 as z_{c}' for c in SCALED)} from master, s""",
)
def f02(spark, sf):
    master = materialise(fx.master(spark, sf))
    (out,) = E.standardise(master.where(F.col("annee") <= CUT), [master], SCALED)
    return out.select(*ROW, *[F.col(c).alias(f"z_{c}") for c in SCALED])


@query(
    "f03_one_hot",
    f"""with {PANEL}, l as (select distinct maladie from panel)
    select prov, debutsem, totalcas,
      {', '.join(f"cast(maladie = '{m}' as int) as maladie_{m}" for m in
                 ('BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} from panel""",
)
def f03(spark, sf):
    hot = E.one_hot(materialise(fx.panel(spark, sf)), ["maladie"])
    return hot.select("prov", "debutsem", "totalcas", *[c for c in hot.columns if "maladie_" in c])


@query(
    "f04_impute_median",
    f"""with {MASTER}, s as (select {', '.join(f'median({c}) as d_{c}' for c in WEATHER)}
      from master where annee <= {CUT})
    select prov, maladie, debutsem,
      {', '.join(f'round(coalesce({c}, d_{c}), 8) + 0.0 as {c}' for c in WEATHER)} from master, s""",
)
def f04(spark, sf):
    master = materialise(fx.master(spark, sf))
    (out,) = E.impute_median(master.where(F.col("annee") <= CUT), [master], WEATHER)
    return out.select(*ROW, *WEATHER)


@query(
    "f05_correlated_columns",
    f"with {TRAIN_V3}, p as ({corr_sql()}) select distinct b as feature from p where abs(r) > 0.8",
)
def f05(spark, sf):
    train = materialise(train_v3(spark, sf).select(*CORR))
    return L.correlated_columns(L.correlations(train, CORR), 0.8)


MI = ("inc_lag1", "inc_lag4", "inc_roll4", "inc_roll12", "t2m", "rh2m_lag2", "month_sin")


def mi_sql(columns=MI, fill=False) -> str:
    """Binned information of each feature; `fill` puts the median in place of missing values."""
    value = "coalesce({c}, median({c}) over ())" if fill else "{c}"
    long = " union all ".join(
        f"select '{c}' as feature, is_outbreak as y, {value.format(c=c)} as v from train"
        for c in columns
    )
    cuts = ", ".join(f"quantile_cont(v, {i / 10}) as c{i}" for i in range(1, 10))
    bins = " + ".join(f"cast(v > c{i} as int)" for i in range(1, 10))
    return f"""{TRAIN_V3}, long as ({long}),
    cuts as (select feature, {cuts} from long group by 1),
    joint as (select feature, {bins} as b, y, count(*) as n from long join cuts using (feature)
              where v is not null group by all),
    mi as (select feature, sum(term) as mi from (
      select feature, n / sum(n) over (partition by feature) *
        ln(n * sum(n) over (partition by feature) /
           (sum(n) over (partition by feature, b) * sum(n) over (partition by feature, y))) as term
      from joint) group by 1)"""


@query("f06_mutual_information", f"with {mi_sql()} select feature, round(mi, 6) + 0.0 as mi from mi")
def f06(spark, sf):
    train = materialise(train_v3(spark, sf).select(LABEL, *MI))
    return L.mutual_information(train, MI, LABEL)


@query(
    "o04_top_mutual_information",
    f"""with {mi_sql()} select feature, round(mi, 6) + 0.0 as mi from mi where mi > 0
    order by mi desc, feature limit 4""",
)
def o04(spark, sf):
    return L.select_top_mi(f06(spark, sf), 4)


@query(
    "f07_assemble",
    f"""with {TRAIN_V3} select prov, maladie, debutsem, {len(CORR)} as n_features from train
    where {' and '.join(f'{c} is not null' for c in CORR)}""",
)
def f07(spark, sf):
    rows = M.assemble(train_v3(spark, sf).dropna(subset=list(CORR)), CORR)
    return rows.select(*ROW, F.size(M.vector_to_array("features")).alias("n_features"))


@query(
    "f08_select_features",
    f"""with {mi_sql(CORR, fill=True)}, p as ({corr_sql()}),
    flat as ({' union all '.join(
        f"select '{c}' as feature from train having var_samp({c}) <= 1e-6" for c in CORR)}),
    gone as (select distinct b as feature from p where abs(r) > 0.95
             and a not in (select feature from flat)),
    ranked as (select feature, row_number() over (order by mi desc, feature) - 1 as position
      from mi where mi > 0 and feature not in (select feature from gone)
        and feature not in (select feature from flat))
    select cast(position as int) as position, feature from ranked where position < 8""",
)
def f08(spark, sf):
    names = L.select_features(train_v3(spark, sf), CORR, LABEL, limit=0.95, k=8)
    return spark.createDataFrame([(i, c) for i, c in enumerate(names)], "position int, feature string")


@query(
    "m07_fixed_weights",
    f"""with {INC} select is_outbreak, case when is_outbreak = 1 then 4.0::double else 1.0::double end
      as weight, count(*) as n_rows from labelled group by 1, 2""",
)
def m07(spark, sf):
    weighted = labelled(spark, sf).withColumn("weight", S.class_weight(LABEL, 4))
    return weighted.groupBy(LABEL, "weight").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- folds -----------------------------------------------------------------------------------


@query(
    "e08_expanding_folds",
    f"""with {PANEL}, t as (select *, row_number() over (order by debutsem, prov, maladie) - 1 as pos,
      count(*) over () as n from panel)
    select prov, maladie, debutsem, cast(case when pos < n - 3 * (n // 4) then 0
      else (pos - (n - 3 * (n // 4))) // (n // 4) + 1 end as int) as block from t""",
)
def e08(spark, sf):
    return splits.expanding_folds(fx.panel(spark, sf), 3).select(*ROW, "block")


# Class c covers positions [s, s + n) once classes are laid end to end, first seen first.
E09 = f"""with {INC}, t as (
  select *, row_number() over (partition by is_outbreak order by debutsem, prov, maladie) - 1 as pos,
    count(*) over (partition by is_outbreak) as n,
    first_value(is_outbreak) over (order by debutsem, prov, maladie) as first_class,
    count(*) over () as total
  from labelled),
s as (select *, case when is_outbreak = first_class then 0 else total - n end as s0 from t),
c as (select *, (s0 + n + 2) // 3 - (s0 + 2) // 3 as k0, (s0 + n + 1) // 3 - (s0 + 1) // 3 as k1 from s)
select prov, maladie, debutsem, cast(pos >= k0 as int) + cast(pos >= k0 + k1 as int) as fold from c"""


@query("e09_stratified_folds", E09)
def e09(spark, sf):
    return splits.stratified_folds(labelled(spark, sf), 3, LABEL).select(*ROW, "fold")


# ---- evaluation on closed-form scores --------------------------------------------------------

MODELS = {"nowcast": "incidence", "lag1": "inc_lag1", "lag4": "inc_lag4"}

SCORES = f"""{INC},
hist as (select *, {lag_sql('incidence', 1)} as inc_lag1, {lag_sql('incidence', 4)} as inc_lag4,
  {roll('avg', 'incidence', 8)} as roll8 from labelled),
scores as ({' union all '.join(
    f"select '{m}' as model, prov, maladie, debutsem, annee, is_outbreak as y, "
    f"coalesce(round(1 / (1 + exp(2 - {c} / nullif(roll8, 0))), 3), 0) as p from hist "
    f"where inc_lag4 is not null and annee > {CUT}" for m, c in MODELS.items())})"""


def scores(spark, sf):
    """Three closed-form scores per test row, with many ties."""
    made = {
        "inc_lag1": lag("incidence", 1),
        "inc_lag4": lag("incidence", 4),
        "roll8": rolling("incidence", "mean", 8, 1, 1),
    }
    rows = with_ordered(labelled(spark, sf), made, KEYS, WEEK, back=8, **ft.WEEKLY).where(
        F.col("inc_lag4").isNotNull() & (F.col("annee") > CUT)
    )

    def score(column):
        odds = F.exp(F.lit(2.0) - F.try_divide(F.col(column), F.col("roll8")))
        return F.coalesce(F.round(F.lit(1.0) / (F.lit(1.0) + odds), 3), F.lit(0.0))

    each = F.array(
        *[F.struct(F.lit(m).alias("model"), score(c).alias("p")) for m, c in MODELS.items()]
    )
    return rows.select(*ROW, "annee", F.col(LABEL).alias("y"), F.inline(each))


def flagged(strict):
    def build(spark, sf):
        return scores(spark, sf).withColumn("yhat", S.classify("p", 0.2, strict))

    return build


for _name, _strict, _op in (("p19_classify_strict", True, ">"), ("p20_classify", False, ">=")):
    query(
        _name,
        f"""with {SCORES} select model, prov, maladie, debutsem, cast(p {_op} 0.2 as int) as yhat
        from scores""",
    )(lambda spark, sf, s=_strict: flagged(s)(spark, sf).select("model", *ROW, "yhat"))

CONF = """conf as (select model,
  count(*) filter (y = 1 and {hit}) as tp, count(*) filter (y = 0 and {hit}) as fp,
  count(*) filter (y = 1 and not {hit}) as fn, count(*) filter (y = 0 and not {hit}) as tn
  from scores group by 1)"""
RATES = """coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) as accuracy,
  coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(tp / nullif(tp + fp, 0), 0) as precision,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1"""
RATE_NAMES = ("accuracy", "recall", "precision", "f1")
CONF20 = CONF.format(hit="(p > 0.2)")


@query("a15_confusion", f"with {SCORES}, {CONF20} select * from conf")
def a15(spark, sf):
    return V.confusion(flagged(True)(spark, sf), ["model"], "y", "yhat")


@query(
    "e01_rates",
    f"with {SCORES}, {CONF20}, m as (select model, {RATES} from conf) select model, {r(*RATE_NAMES)} from m",
)
def e01(spark, sf):
    return V.metrics(a15(spark, sf)).select("model", *RATE_NAMES)


REPORT = f"""with {SCORES}, {CONF20}, c as (select *, tp + fn as n1, tn + fp as n0,
  coalesce(tn / nullif(tn + fn, 0), 0) as p0, coalesce(tn / nullif(tn + fp, 0), 0) as r0,
  coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) as f0,
  coalesce(tp / nullif(tp + fp, 0), 0) as p1, coalesce(tp / nullif(tp + fn, 0), 0) as r1,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
  (tp + tn) / nullif(tp + tn + fp + fn, 0) as acc from conf),
rows as (
  select model, '0' as class, p0 as precision, r0 as recall, f0 as f1, n0 as support from c union all
  select model, '1', p1, r1, f1, n1 from c union all
  select model, 'accuracy', acc, acc, acc, n0 + n1 from c union all
  select model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 from c union all
  select model, 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
    (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 from c)
select model, class, support, {r('precision', 'recall', 'f1')} from rows"""


@query("e02_classification_report", REPORT)
def e02(spark, sf):
    return V.classification_report(flagged(True)(spark, sf), ["model"], "y", "yhat")


# Mann-Whitney form: average rank of the positives.
AUC = """aucs as (select model,
  (sum(case when y = 1 then rk end) - n1 * (n1 + 1) / 2) / (n1 * n0) as auc
  from (select *, count(*) filter (y = 1) over (partition by model) as n1,
          count(*) filter (y = 0) over (partition by model) as n0,
          rank() over (partition by model order by p)
            + (count(*) over (partition by model, p) - 1) / 2 as rk from scores)
  group by model, n1, n0)"""


@query("e03_auc", f"with {SCORES}, {AUC} select model, round(auc, 6) + 0.0 as auc from aucs")
def e03(spark, sf):
    return V.auc(scores(spark, sf), ["model"])


LABEL_SCORES = """ls as (select 'quality' as model, quality as y, 1 - 1 / (1 + n_chars / 500.0::double) as p
  from labels join documents using (doc_id) union all
  select 'toxic', toxic, 1 - 1 / (1 + n_chars / 500.0::double)
  from labels join documents using (doc_id))"""


@query(
    "e03_auc_documents",
    f"with {LABEL_SCORES}, {AUC.replace('from scores', 'from ls')} "
    "select model, round(auc, 6) + 0.0 as auc from aucs",
)
def e03b(spark, sf):
    """Labels against a score from the length of the document, through the cell path."""
    return V.auc(label_scores(spark, sf), ["model"], steps=6)


def label_scores(spark, sf):
    joined = fx.table(spark, sf, "labels").join(
        fx.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    p = F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("n_chars") / F.lit(500.0))
    return joined.withColumn("p", p).unpivot(["doc_id", "p"], ["quality", "toxic"], "model", "y")


@query(
    "e04_roc_points",
    f"""with {SCORES}, c as (select model, p, count(*) filter (y = 1) as pos,
        count(*) filter (y = 0) as neg from scores group by 1, 2)
    select model, round(p, 6) + 0.0 as threshold,
      round(sum(neg) over (partition by model order by p desc) / sum(neg) over (partition by model), 6)
        + 0.0 as fpr,
      round(sum(pos) over (partition by model order by p desc) / sum(pos) over (partition by model), 6)
        + 0.0 as tpr from c""",
)
def e04(spark, sf):
    return V.roc_points(scores(spark, sf), ["model"])


@query(
    "e04_roc_curve",
    f"""with {SCORES}, c as (select model, p, count(*) filter (y = 1) as pos,
        count(*) filter (y = 0) as neg from scores group by 1, 2),
    d as (select *, row_number() over (partition by model order by p desc) as i,
        lead(pos) over (partition by model order by p desc) as next_pos,
        lead(neg) over (partition by model order by p desc) as next_neg,
        sum(pos) over (partition by model order by p desc) as tp, sum(neg) over (partition by model order by p desc) as fp,
        sum(pos) over (partition by model) as n1, sum(neg) over (partition by model) as n0 from c)
    select model, round(p, 6) + 0.0 as threshold, round(fp / n0, 6) + 0.0 as fpr, round(tp / n1, 6) + 0.0 as tpr
    from d where i = 1 or next_pos is null or next_pos <> pos or next_neg <> neg
    union all select distinct model, 'infinity'::double, 0.0::double, 0.0::double from c""",
)
def e04_drawn(spark, sf):
    return V.roc_curve(scores(spark, sf), ["model"])


@query(
    "e04_roc_curve_documents",
    f"""with {LABEL_SCORES}, c as (select model, p, count(*) filter (y = 1) as pos,
        count(*) filter (y = 0) as neg from ls group by 1, 2),
    d as (select *, row_number() over (partition by model order by p desc) as i,
        lead(pos) over (partition by model order by p desc) as next_pos,
        lead(neg) over (partition by model order by p desc) as next_neg,
        sum(pos) over (partition by model order by p desc) as tp, sum(neg) over (partition by model order by p desc) as fp,
        sum(pos) over (partition by model) as n1, sum(neg) over (partition by model) as n0 from c)
    select model, round(p, 6) + 0.0 as threshold, round(fp / n0, 6) + 0.0 as fpr, round(tp / n1, 6) + 0.0 as tpr
    from d where i = 1 or next_pos is null or next_pos <> pos or next_neg <> neg
    union all select distinct model, 'infinity'::double, 0.0::double, 0.0::double from c""",
)
def e04_drawn_documents(spark, sf):
    """Labels against a score from the length of the document, neighbours found across cells."""
    return V.roc_curve(label_scores(spark, sf), ["model"], steps=6)


def sweep_sql(grid) -> str:
    rows = " union all ".join(
        f"""select model, {t}::double as threshold, count(*) filter (y = 1 and p >= {t}) as tp,
        count(*) filter (y = 0 and p >= {t}) as fp, count(*) filter (y = 1 and p < {t}) as fn,
        count(*) filter (y = 0 and p < {t}) as tn from scores group by 1"""
        for t in grid
    )
    return f"conf as ({rows}), sweep as (select *, {RATES} from conf)"


@query(
    "e05_threshold_sweep",
    f"""with {SCORES}, {sweep_sql(V.GRID_LONG)}
    select model, threshold, tp, fp, fn, tn, {r(*RATE_NAMES)} from sweep""",
)
def e05(spark, sf):
    return V.threshold_sweep(scores(spark, sf), V.GRID_LONG, ["model"])


@query(
    "e06_best_threshold_f1",
    f"""with {SCORES}, {sweep_sql(V.GRID_LONG)}, b as (select *, row_number() over
      (partition by model order by f1 desc, threshold) as rn from sweep)
    select model, case when f1 > 0 then threshold else 0.25 end as threshold,
      round(f1, 6) + 0.0 as best from b where rn = 1""",
)
def e06(spark, sf):
    return V.best_threshold(e05(spark, sf), ["model"], "f1", V.DEFAULT_LONG)


@query(
    "e07_best_threshold_recall",
    f"""with {SCORES}, {sweep_sql(V.GRID_RECALL)}, b as (
      select model, threshold, tp / (tp + fn + 1e-6) as v, row_number() over
      (partition by model order by tp / (tp + fn + 1e-6) desc, threshold) as rn from sweep)
    select model, case when v > 0 then threshold else 0.2 end as threshold,
      round(v, 6) + 0.0 as best from b where rn = 1""",
)
def e07(spark, sf):
    sweep = V.threshold_sweep(scores(spark, sf), V.GRID_RECALL, ["model"])
    return V.best_threshold(sweep, ["model"], "recall", V.DEFAULT_RECALL)


COMPARED = f"""{SCORES}, {CONF20}, {AUC},
compared as (select model, auc, {RATES} from conf join aucs using (model))"""


@query(
    "e11_comparison_table",
    f"with {COMPARED} select model, {r('auc', *RATE_NAMES)} from compared order by auc desc, model",
)
def e11(spark, sf):
    table = V.comparison(scores(spark, sf), ["model"], 0.2, strict=True)
    return table.select("model", "auc", *RATE_NAMES)


@query(
    "o02_rank_models",
    f"with {COMPARED} select model, {r('recall')} from compared order by recall desc, model",
)
def o02(spark, sf):
    return topk.rank_by(e11(spark, sf), "recall", ["model"]).select("model", "recall")


@query(
    "o06_best_by_metric",
    f"""with {COMPARED} {' union all '.join(
        f"(select '{m}' as metric, model, round({m}, 8) + 0.0 as value from compared "
        f"order by {m} desc, model limit 1)" for m in ('recall', 'f1', 'auc'))}""",
)
def o06(spark, sf):
    return topk.best_by(e11(spark, sf), ["recall", "f1", "auc"])


@query(
    "o08_example_rows",
    f"""with {SCORES}, one as (select *, cast(p > 0.2 as int) as yhat from scores where model = 'lag1')
    (select 'true positive' as example, debutsem, prov, maladie from one where y = 1 and yhat = 1
     order by debutsem, prov, maladie limit 1) union all
    (select 'true negative', debutsem, prov, maladie from one where y = 0 and yhat = 0
     order by debutsem, prov, maladie limit 1)""",
)
def o08(spark, sf):
    one = flagged(True)(spark, sf).where("model = 'lag1'")
    return topk.example_rows(one, ["debutsem", "prov", "maladie"])


@query(
    "e12_tuned_on_validation",
    f"""with {SCORES.replace('scores as', 'allscores as')},
    val as (select * from allscores where annee = 2000),
    test as (select * from allscores where annee > 2000),
    {sweep_sql(V.GRID_LONG).replace('conf', 'vconf').replace('sweep', 'vsweep').replace('from scores', 'from val')},
    b as (select model, case when f1 > 0 then threshold else 0.25 end as threshold from (
      select *, row_number() over (partition by model order by f1 desc, threshold) as rn from vsweep)
      where rn = 1),
    {sweep_sql(V.GRID_LONG).replace('from scores', 'from test')}
    select model, threshold, {r('recall', 'precision', 'f1')} from sweep join b using (model, threshold)""",
)
def e12(spark, sf):
    rows = materialise(scores(spark, sf))
    tuned = V.tuned_comparison(
        rows.where("annee = 2000"), rows.where("annee > 2000"), ["model"], V.GRID_LONG
    )
    return tuned.select("model", "threshold", "recall", "precision", "f1")


# ---- explanation -------------------------------------------------------------------------------

# Coefficients of a linear margin.
COEF = {
    "inc_lag1": 420.0, "inc_lag2": 160.0, "inc_lag3": -75.0, "inc_roll4": 310.0, "inc_roll12": -190.0,
    "prectotcorr": 0.21, "t2m": -0.13, "rh2m": 0.045, "prectotcorr_anom": -0.32, "t2m_anom": 0.17,
    "temp_volatility": 0.26, "month_sin": 0.4, "month_cos": -0.35,
}
X_KEYS = ("prov", "maladie", "debutsem")

CONTRIB = f"""{feature_sql(ft.V3, 'v3')},
rows3 as (select * from v3 where inc_lag4 is not null),
means as (select {', '.join(f'avg({c}) as m_{c}' for c in COEF)} from rows3 where annee <= {CUT}),
contrib as (select prov, maladie, debutsem,
  {', '.join(f'{b} * ({c} - m_{c}) as {c}' for c, b in COEF.items())}
  from rows3, means where annee > {CUT}),
long as (select * from contrib unpivot include nulls (phi for feature in ({', '.join(COEF)})))"""


def explained(spark, sf, keep=X_KEYS):
    v3 = materialise(
        ft.features_v3(fx.master(spark, sf)).select(*X_KEYS, "annee", *COEF)
    )
    means = X.feature_means(v3.where(F.col("annee") <= CUT), list(COEF))
    return X.linear_contributions(v3.where(F.col("annee") > CUT), COEF, means, keep)


@query(
    "x01_linear_contributions",
    f"""with {CONTRIB} select prov, maladie, debutsem, feature, round(phi, 6) + 0.0 as phi from long""",
)
def x01(spark, sf):
    return X.to_long(explained(spark, sf), X_KEYS)


@query(
    "x02_wide_contributions",
    f"""with {CONTRIB} select prov, maladie, debutsem,
      {', '.join(f'round({c}, 6) + 0.0 as phi_{c}' for c in COEF)} from contrib""",
)
def x02(spark, sf):
    """The contributions are wide already: one projection, no shuffle."""
    return explained(spark, sf)


@query(
    "x02_wide_from_long",
    f"with {CONTRIB} select prov, maladie, debutsem, {r(*COEF)} from contrib",
)
def x02_from_long(spark, sf):
    return X.to_wide(x01(spark, sf), X_KEYS, list(COEF))


GLOBAL = "imp as (select feature, avg(abs(phi)) as importance from long group by 1)"


@query(
    "a16_global_importance",
    f"with {CONTRIB}, {GLOBAL} select feature, round(importance, 6) + 0.0 as importance from imp",
)
def a16(spark, sf):
    return X.global_importance(explained(spark, sf))


IMPORTANCE_SCHEMA = T.StructType(
    [
        T.StructField("maladie", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("importance", T.DoubleType()),
    ]
)
BY_GROUP = "gimp as (select maladie, feature, avg(abs(phi)) as importance from long group by 1, 2)"
GROUP_SQL = f"""with {CONTRIB}, {BY_GROUP}
select maladie, feature, round(importance, 6) + 0.0 as importance from gimp"""


@query("a17_importance_per_disease", GROUP_SQL)
def a17(spark, sf):
    return X.group_importance(explained(spark, sf), "maladie")


@query("s05_group_table_sink", GROUP_SQL)
def s05(spark, sf):
    path = scratch_path(spark, "by-disease")
    src.write_table(a17(spark, sf), path, "csv")
    return src.read_panel(spark, path, "csv", schema=IMPORTANCE_SCHEMA)


@query(
    "o03_top_features",
    f"""with {CONTRIB}, {GLOBAL} select feature, round(importance, 6) + 0.0 as importance from imp
    order by imp.importance desc, feature limit 5""",
)
def o03(spark, sf):
    return topk.top_features(a16(spark, sf), 5)


@query(
    "o05_top_features_per_disease",
    f"""with {CONTRIB}, {BY_GROUP} select maladie, feature, round(importance, 6) + 0.0 as importance,
      cast(rn as int) as rank from (select *, row_number() over
        (partition by maladie order by importance desc, feature) as rn from gimp) where rn <= 3""",
)
def o05(spark, sf):
    return topk.top_per_group(a17(spark, sf), ["maladie"], 3)


@query(
    "o07_waterfall",
    f"""with {CONTRIB}, s as (select *, row_number() over
      (partition by prov, maladie, debutsem order by abs(phi) desc, feature) as rn from long),
    g as (select prov, maladie, debutsem, case when rn <= 10 then feature else 'Others' end as feature,
      sum(phi) as phi from s group by all)
    select prov, maladie, debutsem, feature, round(phi, 6) + 0.0 as phi, cast(row_number() over
      (partition by prov, maladie, debutsem order by g.phi, feature) as int) as position from g""",
)
def o07(spark, sf):
    return topk.waterfall(explained(spark, sf), X_KEYS, 10)


@query(
    "o09_dependence",
    f"""with {CONTRIB}, {GLOBAL}, top as (select feature from imp order by importance desc, feature limit 4),
    narrow as (select prov, maladie, debutsem, {', '.join(COEF)} from rows3),
    vals as (select * from narrow unpivot include nulls (x for feature in ({', '.join(COEF)})))
    select prov, maladie, debutsem, feature, round(phi, 6) + 0.0 as phi, round(x, 6) + 0.0 as x
    from long join vals using (prov, maladie, debutsem, feature) semi join top using (feature)""",
)
def o09(spark, sf):
    wide = materialise(explained(spark, sf, [*X_KEYS, *COEF]))
    return topk.dependence(wide, X.global_importance(wide), X_KEYS, 4)


# ---- training ------------------------------------------------------------------------------------

# What several queries of one session train or search is done once for each set of tables.
_DONE = {}
_LOCK = threading.RLock()


def once(what, spark, sf, make):
    with _LOCK:
        key = (what, sf, spark.sparkContext.applicationId)
        if key not in _DONE:
            _DONE[key] = make()
        return _DONE[key]


def split_v3(spark, sf):
    """(train, test, columns): the whole v3 table with places as codes, missing values filled
    with training medians."""

    def make():
        rows, columns = nowcast_matrix(ft.features_v3(fx.master(spark, sf)), CUT)
        early, late = rows.where(F.col("annee") <= CUT), rows.where(F.col("annee") > CUT)
        train, test = (materialise(df) for df in E.impute_median(early, [early, late], columns))
        return train, test, columns

    return once("v3", spark, sf, make)


def all_trained(spark, sf, names):
    """Models of the six at full size by name, each fitted once a session; those that are still
    to be fitted are fitted side by side."""
    with _LOCK:
        kept = once("models", spark, sf, dict)
        specs = [s for s in M.fixed_specs() if s.name in names and s.name not in kept]
        if specs:
            train, _, columns = split_v3(spark, sf)
            kept |= {f.spec.name: f for f in M.fit_models(train, columns, LABEL, specs)}
        return {name: kept[name] for name in names}


def trained(spark, sf, name):
    """One of the six models; no other is fitted for it."""
    return all_trained(spark, sf, [name])[name]


def compared(spark, sf):
    """(model, keys, y, p) of all six models over the test rows."""
    _, test, _ = split_v3(spark, sf)
    fitted = [*all_trained(spark, sf, [s.name for s in M.fixed_specs()]).values()]
    return once("compared", spark, sf, lambda: materialise(M.score_models(fitted, test, LABEL, X_KEYS)))


# What does not depend on the solver: the rows, their labels, that p is a probability, and that
# the model satisfies its certificate (`ml.certify`), which a constant classifier does not.
TEST_ROWS = f"""kept as (select * from v3 where inc_lag4 is not null), test_rows as (
  select prov, maladie, debutsem, is_outbreak from kept
  where annee > {CUT} and maladie in (select maladie from kept where annee <= {CUT}))"""
SCORED_SQL = f"""with {feature_sql(ft.V3, 'v3')}, {TEST_ROWS}
select *, true as is_probability, true as certified from test_rows"""


def model_query(name):
    def build(spark, sf):
        train, test, _ = split_v3(spark, sf)
        fitted = trained(spark, sf, name)
        proven = once(f"certificate of {name}", spark, sf, lambda: certified(fitted, train, LABEL))
        scored = fitted.score(test)
        return scored.select(
            *X_KEYS, LABEL, F.col("p").between(0, 1).alias("is_probability"), F.lit(proven).alias("certified")
        )

    return build


MODEL_IDS = {
    "m01_weighted_boosting": "XGBoost",
    "m02_random_forest": "Random Forest",
    "m03_gradient_boosting": "Gradient Boosting",
    "m04_logistic_regression": "Logistic Regression",
    "m05_radial_svm": "SVM",
    "m06_neural_network": "Neural Network",
}
for _id, _model in MODEL_IDS.items():
    query(_id, SCORED_SQL)(model_query(_model))

SIX = f"(values {', '.join(f'({chr(39)}{m}{chr(39)})' for m in MODEL_IDS.values())}) m(model)"


@query(
    "m08_compare_models",
    f"""with {feature_sql(ft.V3, 'v3')}, {TEST_ROWS}, n as (select count(*) as rows,
      cast(sum(is_outbreak) as bigint) as positives from test_rows)
    select model, rows, positives, true as rates_fit from n, {SIX}""",
)
def m08_checked(spark, sf):
    """Each model's counts cover the test rows and its rates follow from them."""
    pred = compared(spark, sf)
    counts = pred.groupBy("model").agg(F.count("*").alias("rows"), F.sum("y").cast("bigint").alias("positives"))
    rates = V.comparison(pred, ["model"], 0.2, strict=True)
    fit = F.lit(True)
    for name in ("precision", "recall", "f1", "auc"):
        fit = fit & F.coalesce(F.col(name).between(0, 1), F.lit(True))
    return counts.join(rates, "model").select("model", "rows", "positives", fit.alias("rates_fit"))


@query("m08_comparison_table", f"select model, true as recomputed, true as in_order from {SIX}")
def m08(spark, sf):
    """The table at a threshold of 0.2, each rate and area held against the rows it is of."""
    pred = compared(spark, sf)
    table = V.comparison(pred, ["model"], 0.2, strict=True)
    flagged = pred.withColumn("hit", F.coalesce(F.col("p") > 0.2, F.lit(False)))
    at = {"tp": (1, True), "fp": (0, True), "fn": (1, False)}
    own = flagged.groupBy("model").agg(*[F.count_if((F.col("y") == y) & (F.col("hit") == h)).alias(f"own_{n}") for n, (y, h) in at.items()])
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = (F.col(f"own_{n}") for n in at)
    # The share of pairs that a model orders rightly, by the mean rank of the positives.
    rank = F.rank().over(Window.partitionBy("model").orderBy("p"))
    ties = F.count("*").over(Window.partitionBy("model", "p"))
    ranked = pred.withColumn("r", rank + (ties - 1) / 2).groupBy("model").agg(
        F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("r1"), F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")
    )
    area = F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0"))
    close = lambda a, b: F.coalesce(F.abs(a - b) < 1e-9, a.isNull() & b.isNull())
    checks = close(F.col("precision"), share(tp, tp + fp)) & close(F.col("recall"), share(tp, tp + fn)) & close(F.col("auc"), area)
    before = F.lag("auc").over(Window.orderBy("position"))  # six rows
    placed = table.select("*", F.monotonically_increasing_id().alias("position")).withColumn("before", before)
    in_order = F.coalesce(F.col("before") >= F.col("auc"), F.lit(True))
    return placed.join(own, "model").join(ranked, "model").select("model", checks.alias("recomputed"), in_order.alias("in_order"))


def disease_table(spark, sf):
    spec = M.ModelSpec("LightGBM", "boosted", M.FULL["lightgbm"], "ratio")
    return once("per disease", spark, sf, lambda: materialise(disease_models(fx.master(spark, sf), CUT, spec)))


@query(
    "m09_model_per_disease",
    f"""with {FORECAST}, g as (select maladie, count(*) as samples, cast(sum(target_outbreak_future) as bigint) as outbreaks,
      count(distinct case when annee <= {CUT} then target_outbreak_future end) as classes,
      count_if(annee > {CUT}) as tests from forecast group by 1)
    select maladie, samples, outbreaks, case when classes < 2 then 'one class in training'
      when tests = 0 then 'no rows to test' else 'trained' end as status, true as rates_fit
    from g where samples >= 300 and outbreaks >= 20""",
)
def m09(spark, sf):
    """A full model of each disease with 300 rows and 20 outbreaks; its rates are rates."""
    fit = F.lit(True)
    for name in ("precision", "recall", "f1", "auc"):
        fit = fit & F.coalesce(F.col(name).between(0, 1), F.lit(True))
    return disease_table(spark, sf).select("maladie", "samples", "outbreaks", "status", fit.alias("rates_fit"))


@query(
    "m10_importances",
    "select cast(i as int) as position, true as is_share, true as adds_up, true as in_order from range(1, 16) t(i)",
)
def m10(spark, sf):
    """The fifteen strongest features of the full forest: shares of a whole, best first."""
    shares = materialise(trained(spark, sf, "Random Forest").importances())
    whole = shares.agg(F.abs(F.sum("importance") - 1) < 1e-9).scalar()
    order = Window.orderBy(F.desc("importance"), "feature")  # fifteen rows
    top = topk.top_features(shares, 15).withColumn("position", F.row_number().over(order).cast("int"))
    before = F.coalesce(F.lag("importance").over(order) >= F.col("importance"), F.lit(True))
    return top.select("position", F.col("importance").between(0, 1).alias("is_share"), whole.alias("adds_up"), before.alias("in_order"))


def forecast_study(spark, sf):
    """The forecast study with its full grid, once a session."""
    spec = M.ModelSpec("Gradient Boosting", "boosted", {"subsamplingRate": 0.8}, 4)

    def make():
        table = ft.forecast_table(fx.master(spark, sf), CUT)
        return forecast_grid(table, CUT, spec, M.GRIDS["gradient_boosting"])

    return once("forecast study", spark, sf, make)


def stratified_search(spark, sf):
    """A full grid over stratified folds of the training years of the forecast table."""
    spec = M.ModelSpec("LightGBM", "boosted", {}, "ratio")

    def make():
        matrix, columns = forecast_matrix(ft.forecast_table(fx.master(spark, sf), CUT))
        train = materialise(matrix.where(F.col("annee") <= CUT))
        rows = splits.stratified_folds(train, 3, ft.TARGET, ("row_debutsem", "row_prov"), ("row_maladie",))
        return M.grid_search(rows, columns, ft.TARGET, spec, M.GRIDS["lightgbm"], M.stratified_conditions(3))

    return once("stratified search", spark, sf, make)


def options_sql(name):
    rows = ", ".join(f"({i}, '{str(o).replace(chr(39), chr(39) * 2)}')" for i, o in enumerate(M.combinations(M.GRIDS[name])))
    return f"select cast(option as int) as option, params, true as in_range, true as recomputed from (values {rows}) o(option, params)"


def checked_options(found):
    """Every option's mean F1 against the one of its folds' stored probabilities, counted anew."""
    each = found.predictions.select("fold", "y", F.inline(F.arrays_zip(F.col("options").alias("option"), F.col("stages").alias("p"))).alias("option", "p"))
    anew = V.threshold_sweep(each, [0.5], ["option", "fold"]).groupBy("option").agg(F.avg("f1").alias("anew"))
    same = F.abs(F.col("mean_f1") - F.col("anew")) < 1e-12
    return found.results.join(anew, "option").select(
        "option", "params", F.col("mean_f1").between(0, 1).alias("in_range"), same.alias("recomputed")
    )


@query("e10_grid_search_expanding", options_sql("gradient_boosting"))
def e10(spark, sf):
    return checked_options(forecast_study(spark, sf).search)


@query("e10_grid_search_stratified", options_sql("lightgbm"))
def e10b(spark, sf):
    return checked_options(stratified_search(spark, sf))


def tree_phi(spark, sf):
    """(wide contributions, base) of the full gradient boosting over the test rows, stored."""

    def make():
        _, test, columns = split_v3(spark, sf)
        wide, base = X.tree_contributions(trained(spark, sf, "Gradient Boosting").model, test, columns, X_KEYS)
        return materialise(wide), base

    return once("contributions", spark, sf, make)


@query(
    "x01_tree_contributions",
    f"with {feature_sql(ft.V3, 'v3')}, {TEST_ROWS} select prov, maladie, debutsem, true as adds_up from test_rows",
)
def x01_tree(spark, sf):
    """Contributions of the full model; with the base value they add up to the log-odds."""
    _, test, columns = split_v3(spark, sf)
    wide, base = tree_phi(spark, sf)
    total = sum((F.col(X.PREFIX + c) for c in columns), F.lit(base))
    scored = trained(spark, sf, "Gradient Boosting").score(test).select(*X_KEYS, "p")
    # The probability loses digits near 0 and 1, so the sum is brought to its scale.
    apart = F.abs(1 / (1 + F.exp(-total)) - F.col("p"))
    return wide.join(scored, list(X_KEYS)).select(*X_KEYS, (apart < 1e-9).alias("adds_up"))


@query(
    "x01_tree_importances",
    f"""with {feature_sql(ft.V3, 'v3')}, {TEST_ROWS} select maladie, count(*) as n_rows, true as recomputed, true as not_negative
    from test_rows group by 1""",
)
def x01_tree_importances(spark, sf):
    """Every importance per disease is the mean of the absolute contributions of its rows."""
    wide, _ = tree_phi(spark, sf)
    found = X.group_importance(wide, "maladie", exclude=("maladie_code",))
    long = X.to_long(wide, X_KEYS)
    own = long.groupBy("maladie", "feature").agg((F.sum(F.abs("phi")) / F.count("phi")).alias("own"), F.count("phi").alias("n_rows"))
    same = F.abs(F.col("importance") - F.col("own")) <= 1e-12 + 1e-9 * F.abs("own")
    return found.join(own, ["maladie", "feature"]).groupBy("maladie").agg(
        F.max("n_rows").alias("n_rows"), F.every(same).alias("recomputed"), F.every(F.col("importance") >= 0).alias("not_negative")
    )
