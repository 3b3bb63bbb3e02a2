import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigipanel.functions.scalar import incidence
from vigipanel.operators.labels import label_outbreaks, outbreak_thresholds

KEYS = ["prov", "maladie"]


def panel(spark, rows):
    start = dt.date(2006, 1, 2)
    made = [
        (p, "m", start + dt.timedelta(weeks=i), cases, pop)
        for i, (p, cases, pop) in enumerate(rows)
    ]
    schema = "prov string, maladie string, debutsem date, totalcas bigint, pop bigint"
    df = spark.createDataFrame(made, schema)
    return df.withColumn("incidence", incidence("totalcas", "pop"))


@pytest.mark.parametrize("weekly", [True, False])
def test_missing_cases_and_empty_population_get_label_zero(spark, weekly):
    rows = [("a", i, 100) for i in range(20)] + [("a", None, 100), ("a", 5, 0), ("a", 900, 100)]
    out = label_outbreaks(panel(spark, rows), KEYS, "incidence", weekly_groups=weekly)
    flags = {(r.totalcas, r.pop): r.is_outbreak for r in out.collect()}
    assert flags[(None, 100)] == 0 and flags[(5, 0)] == 0 and flags[(900, 100)] == 1


@pytest.mark.parametrize("weekly", [True, False])
def test_constant_group_has_no_outbreak(spark, weekly):
    df = panel(spark, [("a", 7, 10)] * 11)
    (limit,) = outbreak_thresholds(df, KEYS, "incidence", weekly_groups=weekly).collect()
    assert limit.threshold == 0.7
    out = label_outbreaks(df, KEYS, "incidence", weekly_groups=weekly)
    assert out.agg(F.sum("is_outbreak")).first()[0] == 0


def test_threshold_is_the_stricter_of_both_rules(spark):
    heavy = [("a", v, 1) for v in [0] * 85 + [50] * 15]
    flat = [("b", v, 1) for v in range(101)]
    rows = {
        r.prov: r.threshold
        for r in outbreak_thresholds(panel(spark, heavy + flat), KEYS, "incidence").collect()
    }
    assert rows["a"] == 50.0  # the fence is 0, the 90th percentile 50
    assert rows["b"] == 150.0  # 75 + 1.5 * 50


def test_rows_without_a_key_have_no_threshold(spark):
    df = panel(spark, [(None, i, 1) for i in range(10)] + [("a", i, 1) for i in range(10)])
    assert [r.prov for r in outbreak_thresholds(df, KEYS, "incidence").collect()] == ["a"]


def test_fit_until_uses_early_rows_only(spark):
    df = panel(spark, [("a", i % 5, 1) for i in range(50)] + [("a", 100, 1)] * 30)
    early = F.col("debutsem") < dt.date(2006, 12, 1)
    all_rows = label_outbreaks(df, KEYS, "incidence").agg(F.sum("is_outbreak")).first()[0]
    train = label_outbreaks(df, KEYS, "incidence", fit_until=early)
    assert all_rows == 0
    assert train.agg(F.sum("is_outbreak")).first()[0] == 30
