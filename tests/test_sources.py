import datetime as dt
import json

import pytest

from vigipanel.schema import HEALTH_SCHEMA
from vigipanel.session import scratch_path
from vigipanel.sources import panel as P
from vigipanel.sources import weather as X


def document(values):
    return json.dumps({"properties": {"parameter": values}, "type": "Feature"})


def test_json_month_thirteen_is_left_out(spark):
    docs = spark.createDataFrame(
        [("a", document({"T2M": {"200601": 25.0, "200613": 24.0, "200612": 26.0}}))],
        "prov string, body string",
    )
    rows = sorted((r.annee, r.mois, r.param, r.value) for r in X.weather_long(docs).collect())
    assert rows == [(2006, 1, "t2m", 25.0), (2006, 12, "t2m", 26.0)]


def test_two_locations_of_one_province_are_averaged(spark):
    docs = spark.createDataFrame(
        [("a", document({"t2m": {"200601": 20.0}})), ("a", document({"t2m": {"200601": 30.0}}))],
        "prov string, body string",
    )
    row = X.pivot_weather(X.weather_long(docs)).first()
    assert (row.t2m, row.rh2m) == (25.0, None)


def test_left_join_keeps_weeks_without_weather(spark):
    panel = spark.createDataFrame(
        [("a", 2006, 1), ("a", 2006, 2), (None, 2006, 1)], "prov string, annee int, mois int"
    )
    weather = spark.createDataFrame(
        [("a", 2006, 1, 9.0)], "prov string, annee int, mois int, t2m double"
    )
    out = X.join_weather(panel, weather)
    assert sorted((str(r.prov), r.mois, r.t2m) for r in out.collect()) == [
        ("None", 1, None), ("a", 1, 9.0), ("a", 2, None),
    ]


def test_csv_keeps_missing_values(spark):
    row = ("a", 1.0, None, "m", dt.date(2006, 1, 2), 2006, 1, None, 3, 100)
    path = scratch_path(spark, "csv")
    P.write_table(spark.createDataFrame([row], HEALTH_SCHEMA), path, "csv")
    assert tuple(P.read_panel(spark, path, "csv").first()) == row


def test_nan_becomes_null_at_read(spark):
    path = scratch_path(spark, "nan")
    P.write_table(spark.createDataFrame([(float("nan"),)], "lat double"), path)
    assert P.read_panel(spark, path).first().lat is None


def test_load_or_build_builds_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    path = scratch_path(spark, "prebuilt")
    assert P.load_or_build(spark, path, build).count() == 5
    assert P.load_or_build(spark, path, build).count() == 5
    assert len(calls) == 1


def test_load_required(spark):
    with pytest.raises(FileNotFoundError):
        P.load_required(spark, scratch_path(spark, "absent"))


def test_duplicates_and_locations(spark):
    df = spark.createDataFrame(
        [("a", "m", 1, 0.5), ("a", "m", 1, 0.5), ("b", "m", 1, None)],
        "prov string, maladie string, debutsem int, lat double",
    )
    assert [tuple(r) for r in P.duplicates(df).collect()] == [("a", "m", 1, 2)]
    with pytest.raises(ValueError):
        P.require_weekly(df)
    assert P.require_weekly(df.distinct()).count() == 2
    assert [tuple(r) for r in X.distinct_locations(df, ["prov", "lat"]).collect()] == [("a", 0.5)]
