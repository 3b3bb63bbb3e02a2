"""Panel, weather and score tables derived from the order tables.

region plays the province, market segment the disease, quantity ordered the cases
and quantity returned the deaths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigipanel.schema import HEALTH_SCHEMA, WEATHER
from vigipanel.session import bounded_by
from vigipanel.sources.weather import join_weather

CUT_YEAR = 1999


# Declared, so that opening a table starts no job to infer its schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _monday(column: str) -> Column:
    return F.trunc(F.to_date(column), "week")


def _order_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities per order.  Lines of an order combine before the join on its key."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias(
                "returned"
            ),
        )
    )


def _places(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly counts per (region, market segment)."""
    places = _places(spark, sf)
    customers = table(spark, sf, "customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    population = customers.groupBy(F.col("r_name").alias("prov")).agg(
        (F.count(F.lit(1)) * 1000).alias("pop")
    )
    lines = _order_totals(spark, sf)
    orders = table(spark, sf, "orders")
    weekly = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("r_name").alias("prov"),
            F.col("r_regionkey").alias("r_regionkey"),
            F.col("c_mktsegment").alias("maladie"),
            _monday("o_orderdate").alias("debutsem"),
        )
        .agg(F.sum("qty").alias("qty"), F.sum("returned").alias("returned"))
    )
    # One row per region.  Shuffling the panel to it would leave a task per region.
    population = bounded_by(population, table(spark, sf, "region"))
    made = weekly.join(population, "prov").select(
        "prov",
        (F.col("r_regionkey") * 5 - 10).alias("lat"),
        (F.col("r_regionkey") * 10).alias("lon"),
        "maladie",
        "debutsem",
        F.year("debutsem").alias("annee"),
        F.month("debutsem").alias("mois"),
        F.col("qty").alias("totalcas"),
        F.col("returned").alias("totaldeces"),
        "pop",
    )
    return made.select(*[F.col(f.name).cast(f.dataType) for f in HEALTH_SCHEMA])


def weather_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Three monthly measures per supplier region, wide."""
    suppliers = table(spark, sf, "supplier").join(
        _places(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return (
        table(spark, sf, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.col("r_name").alias("prov"),
            F.year("l_shipdate").alias("annee"),
            F.month("l_shipdate").alias("mois"),
        )
        .agg(
            # Rounded, so that equal means are equal whatever order they were summed in.
            F.round(F.avg("l_quantity"), 10).alias("prectotcorr"),
            F.round(F.avg("l_discount") * 400, 10).alias("t2m"),
            F.round(F.avg("l_tax") * 1500, 10).alias("rh2m"),
        )
    )


def weather_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same measures, one row per parameter."""
    return weather_monthly(spark, sf).unpivot(
        ["prov", "annee", "mois"], list(WEATHER), "param", "value"
    )


def weather_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per region, nested the way the weather service answers."""
    by_month = weather_rows(spark, sf).select(
        "prov",
        "param",
        F.struct(
            F.format_string("%04d%02d", "annee", "mois").alias("key"), F.col("value")
        ).alias("cell"),
    )
    by_param = by_month.groupBy("prov", "param").agg(
        F.map_from_entries(F.collect_list("cell")).alias("series")
    )
    nested = by_param.groupBy("prov").agg(
        F.map_from_entries(F.collect_list(F.struct("param", "series"))).alias("parameter")
    )
    return nested.select(
        "prov",
        F.to_json(F.struct(F.struct("parameter").alias("properties"))).alias("body"),
    )


def master(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with weather: the input of every feature build."""
    return join_weather(panel(spark, sf), weather_monthly(spark, sf))


def brand_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly counts per (nation, brand): many more groups, for benchmarks."""
    customers = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("n_name").alias("prov"),
            F.col("p_brand").alias("maladie"),
            _monday("o_orderdate").alias("debutsem"),
        )
        .agg(F.sum("l_quantity").cast("bigint").alias("totalcas"))
    )


Query = Callable[[SparkSession, str], DataFrame]
