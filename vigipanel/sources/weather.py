"""Monthly weather: landed JSON documents, the long form, the wide form, the join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vigipanel.schema import WEATHER, WEATHER_JSON_TYPE
from vigipanel.session import small_side
from vigipanel.sources.panel import write_table

DOCUMENT = StructType(
    [StructField("properties", StructType([StructField("parameter", WEATHER_JSON_TYPE)]))]
)


def distinct_locations(df: DataFrame, columns: Sequence[str] = ("prov", "lat", "lon")) -> DataFrame:
    """Complete, distinct locations: what a fetch has to ask for."""
    return df.select(*columns).dropna().distinct()


def landed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(prov, body, corrupt) of a folder of JSON documents, one per province.

    The province is the folder's (`prov=<name>/...`) or else the file's name (`<name>.json`).
    `corrupt` marks bodies without a readable parameter map, so that a caller can count or
    refuse them.
    """
    files = spark.read.text(path, wholetext=True)
    if "prov" in files.columns:
        prov = F.col("prov").cast("string")
    else:
        name = F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1)
        # Scanned names come URL-encoded; a malformed escape is no reason to lose the file.
        prov = F.coalesce(F.try_url_decode(name), name)
    parsed = F.from_json("value", DOCUMENT)
    return files.select(
        prov.alias("prov"),
        F.col("value").alias("body"),
        parsed["properties"]["parameter"].isNull().alias("corrupt"),
    )


def master_from_documents(spark: SparkSession, path: str, panel: DataFrame, out: str) -> DataFrame:
    """Step one as a whole: landed documents, long form, wide form, left join, stored table.

    A corrupt document stops it; leaving one out would show only as missing weather.
    """
    landed = landed_documents(spark, path)
    checked = F.when(F.col("corrupt"), F.raise_error(F.concat(F.lit("corrupt weather of "), "prov")).cast("string"))
    documents = landed.withColumn("body", F.coalesce(checked, "body"))
    write_table(join_weather(panel, pivot_weather(weather_long(documents))), out)
    return spark.read.parquet(out)


def weather_long(documents: DataFrame, body: str = "body", keys: Sequence[str] = ("prov",)):
    """One row per (location, year, month, parameter) from one JSON document per location.

    The document nests properties.parameter as {parameter: {YYYYMM: value}}.  Keys
    whose last two digits are no month (yearly means use 13) are left out.  Parameter names
    come out in lower case, as the columns are called.
    """
    parsed = documents.select(*keys, F.from_json(body, DOCUMENT).alias("doc"))
    series = parsed.select(*keys, F.explode("doc.properties.parameter").alias("param", "values"))
    cells = series.select(*keys, "param", F.explode("values").alias("yyyymm", "value"))
    return cells.select(
        *keys,
        F.substring("yyyymm", 1, 4).cast("int").alias("annee"),
        F.substring("yyyymm", 5, 2).cast("int").alias("mois"),
        F.lower("param").alias("param"),
        "value",
    ).where(F.col("mois").between(1, 12))


def pivot_weather(
    long: DataFrame,
    params: Sequence[str] = WEATHER,
    keys: Sequence[str] = ("prov", "annee", "mois"),
) -> DataFrame:
    """Wide form; several values for one cell are averaged.  One shuffle, no name scan."""
    return long.groupBy(*keys).pivot("param", list(params)).agg(F.avg("value"))


def join_weather(
    panel: DataFrame, weather: DataFrame, keys: Sequence[str] = ("prov", "annee", "mois")
) -> DataFrame:
    """Left join of many weeks to one month; weeks without weather keep NULLs."""
    return panel.join(small_side(weather), list(keys), "left")
