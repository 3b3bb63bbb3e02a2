"""Column names and schemas of a weekly panel.

A panel has one row per (prov, maladie, debutsem): an entity, a category and the
first day of a week.  That contract bounds every (prov, maladie) group by the
number of weeks in the calendar, however large the table gets, and it is what
lets the ordered operators keep a group in one task.  `sources.panel.duplicates`
checks it.  Groups by anything coarser (a disease, a month, the whole table) have
no such bound and go through the operators in `operators.ranks`.
"""

from pyspark.sql import types as T

PROV = "prov"
DISEASE = "maladie"
WEEK = "debutsem"
YEAR = "annee"
MONTH = "mois"
CASES = "totalcas"
DEATHS = "totaldeces"
POP = "pop"

KEYS = (PROV, DISEASE)
ROW_KEY = (PROV, DISEASE, WEEK)
WEATHER = ("prectotcorr", "t2m", "rh2m")
# A fourth measure that some weather documents have.
WIND = "ws2m"

HEALTH_SCHEMA = T.StructType(
    [
        T.StructField(PROV, T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField(DISEASE, T.StringType()),
        T.StructField(WEEK, T.DateType()),
        T.StructField(YEAR, T.IntegerType()),
        T.StructField(MONTH, T.IntegerType()),
        T.StructField(CASES, T.LongType()),
        T.StructField(DEATHS, T.LongType()),
        T.StructField(POP, T.LongType()),
    ]
)

MASTER_SCHEMA = T.StructType(
    HEALTH_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in WEATHER]
)

# {parameter: {YYYYMM: value}} of one location
WEATHER_JSON_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))

LABEL = "is_outbreak"
TARGET = "target_outbreak_future"
INCIDENCE = "incidence"

# Columns that must stay out of a model matrix, per use.
NOWCAST_EXCLUDE = (
    "is_outbreak",
    "is_outbreak_new",
    "is_outbreak_old",
    "target",
    "target_outbreak_future",
    "totalcas",
    "totaldeces",
    "incidence",
    "debutsem",
)
FORECAST_EXCLUDE = ("target_outbreak_future", "is_outbreak", "incidence", "debutsem")
NOISY_INTERACTIONS = ("rain_temp", "hum_temp")
CLIMATE_EXCLUDE = (
    "debutsem",
    "maladie",
    "is_outbreak",
    "target_outbreak_future",
    "totalcas",
    "totaldeces",
    "incidence",
)
CLIMATE_EXCLUDE_PREFIXES = ("inc_", "roll_mean_")
CLIMATE_WHITELIST = (
    "lat",
    "lon",
    "pop",
    "t2m",
    "rh2m",
    "prectotcorr",
    "t2m_lag4",
    "rh2m_lag4",
    "prectotcorr_lag4",
    "t2m_anom",
    "rh2m_anom",
    "prectotcorr_anom",
    "temp_volatility",
    "rain_volatility",
    "rh_volatility",
    "month_sin",
    "month_cos",
)
