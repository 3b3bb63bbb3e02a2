"""All registered queries.  Importing the modules fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigipanel.plans import q_edges, q_groups, q_models, q_more, q_tables
from vigipanel.plans.catalog import ORACLES, QUERIES

MODULES = (q_tables, q_groups, q_models, q_edges, q_more)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["p16_drop_warmup"](spark, sf)


__all__ = ["ORACLES", "QUERIES", "flagship"]
