"""Counts and rates that describe a panel or a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, label: str = "is_outbreak") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min("annee").alias("first_year"),
        F.max("annee").alias("last_year"),
        F.count_distinct("prov").alias("provinces"),
        F.count_distinct("maladie").alias("diseases"),
        F.avg(label).alias("outbreak_rate"),
    )


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing) for the columns that miss values, from one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "missing").where("missing > 0")


def class_balance(df: DataFrame, label: str, eps: float = 0.0) -> DataFrame:
    """(negatives, positives, ratio); ratio is NULL without positives unless eps > 0."""
    negatives = F.count_if(F.col(label) == 0)
    positives = F.count_if(F.col(label) == 1)
    return df.agg(
        negatives.alias("negatives"),
        positives.alias("positives"),
        F.try_divide(negatives.cast("double"), positives + F.lit(eps)).alias("ratio"),
    )


def imbalance_ratio(df: DataFrame, label: str, eps: float = 0.0) -> float:
    ratio = class_balance(df, label, eps).first()["ratio"]
    return 1.0 if ratio is None else float(ratio)


def split_report(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(label).alias("outbreak_rate")
    )


def drop_report(df: DataFrame, kept: Column) -> DataFrame:
    """(before, after, dropped) of a filter, without running it as a second pass."""
    before, after = F.count(F.lit(1)), F.count_if(kept)
    return df.agg(
        before.alias("before"), after.alias("after"), (before - after).alias("dropped")
    )


def complete(columns: Sequence[str]) -> Column:
    """True where none of the columns is missing."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition
