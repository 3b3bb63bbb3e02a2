"""Choosing columns by name.  These work on schemas only and start no job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def feature_columns(
    df: DataFrame, exclude: Iterable[str], prefixes: Sequence[str] = ()
) -> list[str]:
    exclude = set(exclude)
    return [
        c for c in df.columns if c not in exclude and not any(c.startswith(p) for p in prefixes)
    ]


def drop_if_exists(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def select_existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def columns_like(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(p in c for p in patterns)]


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def drop_warmup(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))
