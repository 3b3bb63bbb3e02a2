"""Joins of a table with its own group statistics, and filters on whole groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.session import small_side


def has_all(keys: Sequence[str]) -> Column:
    """Whether a row has all of its keys."""
    return reduce(and_, (F.col(k).isNotNull() for k in keys), F.lit(True))


def attach_stats(
    df: DataFrame,
    keys: Sequence[str],
    stats: Mapping[str, Column],
    *,
    weekly_groups: bool = False,
) -> DataFrame:
    """Put a statistic of each group back on its rows; rows without a key get NULL.

    Groups bounded by the calendar use a window, which shares the exchange of other
    windows on the keys.  Others aggregate (map-side combined) and join back.
    """
    keys = list(keys)
    if weekly_groups:
        group = Window.partitionBy(*keys)
        return df.withColumns({n: F.when(has_all(keys), s.over(group)) for n, s in stats.items()})
    table = df.dropna(subset=keys).groupBy(*keys).agg(*[s.alias(n) for n, s in stats.items()])
    return df.join(small_side(table), keys, "left")


def add_anomaly(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    name: str = "{col}_anom",
    *,
    weekly_groups: bool = False,
) -> DataFrame:
    """Value minus the mean of its group."""
    means = {f"__{c}_mean": F.avg(c) for c in columns}
    out = attach_stats(df, keys, means, weekly_groups=weekly_groups)
    return out.withColumns(
        {name.format(col=c): F.col(c) - F.col(f"__{c}_mean") for c in columns}
    ).drop(*means)


def distinct_values(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def period_presence(df: DataFrame, keys: Sequence[str], cut: int, year: str = "annee") -> DataFrame:
    """(keys, early, late): whether each group has rows up to and after the cut year."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.max((F.col(year) <= cut).cast("int")).alias("early"),
            F.max((F.col(year) > cut).cast("int")).alias("late"),
        )
    )


def in_both_periods(
    df: DataFrame,
    keys: Sequence[str],
    cut: int,
    year: str = "annee",
    *,
    weekly_groups: bool = False,
) -> DataFrame:
    """Rows of the groups that occur on both sides of the cut year."""
    keys = list(keys)
    if weekly_groups:
        group = Window.partitionBy(*keys)
        return (
            df.dropna(subset=keys)
            .withColumns(
                {
                    "__early": F.max((F.col(year) <= cut).cast("int")).over(group),
                    "__late": F.max((F.col(year) > cut).cast("int")).over(group),
                }
            )
            .where((F.col("__early") == 1) & (F.col("__late") == 1))
            .drop("__early", "__late")
        )
    both = period_presence(df, keys, cut, year).where("early = 1 and late = 1").select(*keys)
    return df.join(small_side(both), keys, "left_semi")


def only_one_period(df: DataFrame, keys: Sequence[str], cut: int, year: str = "annee") -> DataFrame:
    """The groups that occur on one side of the cut year only."""
    return period_presence(df, keys, cut, year).where("early + late = 1").select(*keys)


def common_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def keys_only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).subtract(right.select(*keys))


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in `members`."""
    return df.join(small_side(members.select(*keys).distinct()), list(keys), "left_semi")


def eligible_groups(
    df: DataFrame, keys: Sequence[str], label: str, min_rows: int, min_positives: int
) -> DataFrame:
    """(keys, samples, outbreaks) of the groups with enough rows and positives."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("samples"), F.sum(label).cast("bigint").alias("outbreaks"))
        .where((F.col("samples") >= min_rows) & (F.col("outbreaks") >= min_positives))
    )
