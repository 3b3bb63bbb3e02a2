"""Outbreak thresholds and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.functions.scalar import exceeds, hybrid_threshold
from vigipanel.operators.groups import has_all
from vigipanel.operators.ranks import exact_quantiles
from vigipanel.session import materialise, small_side

# The quantiles of the hybrid rule.
QUANTILES = {"q1": 0.25, "q3": 0.75, "p90": 0.90}


def outbreak_thresholds(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    weekly_groups: bool = False,
    steps: int | None = None,
) -> DataFrame:
    """(keys, threshold): max(Q3 + 1.5 IQR, P90) of the present values of each group.

    `weekly_groups` says that a group is bounded by the calendar, so one aggregation
    buffer can hold it; otherwise the quantiles are found without gathering a group, by
    2**steps cells if `steps` is given.
    """
    df = df.dropna(subset=list(keys))
    if weekly_groups:
        at = F.percentile(value, list(QUANTILES.values()))
        quantiles = (
            df.groupBy(*keys)
            .agg(at.alias("__q"))
            .select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(QUANTILES)])
        )
    else:
        quantiles = exact_quantiles(df, keys, value, QUANTILES, steps=steps)
    limit = hybrid_threshold(F.col("q1"), F.col("q3"), F.col("p90"))
    return quantiles.select(*keys, limit.alias("threshold"))


def window_threshold(keys: Sequence[str], value: str, fit_until: Column | None = None) -> Column:
    """The same threshold as a window column, for groups bounded by the calendar.

    It shares the exchange of the ordered features on the same keys, where a separate
    aggregation would shuffle the values a second time and join them back.  With `fit_until`
    only the values of those rows count, and every row of the group gets their threshold.
    """
    group = Window.partitionBy(*keys)
    fitted = F.col(value) if fit_until is None else F.when(fit_until, F.col(value))
    at = F.percentile(fitted, list(QUANTILES.values())).over(group)
    return hybrid_threshold(at[0], at[1], at[2])


def label_outbreaks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "is_outbreak",
    *,
    weekly_groups: bool = False,
    fit_until: Column | None = None,
) -> DataFrame:
    """0/1 label: value above the threshold of its group; 0 where either is missing.

    `fit_until` restricts the rows the thresholds are taken from, for example to the
    training years.  An input with coarse keys is stored once, for sizes, cuts, totals and
    the join all read it.
    """
    if weekly_groups:
        limit = F.when(has_all(keys), window_threshold(keys, value, fit_until))
        return (
            df.withColumn("__limit", limit)
            .withColumn(name, exceeds(value, F.col("__limit")))
            .drop("__limit")
        )
    df = materialise(df)
    source = df if fit_until is None else df.where(fit_until)
    limits = outbreak_thresholds(source, keys, value)
    return (
        df.join(small_side(limits), list(keys), "left")
        .withColumn(name, exceeds(value, F.col("threshold")))
        .drop("threshold")
    )
