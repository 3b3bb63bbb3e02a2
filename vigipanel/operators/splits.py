"""Train/test splits and folds.

Every split is a column on the rows.  Splits by position rank the rows through
`rank_in_slices`, so no task sorts the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigipanel.operators.ranks import rank_in_slices


def for_group(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def split_by_year(df: DataFrame, cut: int, year: str = "annee", name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(F.col(year) <= cut, "train").otherwise("test"))


def date_quantile(df: DataFrame, day: str, q: float) -> DataFrame:
    """One row with the interpolated quantile of a date, in days since 1970.

    Rows are counted per day first; the quantile is taken over the days, whose number
    the calendar bounds.
    """
    days = df.where(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.percentile(F.unix_date(day), q, F.col("n")).alias("cut"))


def split_by_date_quantile(
    df: DataFrame, q: float, day: str = "debutsem", name: str = "split"
) -> DataFrame:
    cut = date_quantile(df, day, q).scalar()
    return df.withColumn(name, F.when(F.unix_date(day) <= cut, "train").otherwise("test"))


def ranked_rows(
    df: DataFrame,
    slices: Sequence[str],
    order: Sequence[str],
    within: Sequence[str] = (),
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Global position by the columns of `slices`, then `order`, starting at 1."""
    levels = [F.col(c) for c in slices]
    return rank_in_slices(df, slices=levels, order=order, keys=within, name=name, total=total)


def split_by_fraction(
    df: DataFrame,
    fraction: float,
    slices: Sequence[str] = ("annee", "mois", "debutsem", "prov"),
    order: Sequence[str] = ("maladie",),
    name: str = "split",
) -> DataFrame:
    """The first floor(fraction * n) rows train.  `slices + order` must be unique."""
    limit = F.floor(F.lit(float(fraction)) * F.col("__total"))
    return (
        ranked_rows(df, slices, order, name="__rank", total="__total")
        .withColumn(name, F.when(F.col("__rank") <= limit, "train").otherwise("test"))
        .drop("__rank", "__total")
    )


def expanding_folds(
    df: DataFrame,
    n_splits: int = 3,
    slices: Sequence[str] = ("debutsem", "prov"),
    order: Sequence[str] = ("maladie",),
    name: str = "block",
) -> DataFrame:
    """Blocks 0..n_splits in row order; fold i trains on blocks < i and tests on block i.

    The test blocks are equally long and block 0 takes the remainder.
    """
    total = F.col("__total")
    few = F.raise_error(F.lit(f"fewer rows than {n_splits} folds need"))
    size = F.floor(total / (n_splits + 1))
    size = F.when(size > 0, size).otherwise(few.cast("bigint"))
    first = total - n_splits * size
    position = F.col("__rank") - 1
    block = F.when(position < first, F.lit(0)).otherwise(F.floor((position - first) / size) + 1)
    return (
        ranked_rows(df, slices, order, name="__rank", total="__total")
        .withColumn(name, block.cast("int"))
        .drop("__rank", "__total")
    )


def stratified_folds(
    df: DataFrame,
    n_splits: int,
    label: str,
    slices: Sequence[str] = ("debutsem", "prov"),
    order: Sequence[str] = ("maladie",),
    name: str = "fold",
) -> DataFrame:
    """Unshuffled stratified folds: every class is dealt to the folds in row order.

    The classes lie one after the other, the class of the first row first; fold f gets
    as many rows of a class as the class covers positions j with j mod n_splits = f.
    """
    ordered = [*slices, *order]
    sizes = (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ordered)).alias("first"))
        .withColumnRenamed(label, "__y")
    )
    by_class = sizes.agg(
        F.map_from_entries(
            F.collect_list(F.struct("__y", F.struct("n", "first")))  # one entry per class
        ).alias("m")
    )
    classes = df.withColumn("__m", by_class.scalar())
    ranked = ranked_rows(classes, slices, order, within=[label], name="__rank")
    own = F.col("__m")[F.col(label)]
    start = F.aggregate(
        F.map_values("__m"),
        F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.when(c["first"] < own["first"], c["n"]).otherwise(F.lit(0)),
    )

    def dealt(upto: Column, f: int) -> Column:
        """Positions below `upto` that belong to fold f."""
        return F.floor((upto + F.lit(n_splits - 1 - f)) / n_splits)

    position = F.col("__rank") - 1
    upper = F.lit(0).cast("bigint")
    fold = F.lit(0)
    for f in range(n_splits - 1):
        upper = upper + dealt(start + own["n"], f) - dealt(start, f)
        fold = fold + (position >= upper).cast("int")
    return ranked.withColumn(name, fold).drop("__m", "__rank")
