"""Encoding, scaling and imputation.  Fit on one frame, apply to any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.operators.ranks import sorted_positions
from vigipanel.operators.wide import wide_quantiles
from vigipanel.session import BROADCAST_ROWS, materialise, small_side

# A one-hot level becomes a column, so their number is a schema size; more levels fit a vector.
MAX_LEVELS = 5_000


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based position among the sorted distinct values."""
    distinct = df.select(F.col(column).alias("value")).dropna().distinct()
    codes = sorted_positions(distinct, ["value"], "code")
    return codes.withColumn("code", F.col("code").cast("int"))


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code) of columns of one type: their sorted distinct values, numbered.

    The source is read once for all columns: one distinct of (feature, value) with partial
    results per task, one range sort of what is left, and one stored table of codes.
    """
    entry = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
    pairs = df.select(F.inline(F.array(*map(entry, columns)))).where("value is not null").distinct()
    placed = sorted_positions(pairs, ["feature", "value"])
    first = placed.groupBy("feature").agg(F.min("position").alias("first"))  # a row per column
    coded = placed.join(F.broadcast(first), "feature")
    return materialise(coded.select("feature", "value", (F.col("position") - F.col("first")).cast("int").alias("code")))


def dictionaries(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[DataFrame, int]]:
    """{column: (table of value and code, its size)}; columns of a type share one dictionary."""
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    made = {}
    for own in by_type.values():
        codes = dictionary(df, own)
        sizes = {r["feature"]: r["count"] for r in codes.groupBy("feature").count().collect()}  # a row per column
        made |= {c: (codes.where(F.col("feature") == c).select("value", "code"), sizes.get(c, 0)) for c in own}
    return made


def _joined(df: DataFrame, column: str, codes: DataFrame, size: int, name: str) -> DataFrame:
    table = codes.withColumnsRenamed({"value": column, "code": name})
    return df.join(F.broadcast(table) if size <= BROADCAST_ROWS else table, column, "left")


def ordinal_encode(
    df: DataFrame, columns: Sequence[str], suffix: str = "_code", fit_on: DataFrame | None = None
) -> DataFrame:
    """A code column per column; a missing value, or one not met in fitting, has no code."""
    for c, (codes, size) in dictionaries(fit_on if fit_on is not None else df, columns).items():
        df = _joined(df, c, codes, size, c + suffix)
    return df


def decode(df: DataFrame, codes: DataFrame, code: str, name: str) -> DataFrame:
    """Codes back to values, through the table of `ordinal_codes`."""
    table = codes.withColumnsRenamed({"code": code, "value": name})
    return df.join(small_side(table), code, "left")


def levels(df: DataFrame, column: str, most: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct values, for use as column names."""
    rows = df.select(column).dropna().distinct().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has over {most} values: use one_hot_vector, or allow more")
    return [r[0] for r in rows]


def one_hot_vector(
    df: DataFrame, columns: Sequence[str], name: str = "{col}_vector", fit_on: DataFrame | None = None
) -> DataFrame:
    """A sparse 0/1 vector per column, for any number of levels.

    A missing value or a level not seen in fitting is all zeros.
    """
    coded = df
    for c, (codes, size) in dictionaries(fit_on if fit_on is not None else df, columns).items():
        coded = _joined(coded, c, codes, size, c + "__code")
        # One position beyond the known ones, which the encoder drops, stands for the others.
        code = F.coalesce(F.col(c + "__code"), F.lit(size)).cast("double")
        encoder = OneHotEncoder(inputCol=c + "__code", outputCol=name.format(col=c), dropLast=True)
        sizes = df.sparkSession.range(size + 1).select(F.col("id").cast("double").alias(c + "__code"))
        coded = encoder.fit(sizes).transform(coded.withColumn(c + "__code", code)).drop(c + "__code")
    return coded


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    known: Mapping[str, Sequence[str]] | None = None,
    most: int = MAX_LEVELS,
) -> DataFrame:
    """A 0/1 column `<column>_<level>` per level but the first; the column itself goes."""
    made = {}
    for c in columns:
        for level in (known[c] if known else levels(df, c, most))[1:]:
            made[f"{c}_{level}"] = F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
    return df.withColumns(made).drop(*columns)


def scaling_stats(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population standard deviation)} from one pass."""
    aggs = [f(c).alias(f"{n}:{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = train.agg(*aggs).first()
    return {c: (row[f"m:{c}"], row[f"s:{c}"]) for c in columns}


def scale(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std; a constant column is only centred."""
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0)
            for c, (mean, std) in stats.items()
            if mean is not None
        }
    )


def standardise(train: DataFrame, frames: Sequence[DataFrame], columns: Sequence[str]):
    stats = scaling_stats(train, columns)
    return [scale(df, stats) for df in frames]


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median): exact, without gathering a column or multiplying the rows."""
    return wide_quantiles(df, columns, {"median": 0.5})


def impute_median(train: DataFrame, frames: Sequence[DataFrame], columns: Sequence[str]):
    """Fill missing values with the medians of the training rows."""
    fill = {r["feature"]: r["median"] for r in medians(train, columns).collect()}
    return [
        df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})
        for df in frames
    ]
