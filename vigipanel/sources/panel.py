"""Reading and writing panels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StructField, StructType

from vigipanel.functions.scalar import nan_to_null
from vigipanel.schema import HEALTH_SCHEMA, ROW_KEY


def read_panel(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = HEALTH_SCHEMA
) -> DataFrame:
    """A panel from CSV with a header, or from Parquet, with a declared schema.

    NaN becomes NULL here, once, so that no later step meets two kinds of missing.  Writers
    put counts with gaps as `12.0`; they are read as numbers and cast, and a value that is
    no whole number, or no number at all, fails the read.
    """
    if fmt == "csv":
        whole = {f.name: f.dataType for f in schema if isinstance(f.dataType, IntegralType)}
        loose = StructType(
            [StructField(f.name, DoubleType() if f.name in whole else f.dataType) for f in schema]
        )
        df = spark.read.schema(loose).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
        df = df.withColumns({c: whole_number(c).cast(kind) for c, kind in whole.items()})
    else:
        df = spark.read.format(fmt).load(path)
    doubles = [f.name for f in df.schema if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: nan_to_null(c) for c in doubles})


def whole_number(column: str) -> Column:
    """A double that holds a count; NaN is NULL, a fraction is an error."""
    value = nan_to_null(column)
    wrong = F.raise_error(F.concat(F.lit(f"{column} holds a fraction: "), value.cast("string")))
    return F.when(value.isNull() | (value == F.floor(value)), value).otherwise(wrong)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    tasks_per_value: int = 1,
) -> None:
    """One file per task, never gathered into one; partition features by year to prune.

    Rows of one partition value go to `tasks_per_value` tasks, so that files do not multiply
    with the tasks that hold the rows; give a large value more of them.
    """
    if partition_by:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(tasks_per_value))
        df = df.repartition(*partition_by, salt)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet"
) -> DataFrame:
    """The prebuilt table if there is one; otherwise build it, store it and read it back."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    write_table(build(), path, fmt)
    return spark.read.format(fmt).load(path)


def load_required(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"{path} not found: build the feature table first") from error


def duplicates(df: DataFrame, keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """Keys with more than one row.  Must be empty for a panel."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_weekly(df: DataFrame, keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """The panel itself, after checking what `weekly_groups` relies on: unique keys."""
    found = duplicates(df.dropna(subset=list(keys)), keys).limit(1).collect()
    if found:
        raise ValueError(f"several rows for one key, for example {found[0].asDict()}")
    return df


def with_row_id(df: DataFrame, keys: Sequence[str] = ROW_KEY, name: str = "row_id") -> DataFrame:
    """A hint of a row's identity that does not depend on partitioning or on a rerun.

    The key columns are the identity; 64 bits of them may collide among billions of rows.
    """
    return df.withColumn(name, F.xxhash64(*keys))
