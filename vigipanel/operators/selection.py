"""Feature selection on the training rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.operators.encode import impute_median
from vigipanel.operators.wide import joint_counts, wide_quantiles
from vigipanel.session import materialise

def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, variance): sample variances of all columns from one pass."""
    wide = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "variance")


def drop_low_variance(df: DataFrame, columns: Sequence[str], eps: float = 1e-6) -> list[str]:
    kept = {r["feature"] for r in variances(df, columns).where(F.col("variance") > eps).collect()}
    return [c for c in columns if c in kept]


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, a, b, r) for i < j: Pearson over the rows where both are present.

    d columns have d(d-1)/2 pairs, too many for one aggregation of `corr` columns and
    many scans if cut into several.  Instead each task turns its rows into d x d moment
    matrices and emits one row per pair, so one scan and a shuffle of d(d-1)/2 rows per
    task give all pairs.  The columns are centred first, which keeps the moments stable.
    """
    columns = list(columns)
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    means = doubles.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    centre = np.array([means[c] or 0.0 for c in columns])
    upper = np.triu_indices(len(columns), k=1)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float) - centre
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sums, squares = x.T @ here, (x * x).T @ here
            total += np.stack([here.T @ here, sums, sums.T, squares, squares.T, x.T @ x])
        made = pd.DataFrame(total[:, *upper].T, columns=["n", "sx", "sy", "sxx", "syy", "sxy"])
        yield made.assign(i=upper[0], j=upper[1])

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    schema = ", ".join(f"{s} double" for s in sums) + ", i int, j int"
    pairs = doubles.mapInPandas(moments, schema).groupBy("i", "j").agg(
        *[F.sum(s).alias(s) for s in sums]
    )
    n, sx, sy, sxx, syy, sxy = (F.col(s) for s in sums)
    # Rounding may leave a constant column a hair below zero.
    spread_x, spread_y = (F.greatest(n * q - s * s, F.lit(0.0)) for q, s in ((sxx, sx), (syy, sy)))
    spread = F.sqrt(spread_x) * F.sqrt(spread_y)
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.select(
        "i",
        "j",
        F.get(names, "i").alias("a"),
        F.get(names, "j").alias("b"),
        F.try_divide(n * sxy - sx * sy, spread).alias("r"),
    )


def correlated_columns(pairs: DataFrame, limit: float) -> DataFrame:
    """(feature): columns that correlate with any earlier one beyond the limit."""
    return (
        pairs.where(F.abs("r") > limit).select(F.col("b").alias("feature")).distinct()
    )


def drop_correlated(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    gone = {r["feature"] for r in correlated_columns(correlations(df, columns), limit).collect()}
    return [c for c in columns if c not in gone]


def mutual_information(
    df: DataFrame, columns: Sequence[str], label: str, bins: int = 10
) -> DataFrame:
    """(feature, mi) in nats, over equal-frequency bins of each feature.

    The bin edges are exact quantiles.  Rows are counted per bin and class as they are read,
    for all columns at once; what follows runs on the joint counts, at most bins x classes
    rows per feature.
    """
    probs = {f"c{i}": i / bins for i in range(1, bins)}
    edges = wide_quantiles(df, columns, probs).collect()  # a row per column
    joint = joint_counts(df, columns, label, {r["feature"]: [r[p] for p in probs] for r in edges})
    total, by_bin, by_class = (
        F.sum("n").over(Window.partitionBy("feature", *k)) for k in ([], ["bin"], ["label"])
    )
    term = F.col("n") / total * F.ln(F.col("n") * total / (by_bin * by_class))
    return (
        joint.withColumn("term", term).groupBy("feature").agg(F.sum("term").alias("mi"))
    )


def select_top_mi(mi: DataFrame, k: int = 40) -> DataFrame:
    """The k most informative features, or all with positive information if fewer."""
    return mi.where("mi > 0").orderBy(F.desc("mi"), "feature").limit(k)


def select_features(
    train: DataFrame,
    columns: Sequence[str],
    label: str,
    *,
    eps: float = 1e-6,
    limit: float = 0.95,
    k: int = 40,
    bins: int = 10,
) -> list[str]:
    """Variance filter, correlation filter, then the top of the information ranking."""
    train = materialise(train.select(label, *columns))
    kept = drop_correlated(train, drop_low_variance(train, columns, eps), limit)
    (filled,) = impute_median(train, [train], kept)
    ranked = select_top_mi(mutual_information(filled, kept, label, bins), k)
    return [r["feature"] for r in ranked.collect()]
