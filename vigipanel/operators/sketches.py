"""Outbreak thresholds from mergeable quantile sketches: an opt-in beside the exact ones.

A sketch per group and week is small and is stored once; the threshold of any span of weeks, of
a group or of a coarser one comes from merging the sketches it covers, without the rows.  Ranks
are off by a bounded share of the rows, which `RANK_ERROR` states for the sketch size `K`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigipanel.functions.scalar import hybrid_threshold
from vigipanel.operators.labels import QUANTILES

# Size parameter of a sketch, and the rank error it has with 99 % confidence: about 2.3 / K^0.9.
K = 800
RANK_ERROR = 0.006


def sketch_values(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(keys, sketch, n): one sketch per group, for example per province, disease and week.

    Rows without a key or value are left out, as from an exact threshold.
    """
    rows = df.dropna(subset=[*keys, value])
    return rows.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """(keys, sketch, n) of coarser groups or longer spans; merging combines map-side."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantile(q: float | Column, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q) if isinstance(q, float) else q)


def sketch_thresholds(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """(keys, q1, q3, p90, threshold): the hybrid rule on the merged sketches of each group."""
    merged = merge_sketches(sketches, keys, k)
    at = {name: sketch_quantile(q) for name, q in QUANTILES.items()}
    return merged.select(*keys, "n", *[c.alias(name) for name, c in at.items()]).withColumn(
        "threshold", hybrid_threshold(F.col("q1"), F.col("q3"), F.col("p90"))
    )
