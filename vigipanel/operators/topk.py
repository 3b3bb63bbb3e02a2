"""Sorted results, top-k, best rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What stands before a feature's name in the column of its contributions.
PREFIX = "phi_"


def rank_by(df: DataFrame, metric: str, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(metric), *ties)


def top_features(importance: DataFrame, k: int, value: str = "importance") -> DataFrame:
    """The k largest rows; planned as a per-task top-k, not as a full sort."""
    return importance.orderBy(F.desc(value), "feature").limit(k)


def top_per_group(
    importance: DataFrame, keys: Sequence[str], k: int, value: str = "importance"
) -> DataFrame:
    """k largest rows per group, with their rank; tasks keep k per group before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), "feature")
    return importance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_by(results: DataFrame, metrics: Sequence[str], name: str = "model") -> DataFrame:
    """(metric, model, value): the best model per metric; equal values go to the first name.

    A model without the metric is no candidate; a metric nobody has gives NULLs.
    """
    best = {
        m: F.min(F.when(F.col(m).isNotNull(), F.struct((-F.col(m)).alias("v"), F.col(name).alias("n"))))
        for m in metrics
    }
    row = results.agg(*[b.alias(m) for m, b in best.items()])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.col(m)["n"].alias(name),
                        (-F.col(m)["v"]).alias("value"),
                    )
                    for m in metrics
                ]
            )
        )
    )


def waterfall(wide: DataFrame, keep: Sequence[str], k: int = 10, prefix: str = PREFIX) -> DataFrame:
    """Per row: its k strongest contributions and the sum of the rest, by value.

    `wide` holds a column per feature.  A row's contributions become an array that is sorted,
    cut and summed within the row, so nothing is shuffled and no row is multiplied by more
    than the k + 1 bars that it shows.
    """
    phi = [c for c in wide.columns if c.startswith(prefix)]
    bars = F.array_sort(
        F.array(
            *[
                F.struct(
                    F.col(c).isNull().alias("none"),
                    (-F.abs(c)).alias("strength"),
                    F.lit(c.removeprefix(prefix)).alias("feature"),
                    F.col(c).alias("phi"),
                )
                for c in phi
            ]
        )
    )
    shown = F.transform(F.slice("__bars", 1, k), lambda b: F.struct(b["phi"].alias("phi"), b["feature"].alias("feature")))
    add = lambda total, b: F.coalesce(total + b["phi"], total, b["phi"])
    rest = F.aggregate(F.slice("__bars", k + 1, max(len(phi) - k, 1)), F.lit(None).cast("double"), add)
    others = F.array(F.struct(rest.alias("phi"), F.lit("Others").alias("feature")))
    every = F.concat(shown, others) if len(phi) > k else shown
    placed = wide.select(*keep, bars.alias("__bars")).select(*keep, F.posexplode(F.array_sort(every)).alias("__at", "__bar"))
    return placed.select(
        *keep,
        F.col("__bar")["feature"].alias("feature"),
        F.col("__bar")["phi"].alias("phi"),
        (F.col("__at") + 1).alias("position"),
    )


def example_rows(
    pred: DataFrame, order: Sequence[str], y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """First true positive and first true negative by `order`.

    Without one, the first (positive) or second (negative) row overall stands in.
    """
    key = F.struct(*order)
    first_two = pred.orderBy(*order).limit(2).agg(
        F.min(key).alias("a"), F.max(key).alias("b")
    )
    hits = pred.agg(
        F.min(F.when((F.col(y) == 1) & (F.col(yhat) == 1), key)).alias("tp"),
        F.min(F.when((F.col(y) == 0) & (F.col(yhat) == 0), key)).alias("tn"),
    )
    picked = hits.select(
        F.coalesce("tp", first_two.select("a").scalar()).alias("tp"),
        F.coalesce("tn", first_two.select("b").scalar()).alias("tn"),
    )
    return picked.select(
        F.inline(
            F.array(
                F.struct(F.lit("true positive").alias("example"), F.col("tp").alias("row")),
                F.struct(F.lit("true negative").alias("example"), F.col("tn").alias("row")),
            )
        )
    ).select("example", "row.*")


def dependence(
    wide: DataFrame,
    importance: DataFrame,
    keep: Sequence[str],
    k: int = 4,
    value: str = "importance",
    prefix: str = PREFIX,
) -> DataFrame:
    """(keep, feature, phi, x): contribution and value of the k most important features.

    `wide` holds the value of a feature under its name and the contribution under the prefixed
    one, so a row gives its k pairs by itself and no two tables are joined.
    """
    top = [r["feature"] for r in top_features(importance, k, value).collect()]  # k names
    pair = lambda c: F.struct(F.lit(c).alias("feature"), F.col(prefix + c).alias("phi"), F.col(c).cast("double").alias("x"))
    if not top:
        return wide.limit(0).select(*keep, *(F.lit(None).cast(t).alias(n) for n, t in (("feature", "string"), ("phi", "double"), ("x", "double"))))
    return wide.select(*keep, F.inline(F.array(*[pair(c) for c in top])))
