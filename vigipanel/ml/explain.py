"""Feature contributions per row, and their aggregation.

Contributions are kept wide (a column per feature) until a long form is needed, so
that importances aggregate without multiplying the rows by the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigipanel.operators.topk import PREFIX
from vigipanel.session import scratch_path, ship_package


def linear_contributions(
    df: DataFrame,
    coefficients: Mapping[str, float],
    means: Mapping[str, float],
    keep: Sequence[str],
) -> DataFrame:
    """phi = coefficient * (x - mean): exact for a linear margin."""
    return df.select(
        *keep,
        *[
            (F.lit(b) * (F.col(c) - F.lit(means[c]))).alias(PREFIX + c)
            for c, b in coefficients.items()
        ],
    )


def feature_means(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return train.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def _phi_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith(PREFIX)]


def to_long(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, feature, phi)."""
    phi = _phi_columns(wide)
    named = wide.select(*keep, *[F.col(c).alias(c.removeprefix(PREFIX)) for c in phi])
    return named.unpivot(list(keep), [c.removeprefix(PREFIX) for c in phi], "feature", "phi")


def to_wide(long: DataFrame, rows: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Row x feature matrix from the long form."""
    return long.groupBy(*rows).pivot("feature", list(features)).agg(F.sum("phi"))


def _mean_abs(wide: DataFrame, phi: Sequence[str]) -> dict[str, Column]:
    return {c.removeprefix(PREFIX): F.avg(F.abs(c)) for c in phi}


def global_importance(wide: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute contribution."""
    means = _mean_abs(wide, _phi_columns(wide))
    row = wide.agg(*[m.alias(n) for n, m in means.items()])
    return row.unpivot([], list(means), "feature", "importance")


def group_importance(
    wide: DataFrame, key: str = "maladie", exclude: Sequence[str] = ("maladie",)
) -> DataFrame:
    """(key, feature, importance): mean absolute contribution per group."""
    phi = [c for c in _phi_columns(wide) if c.removeprefix(PREFIX) not in exclude]
    means = _mean_abs(wide, phi)
    rows = wide.groupBy(key).agg(*[m.alias(n) for n, m in means.items()])
    return rows.unpivot([key], list(means), "feature", "importance")


@dataclass(frozen=True)
class Leaf:
    """One leaf of the ensemble.

    `value` is already multiplied by the weight of its tree.  Per distinct feature on the
    path to the leaf: the interval (low, high] a row must fall in, and the share of
    training rows that take the branches of that feature.
    """

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def ensemble_nodes(model: GBTClassificationModel, spark) -> DataFrame:
    """(tree, node, prediction, cover, left, right, feature, threshold) of a grown model, or of
    one of the library from its saved form."""
    if not isinstance(model, GBTClassificationModel):
        nodes = "tree int, node int, prediction double, cover double, left int, right int, feature int, threshold double"
        return spark.createDataFrame(model.nodes(), nodes)
    path = scratch_path(spark, "gbt")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = "nodeData"
    return saved.select(
        F.col("treeID").alias("tree"),
        F.col(f"{node}.id").alias("node"),
        F.col(f"{node}.prediction").alias("prediction"),
        F.col(f"{node}.rawCount").cast("double").alias("cover"),
        F.col(f"{node}.leftChild").alias("left"),
        F.col(f"{node}.rightChild").alias("right"),
        F.col(f"{node}.split.featureIndex").alias("feature"),
        F.get(f"{node}.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def _leaves(nodes: pd.DataFrame, weight: float) -> Iterator[Leaf]:
    """Walk one tree from the root, narrowing the interval of each feature on the way."""
    by_id = {row.node: row for row in nodes.itertuples()}
    todo = [(0, {})]
    while todo:
        node_id, path = todo.pop()
        row = by_id[node_id]
        if row.left < 0:
            names = tuple(path)
            low, high, share = zip(*path.values(), strict=True) if path else ((), (), ())
            yield Leaf(weight * row.prediction, names, low, high, share)
            continue
        low, high, share = path.get(row.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in (
            (row.left, (low, min(high, row.threshold))),
            (row.right, (max(low, row.threshold), high)),
        ):
            part = by_id[child].cover / row.cover if row.cover else 0.0
            todo.append((child, path | {row.feature: (*bounds, share * part)}))


def _leaf_phi(x: np.ndarray, leaf: Leaf, out: np.ndarray, table: np.ndarray | None = None) -> None:
    """Add the Shapley values of one leaf for a batch of rows.

    They depend only on which of its features hold, so a table of all cases is looked up.
    A leaf pays `value * prod(inside_j or share_j)` over a coalition's known and unknown
    features.  `weights[:, s]` collects that product over the coalitions of size s among
    the other features, as coefficients of prod(share_j + inside_j * t).
    """
    own = x[:, leaf.features]
    # A missing value goes right at every split: it is above any bound and below none.
    inside = ~(own <= leaf.low) & ((own <= leaf.high) | np.isposinf(leaf.high))
    table = _leaf_table(leaf) if table is None else table
    out[:, leaf.features] += table[inside @ (1 << np.arange(len(leaf.features)))]


def _leaf_table(leaf: Leaf) -> np.ndarray:
    """The Shapley values of one leaf for every set of its features whose bounds hold."""
    m = len(leaf.features)
    inside = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    sizes = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    table = np.zeros((1 << m, m))
    for i in range(m):
        weights = np.zeros((1 << m, m))
        weights[:, 0] = 1.0
        for j in range(m):
            if j != i:
                known = weights[:, :-1] * inside[:, [j]]
                weights *= leaf.share[j]
                weights[:, 1:] += known
        table[:, i] = leaf.value * (inside[:, i] - leaf.share[i]) * (weights @ sizes)
    return table


def tree_contributions(
    model: GBTClassificationModel,
    df: DataFrame,
    features: Sequence[str],
    keep: Sequence[str],
) -> tuple[DataFrame, float]:
    """(wide contributions to the log-odds, base value) of a boosted-tree model.

    The leaves (trees x 2**depth, a size of the model, not of the data) go to the tasks
    with the closure; rows are scored in Arrow batches where they lie.
    """
    ship_package(df.sparkSession)
    nodes = ensemble_nodes(model, df.sparkSession).toPandas()
    log_odds = [2.0 * w for w in model.treeWeights]
    leaves = [
        leaf
        for tree, rows in nodes.groupby("tree")
        for leaf in _leaves(rows, log_odds[int(tree)])
    ]
    base = float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))
    keep, features = list(keep), list(features)
    split_leaves = [leaf for leaf in leaves if leaf.features]
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField(PREFIX + c, T.DoubleType()) for c in features]
    )

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [_leaf_table(leaf) for leaf in split_leaves]
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            phi = np.zeros_like(x)
            for leaf, table in zip(split_leaves, tables):
                _leaf_phi(x, leaf, phi, table)
            made = pd.DataFrame(phi, columns=[PREFIX + c for c in features], index=batch.index)
            yield pd.concat([batch[keep], made], axis=1)

    return df.select(*dict.fromkeys([*keep, *features])).mapInPandas(explain, schema), base
