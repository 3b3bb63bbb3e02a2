"""Boosted trees scored after several numbers of trees at once.

A boosted model is grown one tree after another, so the first trees of a long model are the
model that a shorter fit with the same seed would give.  A search over the number of trees
therefore fits the longest only, and one pass over the rows scores every stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigipanel.ml.explain import ensemble_nodes
from vigipanel.session import ship_package

STAGES = "stages"


@dataclass(frozen=True)
class Tree:
    """The nodes of one tree by number; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @classmethod
    def of(cls, nodes: pd.DataFrame, weight: float) -> Tree:
        n = int(nodes.node.max()) + 1
        at = nodes.node.to_numpy()
        filled = lambda column, empty, kind: (lambda out: (out.__setitem__(at, column), out)[1])(np.full(n, empty, kind))
        inner = (nodes.left >= 0).to_numpy()
        left = filled(np.where(inner, nodes.left, at), 0, int)
        right = filled(np.where(inner, nodes.right, at), 0, int)
        level, depth = {0}, 0
        while grown := {int(c) for i in level if left[i] != i for c in (left[i], right[i])}:
            level, depth = grown, depth + 1
        return cls(
            filled(np.where(inner, nodes.feature, 0), 0, int),
            filled(np.where(inner, nodes.threshold, 0.0).astype(float), 0.0, float),
            left, right, filled(weight * nodes.prediction, 0.0, float), depth,
        )

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A missing value goes right, as in the library."""
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at]


def trees_of(model: GBTClassificationModel, spark) -> list[Tree]:
    """The trees in order; their size is that of the model, not of the data."""
    nodes = ensemble_nodes(model, spark).toPandas()
    weights = model.treeWeights
    return [Tree.of(own, weights[int(tree)]) for tree, own in nodes.groupby("tree", sort=True)]


def staged_scores(
    model: GBTClassificationModel, df: DataFrame, features: str, stages: Sequence[int], keep: Sequence[str]
) -> DataFrame:
    """`keep` and `stages`: the probability of the positive class after each number of trees.

    `features` is the vector column of the fit.  The trees go to the tasks with the closure.
    """
    return staged_rows(trees_of(model, df.sparkSession), df, features, stages, keep)


def staged_rows(trees: Sequence[Tree], df: DataFrame, features: str, stages: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """The same from the trees themselves."""
    ship_package(df.sparkSession)
    trees, stages, keep = list(trees), list(stages), list(keep)
    if max(stages) > len(trees):
        raise ValueError(f"the model has {len(trees)} trees, not {max(stages)}")
    rows = df.select(*keep, vector_to_array(features).alias("__x"))
    schema = rows.drop("__x").schema.add(STAGES, T.ArrayType(T.DoubleType()))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["__x"].to_numpy()) if len(batch) else np.zeros((0, 1))
            margin, out = np.zeros(len(batch)), np.zeros((len(batch), len(stages)))
            for i, tree in enumerate(trees[: max(stages)], 1):
                margin += tree.predict(x)
                for s in [s for s, n in enumerate(stages) if n == i]:
                    out[:, s] = 1 / (1 + np.exp(-2 * margin))
            yield batch[keep].assign(**{STAGES: list(out)})

    return rows.mapInPandas(work, schema)


def log_loss(p, y: str, weight=None):
    """Mean weighted log loss of a probability column, as an aggregate."""
    weight = F.lit(1.0) if weight is None else weight
    inside = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    lost = -F.when(F.col(y) == 1, F.ln(inside)).otherwise(F.ln(1 - inside))
    return F.sum(weight * lost) / F.sum(weight)
