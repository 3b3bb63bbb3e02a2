"""Boosted trees of many fits, grown together.

A fit of its own takes a few Spark jobs a tree, whose latency outlasts their work, and a search has
dozens of fits.  Here one job serves a level of all fits: tasks sum their blocks of rows into
histograms per fit and node, histograms of a node are added up, and its best split goes to the
driver.  Training sets of a block each, at most BLOCK_ROWS rows, have nothing to add up between
tasks: a task then grows the trees of its fits level by level with the same functions, and fits run
beside each other in one job.  Loss, candidate splits and stopping rules are those of
`GBTClassifier`, which the tests hold against it; the subsample of a tree is a draw of its own.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush
from math import ceil
from typing import Any

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigipanel.ml.staged import Tree
from vigipanel.session import materialise, shared_folder, ship_package

# Bins of a column and rows that its candidate splits are taken from, as in the library.
BINS, SPLIT_ROWS = 32, 10_000
# Trees between two cuts of the lineage.
CUT_EVERY = 10
# Rows of a block, and blocks of a task on tables of many blocks.
BLOCK_ROWS, BLOCKS_PER_TASK = 10_000, 16

DEFAULTS = {
    "maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "minInstancesPerNode": 1,
    "featureSubsetStrategy": "all",
}


@dataclass(frozen=True)
class Plan:
    """One fit: the number of its training set and its settings, in the names of the library."""

    rows: int
    params: Mapping[str, Any]
    seed: int = 42

    def __post_init__(self) -> None:
        if unknown := set(self.params) - set(DEFAULTS):
            raise ValueError(f"settings that trees are not grown by: {sorted(unknown)}")

    def __getitem__(self, name: str) -> Any:
        return self.params.get(name, DEFAULTS[name])

    def subset(self, tree: int, node: int, d: int) -> np.ndarray | None:
        """The columns that a node may be split on; None: all."""
        share = self["featureSubsetStrategy"]
        if share in ("all", "auto"):
            return None
        drawn = np.random.default_rng([self.seed, tree, node])
        return drawn.permutation(d)[: ceil(float(share) * d)]


class Growing:
    """A tree in heap order, the root at 1; `feature` is -1 where a node is not split."""

    def __init__(self, depth: int) -> None:
        size = 2 ** (depth + 1)
        self.feature, self.bin = np.full(size, -1), np.zeros(size, int)
        self.value, self.cover = np.zeros(size), np.zeros(size)
        self.depth, self.open = depth, [1]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.ones(len(bins), int), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            if (f < 0).all():
                break
            at = np.where(f < 0, at, 2 * at + (bins[rows, f] > self.bin[at]))
        return at

    def split(self, found: Mapping[int, tuple], gained: np.ndarray, depth: int) -> None:
        """Split the open nodes as found; their children are open if the tree may be deeper."""
        self.open = []
        for node, (mean, cover, split) in sorted(found.items()):
            self.value[node], self.cover[node] = mean, cover
            if split is None:
                continue
            self.feature[node], self.bin[node], gain, *children = split
            for child, own in zip((2 * node, 2 * node + 1), children, strict=True):
                self.value[child], self.cover[child] = own
            gained[split[0]] += gain
            if depth + 1 < self.depth:
                self.open += [2 * node, 2 * node + 1]

    def finished(self, points: Sequence[np.ndarray], weight: float) -> Tree:
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        threshold = [points[f][b] if f >= 0 else 0.0 for f, b in zip(self.feature, self.bin, strict=True)]
        left, right = np.where(inner, 2 * own, own), np.where(inner, 2 * own + 1, own)
        made = np.where(inner, self.feature, 0), np.array(threshold, float), left, right, weight * self.value
        for part in (*made, self.cover):
            part[0] = part[1]  # rows start at 0
        return Tree(*made, self.depth)


@dataclass
class Block:
    """Rows of a training set: bins per column, label as -1 and 1, weight, a margin per fit."""

    name: tuple[int, int, int]
    fits: list[int]
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margins: np.ndarray


@dataclass
class GrownModel:
    """A boosted model with what the callers use of the library's."""

    trees: list[Tree]  # values times the weight of the tree
    treeWeights: list[float]  # noqa: N815
    covers: list[np.ndarray] = field(repr=False)  # training rows per node of a tree
    gains: np.ndarray = field(repr=False)  # tree x column

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        total = self.gains.sum(axis=0)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def nodes(self) -> pd.DataFrame:
        """The columns of `explain.ensemble_nodes`, the root at 0."""
        found = []
        for number, (t, weight, cover) in enumerate(zip(self.trees, self.treeWeights, self.covers, strict=True)):
            todo = [0]
            while todo:
                i = todo.pop()
                left, right = int(t.left[i]), int(t.right[i])
                leaf = left == i or left == right
                if not leaf:
                    todo += [left, right]
                split = (-1, -1, -1, None) if leaf else (left, right, int(t.feature[i]), float(t.threshold[i]))
                found.append((number, i, float(t.value[i]) / weight, float(cover[i]), *split))
        return pd.DataFrame(found, columns=["tree", "node", "prediction", "cover", "left", "right", "feature", "threshold"])

    def transform(self, df: DataFrame, features: str = "__features") -> DataFrame:
        ship_package(df.sparkSession)
        trees = self.trees

        @F.pandas_udf(T.DoubleType())
        def margin(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            return pd.Series(sum((t.predict(rows) for t in trees), np.zeros(len(rows))))

        scored = df.withColumn("__margin", margin(vector_to_array(features)))
        p = 1 / (1 + F.exp(-2 * F.col("__margin")))
        return scored.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))),
            "probability": array_to_vector(F.array(1 - p, p)),
        }).drop("__margin")


# ---- candidate splits ----------------------------------------------------------------------


def split_points(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Where a column may be cut: between all of its values or, if they are many, at about equal weights."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between
    stride = float(weights.sum() / (most + 1))
    upto, target, chosen = np.cumsum(weights).tolist(), stride, []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            chosen.append(i - 1)
            target += stride
    return between[chosen]


def candidates(trains: Mapping[int, DataFrame], counts: Mapping[int, int], features: str, seed: int) -> dict[int, list[np.ndarray]]:
    """The split points of every column of every training set, from at most about SPLIT_ROWS rows
    of each; a group is a column of a set, and one job serves all."""

    def entries(number: int, train: DataFrame) -> DataFrame:
        n = counts[number]
        sample = train if n <= SPLIT_ROWS else train.sample(SPLIT_ROWS / n, seed=seed)
        return sample.select(F.lit(number).alias("rows"), "__w", F.posexplode(vector_to_array(features)).alias("j", "x"))

    most = {number: min(BINS, n) - 1 for number, n in counts.items()}

    def points(own: pd.DataFrame) -> pd.DataFrame:
        number = int(own.rows.iloc[0])
        made = split_points(own.x.to_numpy(), own.n.to_numpy(), most[number])
        return pd.DataFrame({"rows": [number], "j": [int(own.j.iloc[0])], "points": [made]})

    long = functools.reduce(DataFrame.unionAll, (entries(*item) for item in trains.items()))
    counted = long.groupBy("rows", "j", "x").agg(F.sum("__w").alias("n"))
    # Small as they are, the columns are dealt to all cores; adaptive execution would leave them in one task.
    dealt = counted.repartition(long.sparkSession.sparkContext.defaultParallelism, "rows", "j")
    found = dealt.groupBy("rows", "j").applyInPandas(points, "rows int, j int, points array<double>").collect()
    own = {number: sorted((r for r in found if r.rows == number), key=lambda r: r.j) for number in trains}
    return {number: [np.array(r.points, float) for r in rows] for number, rows in own.items()}


# ---- blocks --------------------------------------------------------------------------------


def binned(train: DataFrame, number: int, features: str, label: str, points: list[np.ndarray]) -> DataFrame:
    """(rows, part, seq, n, block): the rows of a training set by bins, in blocks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in (b[i : i + BLOCK_ROWS] for b in batches for i in range(0, len(b), BLOCK_ROWS)):
            x = np.stack(batch["__x"].to_numpy())
            bins = np.stack([np.searchsorted(p, x[:, j]) for j, p in enumerate(points)], axis=1).astype(np.uint8)
            packed = pickle.dumps((bins, 2.0 * batch["__y"].to_numpy() - 1, batch["__w"].to_numpy()))
            yield pd.DataFrame({"rows": [number], "part": [part], "seq": [seq], "n": [len(batch)], "block": [packed]})
            seq += 1

    rows = train.select(vector_to_array(features).alias("__x"), F.col(label).cast("double").alias("__y"), "__w")
    return rows.mapInPandas(work, "rows int, part int, seq int, n int, block binary")


def dealt(stored: DataFrame, plans: Sequence[Plan], parallelism: int) -> tuple[RDD, bool]:
    """(blocks with a margin per fit, whether every fit has one block only).

    Few blocks are given out once per fit, so that fits run beside each other; many carry all fits
    of their training set.  They are dealt to the tasks by their work.
    """
    members = {r: [i for i, p in enumerate(plans) if p.rows == r] for r in {p.rows for p in plans}}
    sizes = {(r.rows, r.part, r.seq): r.n for r in stored.select("rows", "part", "seq", "n").collect()}
    alone = len(sizes) == len(members)
    apart = alone or len(sizes) <= parallelism
    groups = {r: [[i] for i in m] if apart else [m] for r, m in members.items()}
    work = {(name, g): n * len(own) for name, n in sizes.items() for g, own in enumerate(groups[name[0]])}
    tasks = min(len(work), max(parallelism, ceil(len(work) / BLOCKS_PER_TASK)))
    load, place = [(0, t) for t in range(tasks)], {}
    for key in sorted(work, key=work.get, reverse=True):
        least = heappop(load)
        place[key] = least[1]
        heappush(load, (least[0] + work[key], least[1]))

    def unpack(row: Any) -> Iterator[tuple[Any, Block]]:
        name = (row.rows, row.part, row.seq)
        bins, y, w = pickle.loads(bytes(row.block))
        for g, own in enumerate(groups[row.rows]):
            yield (name, g), Block(name, own, bins, y, w, np.zeros((len(own), len(y))))

    blocks = stored.rdd.flatMap(unpack).partitionBy(tasks, place.__getitem__).values()
    return blocks, alone


# ---- growing -------------------------------------------------------------------------------


def in_bag(block: Block, plan: Plan, tree: int) -> np.ndarray:
    if plan["subsamplingRate"] >= 1:
        return np.ones(len(block.y), bool)
    return np.random.default_rng([plan.seed, tree, *block.name]).random(len(block.y)) < plan["subsamplingRate"]


def histograms(block: Block, plans: Sequence[Plan], tree: int, grown: Mapping[int, Growing]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((fit, node), sums of weight, weighted residual and rows per column and bin) of open nodes."""
    d = block.bins.shape[1]
    codes = block.bins + BINS * np.arange(d)
    for own, i in enumerate(block.fits):
        if i not in grown or not grown[i].open:
            continue
        at = grown[i].nodes(block.bins)
        slots = np.full(len(grown[i].feature), -1)
        slots[grown[i].open] = np.arange(len(grown[i].open))
        kept = np.flatnonzero((slots[at] >= 0) & in_bag(block, plans[i], tree))
        if not len(kept):
            continue
        y, w = block.y[kept], block.w[kept]
        # The first tree is fitted to the labels, the others to the gradient of the loss.
        residual = y if tree == 0 else 4 * y / (1 + np.exp(2 * y * block.margins[own, kept]))
        index = (codes[kept] + (d * BINS * slots[at[kept]])[:, None]).ravel()
        size = d * BINS * len(grown[i].open)
        sums = [np.bincount(index, None if v is None else np.repeat(v, d), size) for v in (w, w * residual, None)]
        for node, part in zip(grown[i].open, np.stack(sums).reshape(3, -1, d, BINS).swapaxes(0, 1), strict=True):
            if part[2].any():
                yield (i, node), part


def best_split(sums: np.ndarray, plan: Plan, tree: int, node: int) -> tuple:
    """(mean, rows, split): the split is (column, bin, gain, left, right), the last two as (mean,
    rows), and None for a leaf."""
    left = sums.cumsum(axis=2)
    whole = left[:, 0, -1]
    left = left[:, :, :-1]
    right = whole[:, None, None] - left
    own, least = (whole[1] / whole[0], whole[2]), max(plan["minInstancesPerNode"], 1)
    allowed = (left[2] >= least) & (right[2] >= least)
    columns = plan.subset(tree, node, sums.shape[1])
    if columns is not None:
        allowed &= np.isin(np.arange(sums.shape[1]), columns)[:, None]
    if not allowed.any():
        return *own, None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    # Below this a gain is the rounding of a node of equal residuals.
    if not gain[f, b] > 1e-12 * whole[1] ** 2 / whole[0]:
        return *own, None
    children = [(side[1, f, b] / side[0, f, b], side[2, f, b]) for side in (left, right)]
    return *own, (int(f), int(b), float(gain[f, b]), *children)


def level(blocks: RDD, plans: Sequence[Plan], tree: int, grown: Mapping[int, Growing]) -> list:
    """((fit, node), best split) of all open nodes: one job."""

    def summed(own: Iterator[Block]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for block in own:
            for key, part in histograms(block, plans, tree, grown):
                total[key] = total[key] + part if key in total else part
        return iter(total.items())

    def chosen(pair: tuple[tuple[int, int], np.ndarray]) -> tuple[tuple[int, int], tuple]:
        (i, node), sums = pair
        return pair[0], best_split(sums, plans[i], tree, node)

    return blocks.mapPartitions(summed).reduceByKey(np.add).map(chosen).collect()


def advanced(plans: Sequence[Plan], grown: Mapping[int, Growing], tree: int) -> Callable[[Block], Block]:
    """Margins with the tree that was grown last; the first one counts whole."""
    weights = {i: 1.0 if tree == 0 else plans[i]["stepSize"] for i in grown}

    def step(block: Block) -> Block:
        margins = block.margins.copy()
        for own, i in enumerate(block.fits):
            if i in grown:
                margins[own] += weights[i] * grown[i].value[grown[i].nodes(block.bins)]
        return Block(block.name, block.fits, block.bins, block.y, block.w, margins)

    return step


def grow(
    trains: Mapping[int, DataFrame], weights: Mapping[int, Column | None], plans: Sequence[Plan],
    label: str, features: str = "__features",
) -> list[GrownModel]:
    """A model per plan; `trains` are the training sets by number, `weights` their weight columns."""
    spark = next(iter(trains.values())).sparkSession
    ship_package(spark)
    shared_folder(spark)
    marked = {}
    for number, train in trains.items():
        weight = weights.get(number)
        marked[number] = train.withColumn("__w", (F.lit(1.0) if weight is None else weight).cast("double"))
    points = candidates(marked, {number: rows.count() for number, rows in marked.items()}, features, plans[0].seed)
    parts = (binned(rows, number, features, label, points[number]) for number, rows in marked.items())
    stored = functools.reduce(DataFrame.unionAll, parts)
    state, alone = dealt(materialise(stored), plans, spark.sparkContext.defaultParallelism)
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    made = grown_alone(state, plans) if alone else grown_by_level(spark, state, plans, len(points[plans[0].rows]))
    state.unpersist()
    models = []
    for plan, (trees, gains) in zip(plans, made, strict=True):
        weights = [1.0] + [plan["stepSize"]] * (len(trees) - 1)
        done = [g.finished(points[plan.rows], w) for g, w in zip(trees, weights, strict=True)]
        models.append(GrownModel(done, weights, [g.cover for g in trees], np.array(gains)))
    return models


def grown_alone(blocks: RDD, plans: Sequence[Plan]) -> list[tuple[list[Growing], list[np.ndarray]]]:
    """(trees, gains per tree and column) of fits whose rows lie in one block each: one job."""

    def whole(block: Block) -> Iterator[tuple[int, tuple[list[Growing], list[np.ndarray]]]]:
        for own, i in enumerate(block.fits):
            one = Block(block.name, [i], block.bins, block.y, block.w, block.margins[own : own + 1])
            trees, gains = [], []
            for tree in range(plans[i]["maxIter"]):
                g, gained = Growing(plans[i]["maxDepth"]), np.zeros(block.bins.shape[1])
                for depth in range(g.depth):
                    sums = histograms(one, plans, tree, {i: g})
                    g.split({node: best_split(part, plans[i], tree, node) for (_, node), part in sums}, gained, depth)
                    if not g.open:
                        break
                one = advanced(plans, {i: g}, tree)(one)
                trees.append(g)
                gains.append(gained)
            yield i, (trees, gains)

    found = dict(blocks.flatMap(whole).collect())
    return [found[i] for i in range(len(plans))]


def grown_by_level(spark: SparkSession, state: RDD, plans: Sequence[Plan], d: int) -> list[tuple[list[Growing], list[np.ndarray]]]:
    """The same over any number of blocks: a job per level of all fits."""
    made: list[tuple[list[Growing], list[np.ndarray]]] = [([], []) for _ in plans]
    behind: list[RDD] = []  # states that the current one may still be computed from
    cut = None
    for tree in range(max(p["maxIter"] for p in plans)):
        grown = {i: Growing(p["maxDepth"]) for i, p in enumerate(plans) if tree < p["maxIter"]}
        gained = {i: np.zeros(d) for i in grown}
        for depth in range(max(g.depth for g in grown.values())):
            found = level(state, plans, tree, grown)
            for i, g in grown.items():
                g.split({node: best for (fit, node), best in found if fit == i}, gained[i], depth)
            # The first level has computed this state, so the one before is done with.
            while depth == 0 and behind:
                behind.pop().unpersist()
            if not any(g.open for g in grown.values()):
                break
        for i, g in grown.items():
            made[i][0].append(g)
            made[i][1].append(gained[i])
        behind.append(state)
        state = state.map(advanced(plans, grown, tree)).persist(StorageLevel.MEMORY_AND_DISK)
        if (tree + 1) % CUT_EVERY == 0:
            state.checkpoint()
            state.count()
            drop_checkpoint(spark, cut)
            cut = state.getCheckpointFile()
    for rdd in (*behind, state):
        rdd.unpersist()
    drop_checkpoint(spark, cut)
    return made


def drop_checkpoint(spark: SparkSession, path: str | None) -> None:
    """Delete the stored state of an earlier tree."""
    if path is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
