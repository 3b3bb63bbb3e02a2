"""Exact statistics of many columns at once, the rows read as they are.

Unpivoting d columns makes d rows of each.  Here a task reads a row once, counts for every
column how many values fall in each cell between that column's cut points, and hands on one
array of counts per column.  Arrays of all tasks add up to the counts of the table, which name
the few cells that hold the order statistics looked for; a second pass hands on the values of
those cells only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.session import ship_package

# `percentile` keeps the distinct values of a column in one buffer, boxed.
PERCENTILE_ROWS = 1_000_000
# Values of a cell that are ranked in one task, and the most cells of a column (a power of two).
CELL_ROWS, MOST_STEPS = 200_000, 14


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The present values of a column in double precision; NaN is above all others, as in a sort."""
    return column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def cell_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cut points lie below each value."""
    return np.searchsorted(cuts, values, side="left")


def cut_points(df: DataFrame, columns: Sequence[str], steps: int) -> dict[str, np.ndarray]:
    """About 2**steps - 1 rising cut points per column, from one pass of approximate quantiles.

    They only balance the cells; what is counted by them is exact wherever they lie.
    """
    cells = 1 << steps
    at = [i / cells for i in range(1, cells)]
    row = df.agg(*[F.percentile_approx(c, at, 10 * cells).alias(c) for c in columns]).first()
    return {c: np.unique(np.array(row[c] or [], float)) for c in columns}


def cell_counts(df: DataFrame, columns: Sequence[str], cuts: Mapping[str, np.ndarray]) -> DataFrame:
    """(feature, counts): per column the number of values in each of its cells.

    A task adds up all its rows before it emits one array per column; the arrays of a column
    meet in one task, as many as there were tasks, and are added there.
    """
    columns = list(columns)
    ship_package(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(cuts[c]) + 1, np.int64) for c in columns]
        for batch in batches:
            for i, c in enumerate(columns):
                cells = cell_of(_numbers(batch.column(i)), cuts[c])
                totals[i] += np.bincount(cells, minlength=len(totals[i]))
        arrays = [pa.array(columns), pa.array(totals, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for feature, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counts.values.to_numpy()
                totals[feature] = totals[feature] + own if feature in totals else own.copy()
        arrays = [pa.array([*totals], pa.string()), pa.array([*totals.values()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "counts"])

    schema = "feature string, counts array<bigint>"
    each = _doubles(df, columns).mapInArrow(count, schema)
    return each.repartition("feature").mapInArrow(add, schema)


def _values_of_cells(df: DataFrame, columns: Sequence[str], cuts: Mapping[str, np.ndarray], wanted: Mapping[str, Sequence[int]]) -> DataFrame:
    """(feature, cell, value, n): the values in the wanted cells, equal ones of a batch together."""
    columns = list(columns)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cells, values, counts = [], [], [], []
            for i, c in enumerate(columns):
                x = _numbers(batch.column(i))
                cell = cell_of(x, cuts[c])
                found, n = np.unique(x[np.isin(cell, wanted[c])], return_counts=True)
                names += [c] * len(found)
                cells.append(cell_of(found, cuts[c]))
                values.append(found)
                counts.append(n)
            arrays = [pa.array(names, pa.string()), *(pa.array(np.concatenate(x)) for x in (cells, values, counts))]
            yield pa.RecordBatch.from_arrays(arrays, ["feature", "cell", "value", "n"])

    return _doubles(df, columns).mapInArrow(pick, "feature string, cell bigint, value double, n bigint")


def _neighbours(n: int, q: float) -> tuple[int, int, float]:
    """The ranks next to a quantile of n values, and how far it lies between them."""
    at = q * (n - 1)
    return int(np.floor(at)), int(np.ceil(at)), at - np.floor(at)


def wide_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], *, steps: int | None = None
) -> DataFrame:
    """(feature, <name> ...): linearly interpolated quantiles of each column, NULL without values.

    Up to PERCENTILE_ROWS rows one aggregation finds them all.  Beyond (or with `steps`) the
    cells do: the number of cells follows from the number of rows.  A stored table is read
    three times, each time without multiplying its rows; the driver holds the cut points and
    counts of the cells, a few thousand numbers per column.
    """
    columns = list(columns)
    if steps is None:
        n = df.count()
        if n <= PERCENTILE_ROWS:
            at = list(probs.values())
            row = _doubles(df, columns).agg(*[F.percentile(c, at).alias(c) for c in columns])
            picked = [F.struct(F.lit(c).alias("feature"), *[F.get(c, F.lit(i)).alias(p) for i, p in enumerate(probs)]) for c in columns]
            return row.select(F.inline(F.array(*picked)))
        steps = min(MOST_STEPS, max(8, int(np.ceil(np.log2(n / CELL_ROWS)))))
    cuts = cut_points(_doubles(df, columns), columns, steps)
    counts = {r["feature"]: np.array(r["counts"]) for r in cell_counts(df, columns, cuts).collect()}  # a row per column
    wanted, places = {}, []
    for c in columns:
        counts.setdefault(c, np.zeros(1, np.int64))  # no task has had a row
        ends = counts[c].cumsum()
        size = int(ends[-1])
        held = set()
        for name, q in probs.items() if size else ():
            low, high, part = _neighbours(size, q)
            for end, rank in (("low", low), ("high", high)):
                cell = int(np.searchsorted(ends, rank, side="right"))
                held.add(cell)
                places.append((c, name, end, cell, rank - int(ends[cell] - counts[c][cell]), float(part)))
        wanted[c] = sorted(held)
    spark = df.sparkSession
    where = spark.createDataFrame(places, "feature string, name string, end string, cell bigint, rank bigint, part double")
    found = _values_of_cells(df, columns, cuts, wanted).groupBy("feature", "cell", "value").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("feature", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hits = ranked.join(F.broadcast(where), ["feature", "cell"]).where("first <= rank and rank < first + n")  # a row per column, quantile and end
    ends = hits.groupBy("feature", "name").agg(
        F.max(F.when(F.col("end") == "low", F.col("value"))).alias("low"),
        F.max(F.when(F.col("end") == "high", F.col("value"))).alias("high"),
        F.max("part").alias("part"),
    )
    low, high, part = F.col("low"), F.col("high"), F.col("part")
    value = F.when((part == 0) | (low == high), low).otherwise((1 - part) * low + part * high)
    made = ends.groupBy("feature").agg(*[F.max(F.when(F.col("name") == p, value)).alias(p) for p in probs])
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(made, "feature", "left")


def joint_counts(df: DataFrame, columns: Sequence[str], label: str, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature, bin, label, n): the rows of each bin and label value, for all columns in one pass.

    A bin is the number of cut points below the value; a missing value is in no bin.  The label
    is a number; a task emits one row per column, bin and label value that it has met.
    """
    columns = list(columns)
    ship_package(df.sparkSession)
    edges = {c: np.array([x for x in cuts[c] if x is not None], float) for c in columns}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int, float | None], int] = {}
        for batch in batches:
            y = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(float)
            classes, code = np.unique(y, return_inverse=True)
            names = [None if np.isnan(v) else float(v) for v in classes]
            for i, c in enumerate(columns):
                column = batch.column(i)
                there = ~column.is_null().to_numpy(zero_copy_only=False)
                cell = cell_of(_numbers(column), edges[c])
                found, n = np.unique(cell * len(names) + code[there], return_counts=True)
                for key, times in zip(found.tolist(), n.tolist()):
                    key = (c, key // len(names), names[key % len(names)])
                    totals[key] = totals.get(key, 0) + times
        arrays = [pa.array([k[i] for k in totals], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([*totals.values()], pa.int64())], ["feature", "bin", "label", "n"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("__y"))
    each = rows.mapInArrow(count, "feature string, bin bigint, label double, n bigint")
    return each.groupBy("feature", "bin", "label").agg(F.sum("n").alias("n"))
