"""Positions, running sums and exact quantiles without a whole group in one task.

The pattern is the same throughout: cut the order into slices, total the slices
(map-side combined), turn the totals into offsets on that small table, and finish
inside each slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.session import TASK_ROWS, materialise, small_side

_CUTS, _CELL = "__cuts", "__cell"

# `percentile` keeps the distinct values of a group in one buffer, boxed.
PERCENTILE_ROWS = 1_000_000


def rank_in_slices(
    df: DataFrame,
    *,
    slices: Sequence[Column],
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """1-based position of every row in its group, by `slices` then `order`.

    `slices` are nested levels, each non-decreasing in the order wanted (a week, then
    a province).  The offsets are found level by level on the table of slice counts,
    so a task only ever sorts the rows of one innermost slice.  Missing values come
    first, as in a sort.  `total` names a column for the number of all rows, which the
    stored slice counts give without another look at the input.
    """
    columns = df.columns
    # Inside a struct a missing value is equal to itself, so the join keeps its rows.
    groups = {f"__k{i}": F.struct(k) for i, k in enumerate(keys)}
    levels = {f"__s{i}": F.struct(s) for i, s in enumerate(slices)}
    df = df.withColumns({**groups, **levels})
    outer, inner = list(groups), list(levels)
    counts = materialise(df.groupBy(*outer, *inner).agg(F.count(F.lit(1)).alias("__n")))
    # Rows before the innermost slice within its parent slice, then parents upwards.
    parts = [outer + inner[:depth] for depth in range(len(inner))]
    table = counts.withColumn("__before", _sum_before("__n", parts[-1], inner[-1])).drop("__n")
    for depth in reversed(range(len(inner) - 1)):
        by = [*parts[depth], inner[depth]]
        totals = counts.groupBy(*by).agg(F.sum("__n").alias("__n"))
        higher = totals.select(*by, _sum_before("__n", parts[depth], inner[depth]).alias("__more"))
        table = table.join(higher, by).withColumn("__before", F.col("__before") + F.col("__more"))
        table = table.drop("__more")
    extra = [] if total is None else [total]
    if total is not None:
        table = table.withColumn(total, counts.agg(F.sum("__n")).scalar())
    window = Window.partitionBy(*outer, *inner).orderBy(*order)
    return df.join(table, [*outer, *inner]).select(
        *columns, *extra, (F.col("__before") + F.row_number().over(window)).alias(name)
    )


def _sum_before(column: str, keys: Sequence[str], by: Column | str) -> Column:
    """Sum of a column over the rows ahead; 0 for the first."""
    window = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def sorted_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position in the sort order, for columns that have no natural slices.

    The sort is range-partitioned on samples of the data, so its partitions are even
    whatever the values look like; only the partition sizes are added up in one place.
    """
    numbered = materialise(
        df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__id", 33))
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", _sum_before("__n", [], "__part").alias("__off"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(small_side(offsets), "__part").select(
        *df.columns, (F.col("__off") + inside).alias(name)
    )


def _with_cell(df: DataFrame, value: str, steps: int) -> DataFrame:
    """How many cut points lie below the value: a binary search, one projection per step.

    Each step reads the column of the step before, so the search stays in generated code
    and its expression does not grow.
    """
    df = df.withColumn(_CELL, F.lit(0))
    for width in (1 << s for s in reversed(range(steps))):
        low = F.col(_CELL)
        above = F.get(_CUTS, low + (width - 1)) < F.col(value)
        df = df.withColumn(_CELL, low + F.when(above, width).otherwise(0))
    return df


def value_cells(df: DataFrame, keys: Sequence[str], value: str, steps: int) -> DataFrame:
    """Add a cell number that does not decrease with the value: 2**steps cells per group.

    The cut points are approximate quantiles, so the cells are about equally full.  They
    only balance the work: callers total the cells exactly, so results do not depend on
    where the cuts fall.
    """
    cells = 1 << steps
    at = [i / cells for i in range(1, cells)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, at, 10 * cells).alias(_CUTS))
    if keys:
        marked = df.join(small_side(cuts, max(1, 2_000_000 // cells)), list(keys))
    else:
        marked = df.withColumn(_CUTS, cuts.scalar())
    return _with_cell(marked, value, steps).drop(_CUTS)


def _before(keys: Sequence[str], by: Column, sums: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_before": _sum_before(c, keys, by) for c in sums}


def running_sums(
    table: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    steps: int | None = None,
) -> DataFrame:
    """Add `<c>_before`: the sum of c over the rows of the group ahead of this one.

    `table` has one row per (keys, value), none of them missing.  Up to `TASK_ROWS` rows a plain window does.
    Beyond (or with `steps` given) the groups are cut into cells; a task then holds one
    cell, and the totals of the cells are the offsets.
    """
    keys = list(keys)
    table = materialise(table)
    direction = F.desc if descending else F.asc
    if steps is None:
        if table.count() <= TASK_ROWS:
            return table.withColumns(_before(keys, direction(value), sums))
        steps = 10
    celled = value_cells(table, keys, value, steps)
    totals = celled.groupBy(*keys, _CELL).agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.withColumns(_before(keys, direction(_CELL), sums)).select(
        *keys, _CELL, *[F.col(f"{c}_before").alias(f"__{c}_offset") for c in sums]
    )
    inside = celled.join(offsets, [*keys, _CELL]).withColumns(
        _before([*keys, _CELL], direction(value), sums)
    )
    return inside.select(
        *table.columns,
        *[(F.col(f"{c}_before") + F.col(f"__{c}_offset")).alias(f"{c}_before") for c in sums],
    )


def with_next(
    table: DataFrame,
    keys: Sequence[str],
    value: str,
    columns: Sequence[str],
    *,
    descending: bool = False,
    steps: int | None = None,
) -> DataFrame:
    """Add `next_<c>`: the value of c in the row that follows in the group, NULL for the last.

    `table` has one row per (keys, value), none of them missing.  Beyond `TASK_ROWS` rows (or
    with `steps` given) the groups are cut into cells: the last row of a cell is followed by
    the first row of the next cell that has any, found on the table of the cells' first rows.
    """
    keys = list(keys)
    table = materialise(table)
    direction = F.desc if descending else F.asc
    following = lambda by, order, c: F.lead(c).over(Window.partitionBy(*by).orderBy(order))
    if steps is None:
        if table.count() <= TASK_ROWS:
            return table.withColumns({f"next_{c}": following(keys, direction(value), c) for c in columns})
        steps = 10
    celled = value_cells(table, keys, value, steps)
    pick = F.max_by if descending else F.min_by
    firsts = celled.groupBy(*keys, _CELL).agg(pick(F.struct(*columns), value).alias("__first"))
    after = firsts.select(*keys, _CELL, following(keys, direction(_CELL), "__first").alias("__after"))
    inside = celled.join(after, [*keys, _CELL]).withColumn("__row", F.struct(*columns))
    inside = inside.withColumn("__next", F.coalesce(following([*keys, _CELL], direction(value), "__row"), F.col("__after")))
    return inside.select(*table.columns, *[F.col("__next")[c].alias(f"next_{c}") for c in columns])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one scan of the key columns, combined map-side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _between(low: Column, high: Column, part: Column) -> Column:
    """Interpolation with the arithmetic of `percentile`, so that both paths agree to the bit."""
    return F.when((part == 0) | (low == high), low).otherwise((1 - part) * low + part * high)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    steps: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, for groups of any size.

    If every group fits a task, `percentile` finds them in one aggregation.  Otherwise
    (or with `steps` given) the rows are counted per cell, which tells exactly which
    cells hold the order statistics next to each quantile, and only the values of those
    cells are counted and ranked: about one row in 2**steps per quantile.

    A stored table is scanned three times for this; store an expensive input first.
    Rows without a key form no group.
    """
    keys = list(keys)
    rows = df.dropna(subset=[*keys, value]).select(
        *keys, F.col(value).cast("double").alias("value")
    )
    if steps is None:
        if largest_group(rows, keys) <= PERCENTILE_ROWS:
            at = F.percentile("value", list(probs.values())).alias("__q")
            return rows.groupBy(*keys).agg(at).select(
                *keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
            )
        steps = 10
    celled = value_cells(rows, keys, "value", steps)
    totals = celled.groupBy(*keys, _CELL).agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy(*keys))
    ranged = totals.withColumns({**_before(keys, F.asc(_CELL), ["n"]), "__size": size})

    def ranks(q: float) -> tuple[Column, Column, Column]:
        """Ranks next to the quantile, and how far it lies between them."""
        at = F.lit(float(q)) * (F.col("__size") - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    def holds(rank: Column) -> Column:
        return (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))

    wanted = F.lit(False)
    for q in probs.values():
        low, high, _ = ranks(q)
        wanted = wanted | holds(low) | holds(high)
    cells = ranged.where(wanted).select(
        *keys, _CELL, F.col("n_before").alias("__offset"), "__size"
    )
    counts = (
        celled.join(small_side(cells), [*keys, _CELL])
        .groupBy(*keys, _CELL, "__offset", "__size", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = counts.withColumns(_before([*keys, _CELL], F.asc("value"), ["n"])).withColumn(
        "n_before", F.col("n_before") + F.col("__offset")
    )
    picks = []
    for name, q in probs.items():
        low, high, part = ranks(q)
        picks.append(F.max(F.when(holds(low), F.col("value"))).alias(f"__{name}_low"))
        picks.append(F.max(F.when(holds(high), F.col("value"))).alias(f"__{name}_high"))
        picks.append(F.max(part).alias(f"__{name}_part"))
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            _between(F.col(f"__{name}_low"), F.col(f"__{name}_high"), F.col(f"__{name}_part")).alias(name)
            for name in probs
        ],
    )
