"""Ordered features within a group: lags, leads, rolling statistics.

All functions take the group keys and the order column and work by row position:
a missing week is not filled in, so lag 4 is "four reported rows ago".

Every column of one ordering goes into a single `withColumns`, so a feature build
keeps one exchange and one sort on the keys however many columns it adds.

How a group reaches its task:

* `weekly_groups=True` states that (keys, order) is unique and the order a calendar
  day, as in a panel.  A group is then bounded by the calendar and stays whole.  The rows are
  sorted anyway, so a doubled week shows beside its twin and is refused there, without a job.
* Otherwise the groups are counted first.  Those over `limit` rows are cut into runs of
  `limit` rows by exact position.  A run also gets copies of the `back` rows before it
  and the `ahead` rows after it, which the frames need, and drops them afterwards.  The
  result is the same, and no task holds more than a run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigipanel.operators.ranks import rank_in_slices, value_cells
from vigipanel.session import TASK_ROWS, materialise, small_side

Built = Callable[[WindowSpec], Column]

_POS, _RUN, _NULLS, _TWICE = "__pos", "__run", "__null_slot", "__twice"
_AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}


def lag(column: str, k: int) -> Built:
    return lambda w: F.lag(column, k).over(w)


def lead(column: str, k: int) -> Built:
    return lambda w: F.lead(column, k).over(w)


def rolling(column: str, how: str, width: int, shift: int, min_periods: int) -> Built:
    """A statistic over `width` rows ending `shift` rows before the current one.

    Missing values are skipped; fewer than `min_periods` present values give NULL.
    """

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(width + shift - 1), -shift)
        value = _AGGREGATES[how](F.col(column)).over(frame)
        if min_periods <= 1:
            return value
        return F.when(F.count(column).over(frame) >= min_periods, value)

    return build


def with_ordered(
    df: DataFrame,
    columns: Mapping[str, Built],
    keys: Sequence[str],
    order: str,
    *,
    back: int,
    ahead: int = 0,
    weekly_groups: bool = False,
    null_keys: str = "keep",
    limit: int = TASK_ROWS,
) -> DataFrame:
    """Add ordered columns, each given as a function of the window.

    `back` and `ahead` say how many rows the frames reach.  Rows with a missing key
    belong to no group.  With `null_keys="keep"` they stay, with NULL in every new
    column, and are spread over tasks; "drop" removes them before the shuffle, for
    callers that discard them anyway.
    """
    keys = list(keys)
    if not weekly_groups:
        sizes = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        # At most (rows of the table) / limit groups.
        hot = small_side(sizes.where(F.col("__n") > limit).select(*keys))
        if not hot.isEmpty():
            return _in_runs(df, columns, keys, order, back, ahead, null_keys, limit, hot)
    if null_keys == "drop":
        window = Window.partitionBy(*keys).orderBy(order)
        made = {n: c(window) for n, c in columns.items()}
        if weekly_groups:
            made[_TWICE] = F.lag(order, 1).over(window) == F.col(order)
        return _refuse_twice(df.dropna(subset=keys).withColumns(made), keys, order)
    slot = F.when(_keyless(keys), F.pmod(F.xxhash64(order, *keys), F.lit(1 << 20)))
    window = Window.partitionBy(*keys, _NULLS).orderBy(order)
    made = {n: F.when(F.col(_NULLS).isNull(), c(window)) for n, c in columns.items()}
    if weekly_groups:
        made[_TWICE] = F.col(_NULLS).isNull() & (F.lag(order, 1).over(window) == F.col(order))
    return _refuse_twice(df.withColumn(_NULLS, slot).withColumns(made).drop(_NULLS), keys, order)


def _refuse_twice(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Fail on a row that has the order value of the row before it in its group.

    The check is a filter on a column of the same window, so it is never pruned and costs
    neither an exchange nor a sort.
    """
    if _TWICE not in df.columns:
        return df
    where = F.concat_ws(", ", *[F.col(c).cast("string") for c in [*keys, order]])
    fail = F.raise_error(F.concat(F.lit(f"two rows of one {order}: "), where)).cast("boolean")
    return df.where(F.when(F.col(_TWICE), fail).otherwise(F.lit(True))).drop(_TWICE)


def _keyless(keys: Sequence[str]) -> Column:
    condition = F.lit(False)
    for k in keys:
        condition = condition | F.col(k).isNull()
    return condition


def _in_runs(
    df: DataFrame,
    columns: Mapping[str, Built],
    keys: list[str],
    order: str,
    back: int,
    ahead: int,
    null_keys: str,
    limit: int,
    hot: DataFrame,
) -> DataFrame:
    """The ordered columns with the groups of `hot` cut into runs of `limit` rows."""
    if limit < max(back, ahead):
        raise ValueError("limit must be at least as long as the widest frame")
    keyed = df.dropna(subset=keys)
    large = materialise(keyed.join(hot, keys, "left_semi"))
    celled = value_cells(large, keys, order, steps=10)
    ranked = rank_in_slices(
        celled, keys=keys, slices=[F.col("__cell")], order=[order], name=_POS
    ).drop("__cell")
    run = F.floor((F.col(_POS) - 1) / limit)
    offset = (F.col(_POS) - 1) % limit
    targets = F.array_compact(
        F.array(
            run,
            F.when(offset >= limit - back, run + 1) if back else F.lit(None),
            F.when(offset < ahead, run - 1) if ahead else F.lit(None),
        )
    )
    # Copies reach a run next to their own; a run is told apart by (run, own run).
    runs = ranked.withColumns({"__own": run, _RUN: F.explode(targets)}).drop(_POS)
    small = keyed.join(hot, keys, "left_anti").withColumns(
        {"__own": F.lit(0).cast("bigint"), _RUN: F.lit(0).cast("bigint")}
    )
    window = Window.partitionBy(*keys, _RUN).orderBy(order)
    made = (
        small.unionByName(runs)
        .withColumns({n: c(window) for n, c in columns.items()})
        .where(F.col(_RUN) == F.col("__own"))
        .drop(_RUN, "__own")
    )
    if null_keys == "drop":
        return made
    return made.unionByName(df.where(_keyless(keys)), allowMissingColumns=True)


def add_lags(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int],
    keys: Sequence[str],
    order: str,
    name: str = "{col}_lag{k}",
    **kw,
) -> DataFrame:
    made = {name.format(col=c, k=k): lag(c, k) for c in columns for k in lags}
    return with_ordered(df, made, keys, order, back=max(lags), **kw)


def add_rolling(
    df: DataFrame,
    column: str,
    how: str,
    widths: Sequence[int],
    keys: Sequence[str],
    order: str,
    name: str,
    *,
    shift: int = 1,
    min_periods: int | None = 1,
    **kw,
) -> DataFrame:
    """`min_periods=None` asks for a full window."""
    made = {
        name.format(w=w): rolling(column, how, w, shift, w if min_periods is None else min_periods)
        for w in widths
    }
    return with_ordered(df, made, keys, order, back=max(widths) + shift, **kw)


def add_future_target(
    df: DataFrame, label: str, horizon: int, keys: Sequence[str], order: str, name: str, **kw
) -> DataFrame:
    """The label `horizon` rows ahead; NULL at the end of a group."""
    return with_ordered(
        df, {name: lead(label, horizon)}, keys, order, back=0, ahead=horizon, **kw
    )


def add_abs_change(
    df: DataFrame, names: Mapping[str, str], k: int, keys: Sequence[str], order: str, **kw
) -> DataFrame:
    """|value k rows ago - value|, for {column: new name}."""
    made = {
        new: (lambda w, c=c: F.abs(F.lag(c, k).over(w) - F.col(c))) for c, new in names.items()
    }
    return with_ordered(df, made, keys, order, back=k, **kw)
