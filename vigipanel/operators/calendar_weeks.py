"""Weeks by the calendar, for panels with gaps.

The row-wise operators take lag 4 as four reported rows ago.  Two other readings are here: a
panel made dense, with a row for every week between the first and the last of its group, and
frames that look back or ahead by dates on the panel as it is.  They agree: a lag by date is
the row-wise lag on the dense panel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigipanel.operators.windows import Built, with_ordered

WEEK_DAYS = 7
# Weeks that one generated row stands for before they are spelled out.
SPAN = 520


def group_weeks(df: DataFrame, keys: Sequence[str], week: str, span: int = SPAN) -> DataFrame:
    """(keys, week): every week from the first to the last of each group.

    Weeks are counted from the group's first day.  A long group is cut into spans, which are dealt
    anew before their weeks are generated, so that one group's weeks need not come from one task.
    """
    keys, step = list(keys), WEEK_DAYS * span
    ends = df.dropna(subset=[*keys, week]).groupBy(*keys).agg(
        F.min(F.unix_date(F.to_date(week))).alias("__low"), F.max(F.unix_date(F.to_date(week))).alias("__high")
    )
    starts = ends.withColumn("__at", F.explode(F.sequence("__low", "__high", F.lit(step))))
    dealt = starts.repartition(*keys, "__at")
    last = F.least(F.col("__at") + F.lit(step - 1), F.col("__high"))
    days = dealt.select(*keys, F.explode(F.sequence(F.col("__at"), last, F.lit(WEEK_DAYS))).alias("__day"))
    return days.select(*keys, F.date_from_unix_date("__day").alias(week))


def densify(df: DataFrame, keys: Sequence[str], week: str, fill: Mapping[str, Column] | None = None, reported: str = "reported") -> DataFrame:
    """The panel with a row for each missing week of a group; `reported` tells them apart.

    New rows are NULL but for the keys, the week, and what `fill` says, as expressions that may
    use the keys and the week.  Rows that lie off the weekly raster of their group, or lack a
    key or a week, are kept as they are.
    """
    keys = list(keys)
    marked = df.withColumn(reported, F.lit(True))
    wide = group_weeks(df, keys, week).join(marked, [*keys, week], "full_outer")
    made = {c: F.when(F.col(reported).isNull(), e).otherwise(F.col(c)) for c, e in (fill or {}).items()}
    out = wide.withColumns(made).withColumn(reported, F.coalesce(reported, F.lit(False)))
    missing = [c for c in keys + [week] if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return out.select(*df.columns, reported)


def _by_date(window: WindowSpec, keys: Sequence[str], week: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.unix_date(F.to_date(week)))


def calendar_lag(column: str, weeks: int, keys: Sequence[str], week: str) -> Built:
    """The value `weeks` weeks ago (ahead, if negative), NULL if that week has no row."""
    days = -WEEK_DAYS * weeks
    return lambda w: F.first(column).over(_by_date(w, keys, week).rangeBetween(days, days))


def calendar_rolling(column: str, how: str, width: int, shift: int, keys: Sequence[str], week: str, min_periods: int = 1) -> Built:
    """A statistic over the rows of `width` calendar weeks ending `shift` weeks before."""
    made = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[how]

    def build(w: WindowSpec) -> Column:
        frame = _by_date(w, keys, week).rangeBetween(-WEEK_DAYS * (width + shift - 1), -WEEK_DAYS * shift)
        value = made(F.col(column)).over(frame)
        return value if min_periods <= 1 else F.when(F.count(column).over(frame) >= min_periods, value)

    return build


def add_calendar(df: DataFrame, columns: Mapping[str, Built], keys: Sequence[str], week: str, back: int = 0, ahead: int = 0) -> DataFrame:
    """Columns by date on a panel whose groups the calendar bounds: one exchange, one sort."""
    return with_ordered(df, columns, keys, week, back=back, ahead=ahead, weekly_groups=True)
