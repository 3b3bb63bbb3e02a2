"""Evaluation of scored rows: (model, y, p) in long form, one pass for all models.

Nothing here multiplies the rows by the thresholds: a sweep is a row of conditional
counts, and curves work on one row per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigipanel.functions.scalar import classify
from vigipanel.operators.ranks import running_sums, with_next
from vigipanel.session import small_side

COUNTS = ("tp", "fp", "fn", "tn")

# Threshold grids and the defaults used when no threshold helps.
GRID_SHORT = (0.05, 0.10, 0.15, 0.20, 0.25)
GRID_LONG = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
GRID_RECALL = tuple(5 * i / 100 for i in range(1, 10))
DEFAULT_SHORT, DEFAULT_LONG, DEFAULT_CLIMATE, DEFAULT_RECALL = 0.15, 0.25, 0.5, 0.2


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _counts(y: str, hit: Column) -> dict[str, Column]:
    positive, negative = F.col(y) == 1, F.col(y) == 0
    return {
        "tp": F.count_if(positive & hit),
        "fp": F.count_if(negative & hit),
        "fn": F.count_if(positive & ~hit),
        "tn": F.count_if(negative & ~hit),
    }


def confusion(pred: DataFrame, keys: Sequence[str], y: str, yhat: str) -> DataFrame:
    counts = _counts(y, F.col(yhat) == 1)
    return pred.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])


def rates() -> dict[str, Column]:
    """accuracy, recall, precision and F1 from the confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "recall": _ratio(tp, tp + fn),
        "precision": _ratio(tp, tp + fp),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def metrics(conf: DataFrame) -> DataFrame:
    return conf.withColumns(rates())


def classification_report(pred: DataFrame, keys: Sequence[str], y: str, yhat: str) -> DataFrame:
    """Per class, macro and weighted rows: precision, recall, f1, support; plus accuracy."""
    c = confusion(pred, keys, y, yhat)
    tp, fp, fn, tn = (F.col(x) for x in COUNTS)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    one = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn))
    zero = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn))
    n1, n0 = tp + fn, tn + fp
    macro = [(a + b) / 2 for a, b in zip(zero, one, strict=True)]
    weighted = [_ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(zero, one, strict=True)]
    accuracy = _ratio(tp + tn, n0 + n1)
    return c.select(
        *keys,
        F.inline(
            F.array(
                row("0", *zero, n0),
                row("1", *one, n1),
                row("accuracy", accuracy, accuracy, accuracy, n0 + n1),
                row("macro avg", *macro, n0 + n1),
                row("weighted avg", *weighted, n0 + n1),
            )
        ),
    )


def score_counts(pred: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """(keys, value, pos, neg) per distinct score."""
    return pred.groupBy(*keys, F.col(p).alias("value")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def auc(
    pred: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", steps: int | None = None
) -> DataFrame:
    """(keys, auc): exact ROC area with ties counted half; NULL for a single class."""
    below = running_sums(score_counts(pred, keys, y, p), keys, "value", ["neg"], steps=steps)
    pos, neg, before = (F.col(c).cast("double") for c in ("pos", "neg", "neg_before"))
    area = F.sum(pos * before + pos * neg / 2)
    return below.groupBy(*keys).agg(F.try_divide(area, F.sum(pos) * F.sum(neg)).alias("auc"))


def roc_points(
    pred: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", steps: int | None = None
) -> DataFrame:
    """(keys, threshold, fpr, tpr): one point per distinct score, from high to low."""
    return _rates_at(_cumulated(pred, keys, y, p, steps), keys)


def roc_curve(
    pred: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", steps: int | None = None
) -> DataFrame:
    """The points of a drawn curve: from (0, 0) at an infinite threshold, without the points
    that lie half way between their neighbours.

    A point between two others is left out if the step to it and the step from it add the same
    numbers of positives and of negatives, which integers decide exactly; the points at the
    highest and the lowest score always stay.
    """
    points = with_next(_cumulated(pred, keys, y, p, steps), keys, "value", ["pos", "neg"], descending=True, steps=steps)
    first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
    same = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
    drawn = _rates_at(points, keys, kept=first | ~F.coalesce(same, F.lit(False)))
    classes = points.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    origin = classes.select(
        *keys,
        F.lit(float("inf")).alias("threshold"),
        F.when(F.col("__n") > 0, 0.0).alias("fpr"),
        F.when(F.col("__p") > 0, 0.0).alias("tpr"),
    )
    return origin.unionByName(drawn)


def _cumulated(pred: DataFrame, keys: Sequence[str], y: str, p: str, steps: int | None) -> DataFrame:
    return running_sums(
        score_counts(pred, keys, y, p), keys, "value", ["pos", "neg"], descending=True, steps=steps
    )


def _rates_at(above: DataFrame, keys: Sequence[str], kept: Column | None = None) -> DataFrame:
    totals = above.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    rows = above if kept is None else above.where(kept)
    return rows.join(small_side(totals), list(keys)).select(
        *keys,
        F.col("value").alias("threshold"),
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), F.col("__n")).alias("fpr"),
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), F.col("__p")).alias("tpr"),
    )


def threshold_sweep(
    pred: DataFrame,
    thresholds: Sequence[float],
    keys: Sequence[str],
    y: str = "y",
    p: str = "p",
) -> DataFrame:
    """(keys, threshold, counts, rates) for p >= threshold: one pass for all thresholds."""
    aggs, rows = [], []
    for i, t in enumerate(thresholds):
        counts = _counts(y, F.coalesce(F.col(p) >= F.lit(float(t)), F.lit(False)))
        aggs += [c.alias(f"{n}_{i}") for n, c in counts.items()]
        rows.append(
            F.struct(
                F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in COUNTS]
            )
        )
    return (
        pred.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows))).withColumns(rates())
    )


def best_threshold(
    sweep: DataFrame, keys: Sequence[str], metric: str = "f1", default: float = DEFAULT_LONG
) -> DataFrame:
    """(keys, threshold, best): the lowest threshold with the best value.

    Where no threshold reaches a value above 0 the default stands.
    """
    if metric == "recall":
        score = _ratio(F.col("tp"), F.col("tp") + F.col("fn") + F.lit(1e-6))
    else:
        score = F.col(metric)
    best = F.max(F.struct(score.alias("v"), (-F.col("threshold")).alias("t")))
    return (
        sweep.groupBy(*keys)
        .agg(best.alias("b"))
        .select(
            *keys,
            F.when(F.col("b.v") > 0, -F.col("b.t")).otherwise(F.lit(default)).alias("threshold"),
            F.col("b.v").alias("best"),
        )
    )


def comparison(
    pred: DataFrame, keys: Sequence[str], threshold: float, strict: bool, sort_by: str = "auc"
) -> DataFrame:
    """Model comparison table at a fixed threshold, best first."""
    scored = pred.withColumn("yhat", classify("p", threshold, strict))
    table = metrics(confusion(scored, keys, "y", "yhat")).join(auc(pred, keys), list(keys))
    return table.orderBy(F.desc(sort_by), *keys)


def tuned_comparison(
    tune: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    thresholds: Sequence[float],
    metric: str = "f1",
    default: float = DEFAULT_LONG,
) -> DataFrame:
    """Pick a threshold per model on `tune`, report the models on `test`."""
    best = best_threshold(threshold_sweep(tune, thresholds, keys), keys, metric, default)
    at = threshold_sweep(test, sorted({*thresholds, default}), keys)
    chosen = at.join(best.drop("best"), [*keys, "threshold"])
    return chosen.join(auc(test, keys), list(keys))
