"""Row-level column expressions.  All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def incidence(cases: str, population: str) -> Column:
    """Cases per head.  A zero or missing population gives NULL, never an error."""
    return F.try_divide(F.col(cases), F.col(population))


def difference(a: str, b: str) -> Column:
    return F.col(a) - F.col(b)


def growth(a: str, b: str, eps: float) -> Column:
    """Relative change from b to a, with `eps` added to the denominator."""
    return F.try_divide(F.col(a) - F.col(b), F.col(b) + F.lit(eps))


def product(a: str, b: str) -> Column:
    return F.col(a) * F.col(b)


def cyclic(value: Column | str, period: float) -> tuple[Column, Column]:
    """A position in a cycle as its (sin, cos) pair."""
    value = F.col(value) if isinstance(value, str) else value
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def iso_week(day: str) -> Column:
    return F.weekofyear(day)


def classify(score: str, threshold: float, strict: bool) -> Column:
    """1 above the threshold; `strict` leaves the threshold itself out."""
    score = F.col(score)
    hit = score > F.lit(threshold) if strict else score >= F.lit(threshold)
    return F.coalesce(hit.cast("int"), F.lit(0))


def exceeds(value: str, threshold: Column) -> Column:
    """0/1 flag; a comparison with a missing value is 0."""
    return F.coalesce((F.col(value) > threshold).cast("int"), F.lit(0))


def hybrid_threshold(q1: Column, q3: Column, p90: Column) -> Column:
    """The stricter of the upper Tukey fence and the 90th percentile."""
    return F.greatest(q3 + F.lit(1.5) * (q3 - q1), p90)


def class_weight(label: str, positive: float, negative: float = 1.0) -> Column:
    return F.when(F.col(label) == 1, F.lit(float(positive))).otherwise(F.lit(float(negative)))


def nan_to_null(column: str) -> Column:
    return F.when(F.isnan(column), None).otherwise(F.col(column))
