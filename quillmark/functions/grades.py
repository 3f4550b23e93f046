"""Expressions on points."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.fixed import ROUNDING


def round_up(points: Column, method: str) -> Column:
    """Up to the next whole, half or quarter point; unchanged for other methods.

    Digits behind the ninth are arithmetic noise and must not cost a step.
    """
    steps = ROUNDING.get(method)
    if steps is None:
        return points
    return F.ceil(F.round(points, 9) * steps).cast("double") / steps


def within(value: Column, upper: Column) -> Column:
    """Between 0 and ``upper``; null stays null, which ``least`` alone would skip."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), upper))


def capped(grading: Column, points: Column) -> Column:
    """Grading as a number, at most the points of the item; null if it is none."""
    value = grading.try_cast("double")
    return F.when(value.isNotNull(), F.least(value, points))


def relative(grading: Column, points: Column) -> Column:
    """Share of the points that was awarded; null if there are none to award."""
    return F.try_divide(grading.try_cast("double"), F.nullif(points, F.lit(0.0)))
