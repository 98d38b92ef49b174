"""States: boolean columns that are never null; a missing value is in no state."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def clean(x: Column) -> Column:
    """A number as a double, NaN as null (Spark puts NaN above all numbers)."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def positive(x: Column, eps: float = 0.0) -> Column:
    return _is(x > F.lit(eps))


def negative(x: Column, eps: float = 0.0) -> Column:
    return _is(x < F.lit(-eps))


def inactive(x: Column, eps: float = 0.0) -> Column:
    return _is(F.abs(x) <= F.lit(eps))


accumulating, depleting = positive, negative


def difference(x: Column, lag: int, w: WindowSpec) -> Column:
    return x - F.lag(x, lag).over(w)


def rising(x: Column, w: WindowSpec, lag: int = 10, eps: float = 0.0) -> Column:
    return positive(difference(x, lag, w), eps)


def falling(x: Column, w: WindowSpec, lag: int = 10, eps: float = 0.0) -> Column:
    return negative(difference(x, lag, w), eps)


def above(x: Column, level: Column) -> Column:
    return _is(x > level)


def below(x: Column, level: Column) -> Column:
    return _is(x < level)


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; a null stays null, which least and greatest alone wouldn't do."""
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)
