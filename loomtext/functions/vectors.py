"""Vector expressions over ``array<float>`` or ``array<double>``, in doubles and in fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, even where it is used inside a lambda over many elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(v: Column) -> Column:
    """``v`` with norm 1; a norm of zero, NaN or infinity is an error. Null stays null."""

    def divided(n: Column) -> Column:
        bad = F.isnan(n) | (n == 0) | (n == float("inf"))
        checked = F.when(bad, F.raise_error(F.lit("a vector has no finite norm above 0")).cast("double")).otherwise(n)
        return bound(checked, lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return F.when(v.isNotNull(), bound(norm(v), divided))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))
