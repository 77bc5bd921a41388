"""Column expressions over ARRAY<DOUBLE>; all of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_STD = 1e-4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, also when body uses it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def total_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def reduce_elements(v: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Fold the elements of a non-empty array with f, starting from its first element."""
    rest = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(v, 1), lambda acc, x: f(acc, x))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def deviation(v: Column) -> Column:
    """Sample standard deviation by two passes; 0 for a single element."""

    def around(m: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
        return F.when(F.size(v) > 1, F.sqrt(squares / (F.size(v) - 1))).otherwise(0.0)

    return let(mean(v), around)


def usable_std(std: Column) -> Column:
    return F.when(std < LOW_STD, 1.0).otherwise(std)


def shifted(v: Column, by: Column) -> Column:
    return let(by, lambda c: F.transform(v, lambda x: x - c))


def scaled(v: Column, by: Column) -> Column:
    return let(by, lambda c: F.transform(v, lambda x: x * c))


def clamp_log(x: Column) -> Column:
    """0 for negative input, log(1 + x) otherwise."""
    return F.when(x < 0, 0.0).otherwise(F.log1p(x))


def latitude_weight(degrees: Column) -> Column:
    """sqrt(cos(latitude)); a latitude beyond the poles is an error."""
    bad = F.abs(degrees) > 90
    message = F.concat(F.lit("latitude out of range: "), degrees.cast("string"))
    # cos(90 degrees) is a tiny number of either sign in floating point
    weight = F.sqrt(F.greatest(F.cos(F.radians(degrees)), F.lit(0.0)))
    return F.when(bad, F.raise_error(message).cast("double")).otherwise(weight)


def finite(v: Column) -> Column:
    """The array itself; NULL or NaN inside, or a NULL array, raises."""
    # NULL when no NaN was found but a NULL was; compiled, unlike a lambda per element
    bad = F.coalesce(F.array_contains(v, F.lit(float("nan"))), F.lit(True))
    failure = F.raise_error(F.lit("matrix values must not be NULL or NaN")).cast("array<double>")
    return F.when(bad, failure).otherwise(v)
