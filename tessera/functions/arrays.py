"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def each(df: DataFrame, keys: list, values: Column, place: str, value: str) -> DataFrame:
    """``keys, place, value``: a row for each entry of an array expression.

    The outer form and a filter behind it: for the inner form Spark infers a filter on the
    array's size, writes the whole expression into it, and so computes it twice or more.
    """
    return df.select(*keys, F.posexplode_outer(values).alias(place, value)).where(F.col(place).isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def as_double(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` at length one; a zero vector stays as it is."""
    return let(norm(a), lambda size: F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity with each norm floored at ``eps``."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return let(mean(values), lambda centre: F.sqrt(mean(F.transform(values, lambda x: (x - centre) * (x - centre)))))


def largest(values: Column, k: int) -> Column:
    """The k-th largest value, null where there are fewer."""
    return F.get(F.sort_array(values, asc=False), F.lit(k - 1))


def median(values: Column) -> Column:
    n = F.size(values)
    return let(F.sort_array(values), lambda v: (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0)


def percentile(values: Column, share: float) -> Column:
    """Linearly interpolated percentile of an array."""
    at = (F.size(values) - 1) * F.lit(float(share))

    def between(ordered: Column) -> Column:
        low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return let(F.sort_array(values), between)
