"""Functions of array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(v: str | Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, centroid: mean of the vectors by key, by position, with partial sums before the shuffle."""
    long = rows.select(key, F.posexplode(vector).alias("p", "x")).groupBy(key, "p").agg(F.avg("x").alias("m"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("centroid"))


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once: what stands in a lambda is worked out anew for each element."""
    return F.transform(F.array(value), use)[0]


def scaled(v: str | Column, by: Column) -> Column:
    return once(by, lambda b: F.transform(v, lambda x: x * b))


def added(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(v: str | Column) -> Column:
    """The vector with length 1 (with lengths under 1e-12 taken as that)."""
    return once(F.col(v) if isinstance(v, str) else v, lambda w: scaled(w, 1 / F.greatest(norm(w), F.lit(1e-12))))


def vector_sum(v: str, weight: Column, size: int) -> Column:
    """An aggregate: the weighted sum of vectors of a known size, a plain sum for each position, added up before the
    shuffle."""
    return F.array(*[F.sum(F.col(v)[k] * weight) for k in range(size)])
