"""Vector expressions over array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(a, b, f))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def checked(a: Column, b: Column) -> Column:
    """a, failing if the two vectors differ in length."""
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<double>"))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def taxicab(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def squared_norm(a: Column) -> Column:
    return _fold(a, a, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, which the engine's fourth measure uses in the place of a distance."""
    return dot(a, b) / (norm(a) * norm(b))


#: Pluggable measures by name.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "squared_euclidean": squared_euclidean, "taxicab": taxicab, "cosine": cosine}


def from_origin(a: Column, measure: str = "euclidean") -> Column:
    return DISTANCES[measure](a, zeros(F.size(a)))


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def divide(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x / by)


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def greatest(a: Column) -> Column:
    return F.array_max(a)


def total(a: Column) -> Column:
    return _sum(a)


def silhouette(inside: Column, nearest_other: Column) -> Column:
    """Simplified silhouette (b - a) / max(a, b) of a cluster's own deviation and its distance to the nearest other."""
    return (nearest_other - inside) / F.greatest(inside, nearest_other)
