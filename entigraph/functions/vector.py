"""Distances between an array column and a query vector, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _with_query(vector: Column, query: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def dot(vector: Column, query: tuple[float, ...]) -> Column:
    return _sum(F.zip_with(vector.cast("array<double>"), _with_query(vector, query), lambda a, b: a * b))


def distance(vector: Column, query: tuple[float, ...], metric: str = "cosine") -> Column:
    """Smaller is nearer; null where the vector is null or has another dimension.  A zero vector is at cosine distance 1."""
    if metric == "dot":
        value = -dot(vector, query)
    elif metric == "euclidean":
        value = F.sqrt(_sum(F.zip_with(vector.cast("array<double>"), _with_query(vector, query), lambda a, b: (a - b) * (a - b))))
    elif metric == "cosine":
        norm = math.sqrt(sum(float(x) ** 2 for x in query))
        own = F.sqrt(_sum(F.transform(vector.cast("array<double>"), lambda a: a * a)))
        value = F.when((own == 0) | F.lit(norm == 0), F.lit(1.0)).otherwise(1 - dot(vector, query) / (own * F.lit(norm or 1.0)))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(F.size(vector) == len(query), value)
