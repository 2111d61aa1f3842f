"""Distances of a vector or sketch to centers, as columns. Centers: list of (c, support), literals of the plan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(c: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in c])


def norm_sq(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def inner_product(idx: Column, val: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(idx, val, lambda j, v: v * F.get(c, j)), F.lit(0.0), lambda a, v: a + v)


def dense(x: Column, c: Column) -> Column:
    """Squared distance of full vectors."""
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)


def with_beta(x: Column, c: Column, beta: float) -> Column:
    """x^2 - 2 beta x c + c^2, summed and clipped at 0."""
    each = F.zip_with(x, c, lambda a, b: a * a - F.lit(2.0 * beta) * a * b + b * b)
    return F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, v: s + v))
