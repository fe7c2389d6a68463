"""Dense-vector expressions on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def linear_score(vec: str, weights: dict[int, float], intercept: float = 0.0) -> Column:
    """sigmoid(w.x + b). Few weights unroll into generated code, many go through one array fold."""
    if len(weights) <= 64:
        terms = [F.col(vec)[i].cast("double") * F.lit(w) for i, w in sorted(weights.items())]
        z = terms[0]
        for t in terms[1:]:
            z = z + t
    else:
        dense = [float(weights.get(i, 0.0)) for i in range(max(weights) + 1)]
        z = dot(as_double(vec), F.array(*[F.lit(w) for w in dense]))
    if intercept:
        z = z + F.lit(float(intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def interval_z(confidence: float) -> float:
    """Two-sided normal quantile, e.g. 1.2816 for 0.8."""
    from statistics import NormalDist

    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    return math.fabs(NormalDist().inv_cdf((1 + confidence) / 2))
