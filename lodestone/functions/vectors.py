"""Vector functions as columns: products and distances accumulate in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def check_metric(metric: str) -> str:
    """The metric's name; cosine is inner product, and nothing is normalised for the caller."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    return "ip" if metric == "cosine" else metric


def _d(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_sq(a: Column, b: Column) -> Column:
    """The squared distance."""
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def norm2(v: Column) -> Column:
    return dot(v, v)


def distance(metric: str, a: Column, b: Column) -> Column:
    return l2_sq(a, b) if check_metric(metric) == "l2" else 1 - dot(a, b)


def normalize(v: Column, single: bool = False) -> Column:
    """Unit length; a zero vector stays zero. single: rounded to 32-bit floats at the end."""
    out = F.transform(_d(v), lambda x: x / F.greatest(F.sqrt(norm2(v)), F.lit(1e-12)))
    return out.cast("array<float>") if single else out
