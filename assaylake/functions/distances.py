"""Distances of two vectors (arrays of equal size) as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column, y: Column, f) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda a, v: a + v)


def _count(x: Column, y: Column, f) -> Column:
    return _sum(x, y, lambda a, b: F.when(f(a != 0, b != 0), 1.0).otherwise(0.0))


def minkowski(x: Column, y: Column, p: float) -> Column:
    return F.pow(_sum(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(p))), F.lit(1.0 / p))


def weighted_minkowski(x: Column, y: Column, w: Sequence[float], p: float) -> Column:
    away = F.zip_with(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(list(map(float, w))), lambda d, c: F.pow(d * c, F.lit(p)))
    return F.pow(F.aggregate(away, F.lit(0.0), lambda a, v: a + v), F.lit(1.0 / p))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(x, y, lambda a, b: (a - b) * (a - b)))


def standardised_euclidean(x: Column, y: Column, variances: Sequence[float]) -> Column:
    square = F.zip_with(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(list(map(float, variances))), lambda d, v: d / v)
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda a, v: a + v))


def mahalanobis(x: Column, y: Column, inverse: Sequence[Sequence[float]]) -> Column:
    away = F.zip_with(x, y, lambda a, b: a - b)
    rows = F.transform(F.lit([list(map(float, r)) for r in inverse]), lambda r: F.aggregate(F.zip_with(away, r, lambda d, c: d * c), F.lit(0.0), lambda a, v: a + v))
    return F.sqrt(F.aggregate(F.zip_with(away, rows, lambda d, c: d * c), F.lit(0.0), lambda a, v: a + v))


def manhattan(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: F.abs(a - b))


def chebyshev(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def canberra(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: F.when(F.abs(a) + F.abs(b) > 0, F.abs(a - b) / (F.abs(a) + F.abs(b))).otherwise(0.0))


def bray_curtis(x: Column, y: Column) -> Column:
    whole = _sum(x, y, lambda a, b: F.abs(a + b))
    return F.when(whole > 0, manhattan(x, y) / whole).otherwise(0.0)


def cosine(x: Column, y: Column) -> Column:
    xx, yy = _sum(x, x, lambda a, b: a * b), _sum(y, y, lambda a, b: a * b)
    return F.when((xx == 0) & (yy == 0), 0.0).when((xx == 0) | (yy == 0), 1.0).otherwise(1.0 - _sum(x, y, lambda a, b: a * b) / F.sqrt(xx * yy))


def correlation(x: Column, y: Column) -> Column:
    n = F.size(x).cast("double")
    sx, sy = (F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n for v in (x, y))
    away = lambda v, m: F.transform(v, lambda a: a - m)
    return cosine(away(x, sx), away(y, sy))


def hamming(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)) / F.size(x)


def haversine(x: Column, y: Column) -> Column:
    """Of (latitude, longitude) in radians, on the unit sphere."""
    lat, lon = F.sin((x[0] - y[0]) / 2), F.sin((x[1] - y[1]) / 2)
    return 2.0 * F.asin(F.sqrt(lat * lat + F.cos(x[0]) * F.cos(y[0]) * lon * lon))


def binary(x: Column, y: Column) -> dict[str, Column]:
    """Distances of the vectors as sets of their non-zero places, by name. Where nothing differs all but russellrao are 0, and
    that is where every set place is common."""
    both, differ = _count(x, y, lambda a, b: a & b), _count(x, y, lambda a, b: a != b)
    one, two = _count(x, y, lambda a, b: a & ~b), _count(x, y, lambda a, b: ~a & b)
    n = F.size(x).cast("double")
    neither = n - both - differ
    ratio = lambda over: F.when(differ == 0, 0.0).otherwise(differ / over)
    return {
        "jaccard": ratio(both + differ),
        "matching": differ / n,
        "dice": ratio(2.0 * both + differ),
        "kulsinski": F.when(differ == 0, 0.0).otherwise((differ - both + n) / (differ + n)),
        "rogers_tanimoto": 2.0 * differ / (n + differ),
        "russellrao": F.when(differ == 0, 0.0).otherwise((n - both) / n),
        "sokal_michener": 2.0 * differ / (n + differ),
        "sokal_sneath": ratio(0.5 * both + differ),
        "yule": F.when((one == 0) | (two == 0), 0.0).otherwise(2.0 * one * two / (both * neither + one * two)),
    }
