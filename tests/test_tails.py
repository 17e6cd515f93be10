"""Tail probabilities against sums of exact terms."""

import decimal
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.functions import tails

D = decimal.Decimal


def ln_factorial(k):
    if k < 30:
        return D(math.factorial(k)).ln()
    z, pi = D(k), D("3.14159265358979323846264338327950288419716939937510")
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + D(1) / (1188 * z**9)
    return z * z.ln() - z + (2 * pi * z).ln() / 2 + series


def chi_square(x, df):
    """The chance of a Poisson number below df / 2, df even."""
    decimal.getcontext().prec = 40
    half, n = D(x) / 2, df // 2
    mode = min(n - 1, int(half))
    top = float((mode * half.ln() - half - ln_factorial(mode)).exp())
    h, terms, v = float(half), [top], top
    for k in range(mode, 0, -1):
        v *= k / h
        terms.append(v)
        if v < 1e-25:
            break
    v = top
    for k in range(mode + 1, n):
        v *= h / k
        terms.append(v)
        if v < 1e-25:
            break
    return math.fsum(terms)


def student(t, df):
    """Two-sided, df even: a finite sum of positive terms."""
    cos2, term, terms = df / (df + t * t), 1.0, [1.0]
    for k in range(1, df // 2):
        term *= (2 * k - 1) / (2 * k) * cos2
        terms.append(term)
        if term < 1e-25:
            break
    return 1 - math.sqrt(1 - cos2) * math.fsum(terms)


@pytest.mark.parametrize("df", [2, 40, 1000, 10_000, 1_000_000])
def test_many_degrees(df):
    sd = math.sqrt(2 * df)
    xs = [max(0.1, df + k * sd) for k in (-5, -2, -0.3, 0, 0.01, 1, 3, 6)]
    got = tails._chi(pd.Series(xs), pd.Series([df] * len(xs)))
    assert all(abs(g - chi_square(x, df)) < 1e-9 for g, x in zip(got, xs, strict=True))
    ts = [0.01, 0.5, 1.0, 2.0, 4.0, 7.0]
    got = tails._student(pd.Series(ts), pd.Series([df] * len(ts)))
    assert all(abs(g - student(t, df)) < 1e-9 for g, t in zip(got, ts, strict=True))
    # F with 1 and df degrees is t squared; with df and 2 it is a power
    got = tails._fisher(pd.Series([t * t for t in ts]), pd.Series([1] * len(ts)), pd.Series([df] * len(ts)))
    assert all(abs(g - student(t, df)) < 1e-9 for g, t in zip(got, ts, strict=True))
    got = tails._fisher(pd.Series(ts), pd.Series([df] * len(ts)), pd.Series([2] * len(ts)))
    assert all(abs(g - (1 - math.exp(-df / 2 * math.log1p(2 / (df * f))))) < 1e-9 for g, f in zip(got, ts, strict=True))


def test_huge_degrees_and_tiny_tails():
    assert abs(tails._chi(pd.Series([1e12]), pd.Series([1e12]))[0] - 0.5) < 1e-6
    assert abs(tails._student(pd.Series([1.959963984540054]), pd.Series([1e12]))[0] - 0.05) < 1e-9
    got = tails._student(pd.Series([30.0]), pd.Series([50.0]))[0]
    assert 0 < got < 1e-30
    assert tails._chi(pd.Series([700.0]), pd.Series([2.0]))[0] == pytest.approx(math.exp(-350), rel=1e-9)


def test_edges(spark):
    rows = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (0.0, 3.0), (-1.0, 3.0), (float("inf"), 3.0), (1.0, 0.0), (1.0, None)], "x double, n double")
    got = rows.select(tails.t_two_sided(F.col("x"), F.col("n")), tails.chi_square_tail(F.col("x"), F.col("n")), tails.f_tail(F.col("x"), F.col("n"), F.col("n")), tails.normal_two_sided(F.col("x")), tails.kolmogorov_tail(F.col("x"))).collect()
    assert [tuple(r) for r in got[:2]] == [(None,) * 5] * 2
    assert tuple(got[2]) == (1.0, 1.0, 1.0, 1.0, 1.0) and got[3][1:3] == (1.0, 1.0) and tuple(got[4]) == (0.0,) * 5
    assert got[5][:3] == (None, None, None) and got[6][:3] == (None, None, None)
