"""Tail probabilities as column expressions. The sums run in numpy over whole Arrow batches and end where they have converged, so
that degrees of freedom may be of any size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients of Lanczos' approximation for g = 7
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# fixed values: Stirling's series, and the expansion at its centre of the correction to the normal limit of the gamma distribution
STIRLING = (1 / 12, 1 / 360, 1 / 1260, 1 / 1680, 1 / 1188)
CENTRE = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835)
#: Where a sum ends; the shape from which on the gamma distribution is taken by its normal limit with one correction, and the degrees
#: from which on Student's one is.
TINY, SHAPE, MANY = 1e-16, 1e6, 1e8

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """ln gamma(z + 1) less Stirling's first terms, z > 0."""
    out, small = np.empty_like(z), z < 16
    y = z[small]
    out[small] = _lgamma(y + 1) - (y + 0.5) * np.log(y) + y - 0.5 * math.log(2 * math.pi) if small.any() else 0.0
    y = z[~small]
    q = 1 / (y * y)
    s0, s1, s2, s3, s4 = STIRLING
    out[~small] = (s0 - (s1 - (s2 - (s3 - s4 * q) * q) * q) * q) / y
    return out


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x ln(x / m) + m - x without cancellation where x is near m."""
    v = (x - m) / (x + m)
    near = np.abs(v) < 0.1
    with np.errstate(all="ignore"):
        out = x * np.log(x / m) + m - x
    d, w, u = (x - m)[near], v[near], x[near]
    total, term = d * w, 2 * u * w
    for j in range(1, 40):
        term = term * w * w
        more = total + term / (2 * j + 1)
        if (more == total).all():
            break
        total = more
    out[near] = total
    return out


def _beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function: its continued fraction from the near end, until it has converged."""
    turn = x > (a + 1) / (a + b + 2)
    x, a, b, rest = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b), np.where(turn, x, 1 - x)
    n = a + b
    front = np.sqrt(a * b / (2 * math.pi * n)) * np.exp(_stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - _deviance(a, n * x) - _deviance(b, n * rest)) / a
    out, live = np.zeros_like(x), np.flatnonzero(x > 0)
    xs, as_, bs = x[live], a[live], b[live]
    guard = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(xs), 1 / guard(1 - n[live] * xs / (as_ + 1))
    h, m = d.copy(), 0
    while len(live):
        m += 1
        m2 = 2 * m
        aa = m * (bs - m) * xs / ((as_ + m2 - 1) * (as_ + m2))
        d, c = 1 / guard(1 + aa * d), guard(1 + aa / c)
        h = h * d * c
        aa = -(as_ + m) * (as_ + bs + m) * xs / ((as_ + m2) * (as_ + m2 + 1))
        d, c = 1 / guard(1 + aa * d), guard(1 + aa / c)
        step = d * c
        h = h * step
        done = (np.abs(step - 1) < TINY * 4) | ~np.isfinite(h)
        if done.any():
            out[live[done]] = h[done]
            live, xs, as_, bs, c, d, h = (v[~done] for v in (live, xs, as_, bs, c, d, h))
    return np.where(turn, 1 - front * out, front * out)


def _gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularised incomplete gamma function, x > 0: a series below a + 1, a continued fraction above, both until they have
    converged; for large a the normal limit with its first correction."""
    out = np.empty_like(x)
    large = a >= SHAPE
    if large.any():
        al, xl = a[large], x[large]
        half = _deviance(al, xl) / al  # mu - ln(1 + mu), half the square of the limit's variable
        mu = (xl - al) / al
        eta = np.sign(mu) * np.sqrt(2 * half)
        with np.errstate(all="ignore"):
            c0 = np.where(np.abs(eta) < 0.02, np.polyval(CENTRE[::-1], eta), 1 / mu - 1 / eta)
        out[large] = 0.5 * _erfc(eta * np.sqrt(al / 2)) + np.exp(-al * half) / np.sqrt(2 * math.pi * al) * c0
    front = np.zeros_like(x)
    rest = ~large
    front[rest] = np.exp(-_stirling_rest(a[rest]) - _deviance(a[rest], x[rest])) / np.sqrt(2 * math.pi * a[rest])
    low = rest & (x < a + 1)
    live = np.flatnonzero(low)
    total, term, k = np.ones(len(live)), np.ones(len(live)), 0
    while len(live):
        k += 1
        term = term * x[live] / (a[live] + k)
        total = total + term
        done = term < total * TINY
        if done.any():
            at = live[done]
            out[at] = 1 - front[at] * total[done]
            live, total, term = live[~done], total[~done], term[~done]
    live = np.flatnonzero(rest & ~low)
    ar, xr = a[live], x[live]
    b = xr + 1 - ar
    c, d = np.full(len(live), 1e300), 1 / b
    h, k = d.copy(), 0
    while len(live):
        k += 1
        an, b = -k * (k - ar), b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        step = d * c
        h = h * step
        done = (np.abs(step - 1) < TINY * 4) | ~np.isfinite(h)
        if done.any():
            at = live[done]
            out[at] = front[at] * a[at] * h[done]
            live, ar, b, c, d, h = (v[~done] for v in (live, ar, b, c, d, h))
    return out


def _where(ok: np.ndarray, columns: list[np.ndarray], f) -> pd.Series:
    """f of the rows that are ok; the others are null."""
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = np.clip(f(*(c[ok] for c in columns)), 0.0, 1.0)
    return pd.Series(out).astype(object).where(ok, None)


def _numbers(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(float) for c in columns]


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = _numbers(t, df)

    def tail(t, df):
        out, many, far = np.empty_like(t), df > MANY, np.isinf(t)
        m = df[many]
        out[many] = _erfc(np.abs(t[many]) * (1 - 1 / (4 * m)) / np.sqrt(1 + t[many] ** 2 / (2 * m)) / math.sqrt(2)) if many.any() else 0.0
        few = ~many & ~far
        out[few] = _beta(df[few] / (df[few] + t[few] ** 2), df[few] / 2, np.full(few.sum(), 0.5))
        out[far] = 0.0
        return out

    return _where(~np.isnan(t) & (df >= 1), [t, df], tail)


def _fisher(f: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    f, one, two = _numbers(f, one, two)
    tail = lambda f, one, two: np.where(f <= 0, 1.0, np.where(np.isinf(f), 0.0, _beta(two / (two + one * np.where(np.isinf(f), 1.0, np.maximum(f, 0.0))), two / 2, one / 2)))
    return _where(~np.isnan(f) & (one > 0) & (two > 0), [f, one, two], tail)


def _chi(x: pd.Series, df: pd.Series) -> pd.Series:
    x, df = _numbers(x, df)
    tail = lambda x, df: np.where(x <= 0, 1.0, np.where(np.isinf(x), 0.0, _gamma(df / 2, np.where((x <= 0) | np.isinf(x), df, x) / 2)))
    return _where(~np.isnan(x) & (df > 0), [x, df], tail)


def _normal(z: pd.Series) -> pd.Series:
    (z,) = _numbers(z)
    return _where(~np.isnan(z), [z], lambda z: _erfc(np.abs(z) / math.sqrt(2)))


def _kolmogorov(x: pd.Series) -> pd.Series:
    (x,) = _numbers(x)

    def tail(x):
        out, j, total = np.ones_like(x), 0, np.zeros_like(x)
        live = x >= 0.2
        while True:
            j += 1
            term = 2.0 * np.exp(-2.0 * j * j * x * x)
            total += term if j % 2 else -term
            if not (term[live] > TINY).any():
                break
        out[live] = total[live]
        return out

    return _where(~np.isnan(x), [x], tail)


def _vectorised(f, *columns: Column) -> Column:
    return F.pandas_udf(f, "double")(*(c.cast("double") for c in columns))


def ln_gamma(x: Column) -> Column:
    """ln of gamma(x), x > 0.5."""
    y = x - 1.0
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + F.lit(c) / (y + float(i))
    t = y + 7.5
    return F.lit(0.9189385332046727) + (y + 0.5) * F.ln(t) - t + F.ln(s)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's distribution; null where t is null or df is below 1."""
    return _vectorised(_student, t, df)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x) of the chi-square distribution; null where x is null or df is not positive."""
    return _vectorised(_chi, x, df)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""
    return _vectorised(_normal, z)


def f_tail(f: Column, one: Column, two: Column) -> Column:
    """P(F >= f) with one and two degrees of freedom."""
    return _vectorised(_fisher, f, one, two)


def kolmogorov_tail(x: Column) -> Column:
    """P(K >= x) of Kolmogorov's distribution; 1 below 0.2, where it differs from that by less than 10**-12."""
    return _vectorised(_kolmogorov, x)


def _shifted(x, ln):
    """x moved up by six, what the recurrence takes off for digamma and adds for trigamma, and both asymptotic series."""
    y = x + 6.0
    down = sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)
    up = sum((1.0 / ((x + float(i)) * (x + float(i))) for i in range(1, 6)), 1.0 / (x * x))
    z = 1.0 / (y * y)
    di = ln(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    tri = 1.0 / y + 0.5 * z + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))
    return di - down, tri + up


def digamma(x: Column) -> Column:
    return _shifted(x, F.ln)[0]


def trigamma(x: Column) -> Column:
    return _shifted(x, F.ln)[1]


def digamma_of(x: float) -> float:
    return _shifted(x, math.log)[0]


def trigamma_inverse(value: float) -> float:
    """x > 0 whose trigamma is value, by bisection of its logarithm: trigamma falls everywhere."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _shifted(math.exp(mid), math.log)[1] > value else (lo, mid)
    return math.exp(lo)
