"""Tail probabilities and small fits that Spark has no function for (numpy and the standard library only)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

DOUBLE = DoubleType()


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """Normal quantile: a rational start, then Newton steps on erfc."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    for _ in range(4):
        x += (norm_sf(x) - min(p, 1 - p)) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
    return x if p > 0.5 else -x


def chisq1_sf(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + k * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + k / (c if abs(c) > tiny else tiny)
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_two_sided_all(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """``t_two_sided`` of whole arrays: the same fraction, each element until it settles; NaN without degrees of freedom."""
    out = np.full(len(t), np.nan)
    some = np.flatnonzero(~np.isnan(t) & (df > 0))
    v, a, b = df[some], df[some] / 2, np.full(len(some), 0.5)
    with np.errstate(over="ignore", invalid="ignore"):
        h = t[some] ** 2
        x, rest = v / (v + h), h / (v + h)
    kinds, at = np.unique(v, return_inverse=True)
    log_beta = np.array([math.lgamma(k / 2) + math.lgamma(0.5) - math.lgamma((k + 1) / 2) for k in kinds.tolist()])[at]
    turn = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(turn, rest, x), np.where(turn, b, a), np.where(turn, a, b)
    inner = np.flatnonzero((y > 0) & (y < 1))
    got = np.where(y >= 1, 1.0, 0.0)
    z, p, q = y[inner], p[inner], q[inner]
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta[inner]) / p
        tiny = 1e-300
        f, c, d = np.ones(len(z)), np.ones(len(z)), np.zeros(len(z))
        part, left = f.copy(), np.arange(len(z))
        for i in range(400):
            if not len(left):
                break
            m = i // 2
            k = 1.0 if i == 0 else m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) if i % 2 == 0 else -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) > tiny, d, tiny)
            c = 1 + k / np.where(np.abs(c) > tiny, c, tiny)
            f = f * c * d
            part[left] = f
            going = np.full(len(left), True) if i == 0 else np.abs(1 - c * d) >= 1e-14
            if not going.all():
                left, z, p, q, f, c, d = (u[going] for u in (left, z, p, q, f, c, d))
    got[inner] = front * (part - 1)
    out[some] = np.where(turn, 1 - got, got)
    return out


def f_sf(f: float, a: float, b: float) -> float:
    return beta_cdf(b / (b + a * f), b / 2, a / 2) if f > 0 else 1.0


def f_quantile(p: float, a: float, b: float) -> float:
    """The value that F exceeds with chance 1 - p, by halving."""
    lo, hi = 0.0, 1.0
    while f_sf(hi, a, b) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f_sf(mid, a, b) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeom_sf(k: int, total: int, good: int, drawn: int) -> float:
    """Chance of k or more of the ``good`` among ``drawn`` of ``total``."""
    top = min(good, drawn)
    base = log_choose(total, drawn)
    return min(1.0, math.fsum(math.exp(log_choose(good, i) + log_choose(total - good, drawn - i) - base) for i in range(max(k, drawn + good - total, 0), top + 1)))


def binom_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Sum of the chances of outcomes no likelier than k."""
    if n == 0:
        return 1.0
    logs = np.array([log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)])
    return float(min(1.0, np.exp(logs[logs <= logs[k] + 1e-7]).sum()))


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def trigamma_inverse(y: float) -> float:
    x = 0.5 + 1 / y
    for _ in range(50):
        h = 1e-5 * x
        step = trigamma(x) * (1 - trigamma(x) / y) / ((trigamma(x + h) - trigamma(x - h)) / (2 * h))
        x += step
        if abs(step) < 1e-10 * x:
            break
    return x


@functools.lru_cache(256)
def _rank_counts(n1: int, n2: int) -> np.ndarray:
    """Ways to each U of two untied samples: the Gaussian binomial coefficient."""
    size = n1 * n2 + 1
    c = np.zeros(size)
    c[0] = 1
    for i in range(1, n1 + 1):
        step = n2 + i
        if step < size:
            c[step:] = c[step:] - c[:-step]
        for k in range(i, size):
            c[k] += c[k - i]
    return c


def rank_less(u: float, n1: int, n2: int, ties: float) -> float:
    """One-sided p that the first sample is lower: exact for eight values at most without ties, else normal with continuity correction."""
    if min(n1, n2) == 0:
        return math.nan
    if min(n1, n2) <= 8 and ties == 0:
        c = _rank_counts(min(n1, n2), max(n1, n2))
        return float(c[: int(u) + 1].sum() / c.sum())
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    return 1.0 if var <= 0 else norm_sf(-(u - n1 * n2 / 2 + 0.5) / math.sqrt(var))


def excess_het_p(hets: int, hom1: int, hom2: int) -> float:
    """Exact one-sided chance of as many heterozygotes or more, given the allele counts."""
    n, rare = hets + hom1 + hom2, 2 * min(hom1, hom2) + hets
    if n == 0:
        return 1.0
    logs = {h: math.lgamma(n + 1) - math.lgamma(h + 1) - math.lgamma((rare - h) // 2 + 1) - math.lgamma(n - h - (rare - h) // 2 + 1) + h * math.log(2) for h in range(rare % 2, rare + 1, 2)}
    top = max(logs.values())
    total = math.fsum(math.exp(v - top) for v in logs.values())
    return math.fsum(math.exp(v - top) for h, v in logs.items() if h >= hets) / total


def _each(fn, *series: pd.Series) -> pd.Series:
    def one(args):
        if any(a is None or a != a for a in args):
            return None
        return fn(*args)

    return pd.Series([one(a) for a in zip(*(s.tolist() for s in series))], dtype="float64")


@F.pandas_udf(DOUBLE)
def norm_two_sided(z: pd.Series) -> pd.Series:
    return _each(lambda a: min(1.0, 2 * norm_sf(abs(a))), z)


@F.pandas_udf(DOUBLE)
def norm_upper(z: pd.Series) -> pd.Series:
    return _each(norm_sf, z)


@F.pandas_udf(DOUBLE)
def norm_quantile(p: pd.Series) -> pd.Series:
    return _each(norm_ppf, p)


@F.pandas_udf(DOUBLE)
def chisq1_p(x: pd.Series) -> pd.Series:
    return _each(chisq1_sf, x)


@F.pandas_udf(DOUBLE)
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_all(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DOUBLE)
def f_p(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(f_sf, f, a, b)


@F.pandas_udf(DOUBLE)
def hypergeom_p(k: pd.Series, total: pd.Series, good: pd.Series, drawn: pd.Series) -> pd.Series:
    return _each(lambda *a: hypergeom_sf(*map(int, a)), k, total, good, drawn)


@F.pandas_udf(DOUBLE)
def binom_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda a, b: binom_two_sided(int(a), int(b)), k, n)


@F.pandas_udf(DOUBLE)
def rank_less_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return _each(lambda a, b, c, t: rank_less(a, int(b), int(c), t), u, n1, n2, ties)


@F.pandas_udf(DOUBLE)
def excess_het(h: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda *x: excess_het_p(*map(int, x)), h, a, b)


@F.pandas_udf(DOUBLE)
def log_gamma(x: pd.Series) -> pd.Series:
    return _each(math.lgamma, x)
