"""Tail probabilities and tests on figures that the cluster has aggregated; all run on the driver, on a few numbers."""

from __future__ import annotations

import math
from statistics import NormalDist


def _gamma_tail(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function: a series for small x, else a continued fraction (Lentz)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta(x: float, a: float, b: float) -> float:
    """I_x(a, b), the regularised incomplete beta function, by a continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: int) -> float:
    return _gamma_tail(df / 2, x / 2)


def f_tail(f: float, d1: float, d2: float) -> float:
    return _beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return _beta(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def chi2_test(table: list[list[float]]) -> tuple[float, float, int, float]:
    """(statistic, p, degrees of freedom, Cramér's V); rows and columns of zeros are left out; one degree of freedom is corrected."""
    table = [r for r in table if sum(r)]
    keep = [j for j in range(len(table[0]) if table else 0) if sum(r[j] for r in table)]
    table = [[r[j] for j in keep] for r in table]
    if len(table) < 2 or len(keep) < 2:
        return math.nan, math.nan, 0, math.nan
    rows, cols = [sum(r) for r in table], [sum(r[j] for r in table) for j in range(len(keep))]
    n, df = sum(rows), (len(rows) - 1) * (len(cols) - 1)
    x = 0.0
    for i, r in enumerate(table):
        for j, o in enumerate(r):
            e = rows[i] * cols[j] / n
            gap = abs(o - e)
            gap -= min(0.5, gap) if df == 1 else 0
            x += gap * gap / e
    return x, chi2_tail(x, df), df, math.sqrt(x / (n * (min(len(rows), len(cols)) - 1)))


def significance(p: float) -> str:
    return "p < 0.001" if p < 0.001 else "p < 0.01" if p < 0.01 else "p < 0.05" if p < 0.05 else "non significatif"


def strength(v: float) -> str:
    return "forte" if v >= 0.5 else "modérée" if v >= 0.3 else "faible" if v >= 0.1 else "négligeable"


def anova(groups: list[tuple[int, float, float]]) -> tuple[float, float]:
    """(F, p) of groups given as (n, mean, sample variance)."""
    n, k = sum(g[0] for g in groups), len(groups)
    mean = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - mean) ** 2 for g in groups) / (k - 1)
    within = sum((g[0] - 1) * (g[2] or 0.0) for g in groups) / (n - k)
    f = between / within if within else math.inf
    return f, f_tail(f, k - 1, n - k) if within else 0.0


def kruskal(groups: list[tuple[int, float]], ties: float) -> tuple[float, float]:
    """(H, p) of groups given as (n, sum of average ranks); ``ties``: the sum of t**3 - t over groups of equal values."""
    n = sum(g[0] for g in groups)
    h = 12 / (n * (n + 1)) * sum(s * s / g for g, s in groups) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return h, chi2_tail(h, len(groups) - 1)


def dagostino(n: int, skew: float, kurt: float) -> tuple[float, float]:
    """D'Agostino and Pearson's test from population skewness and excess kurtosis."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    delta, alpha = 1 / math.sqrt(0.5 * math.log(w2)), math.sqrt(2.0 / (w2 - 1))
    y = y if y else 1.0
    z1 = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / math.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / b1 * (2.0 / b1 + math.sqrt(1 + 4.0 / (b1 * b1)))
    d = 1 + x * math.sqrt(2 / (a - 4.0))
    z2 = (1 - 2 / (9.0 * a) - math.copysign(((1 - 2.0 / a) / abs(d)) ** (1 / 3), d)) / math.sqrt(2 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, chi2_tail(k2, 2)


def shapiro(values: list[float]) -> tuple[float, float]:
    """Shapiro and Wilk's W and p by Royston's approximation of 1995; 3 to 5000 values."""
    x = sorted(values)
    n = len(x)
    norm = NormalDist()
    m = [norm.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        an = m[-1] / math.sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        if n <= 5:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a = [-an, *(v / math.sqrt(phi) for v in m[1:-1]), an]
        else:
            an1 = m[-2] / math.sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
            a = [-an, -an1, *(v / math.sqrt(phi) for v in m[2:-2]), an1, an]
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    if ss == 0:
        return 1.0, 1.0
    w = min(1.0, sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / ss)
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if math.log(1 - w) >= g:
            return w, 1e-99
        mu, sigma = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        z = (-math.log(g - math.log(1 - w)) - mu) / sigma
    else:
        ln = math.log(n)
        mu, sigma = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3, math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
        z = (math.log(1 - w) - mu) / sigma if w < 1 else -10.0
    return w, 1 - norm.cdf(z)
