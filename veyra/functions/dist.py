"""Normal and Student t distributions and the signed-rank test in plain Python, for aggregated rows."""

from __future__ import annotations

import math
from collections import Counter
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by forward recurrence with rescaling."""
    tiny, c, d = 1e-300, 1.0, 0.0
    d = 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + top * d or tiny)
            c = 1.0 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    if math.isinf(df):
        return NORMAL.cdf(t)
    tail = 0.5 * regularised_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    """By bisection."""
    if math.isinf(df):
        return NORMAL.inv_cdf(p)
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def two_sided_p(t: float, df: float) -> float:
    return 2 * t_cdf(-abs(t), df)


def wilcoxon(differences: list[float]) -> tuple[float, float]:
    """The signed-rank statistic (the smaller rank sum, zeros left out) and its two-sided p: exact up to 50 differences
    without ties, else the normal approximation with the tie correction."""
    d = [x for x in differences if x]
    if not d:
        return math.nan, math.nan
    sizes = Counter(abs(x) for x in d)
    rank, before = {}, 0
    for v, c in sorted(sizes.items()):
        rank[v], before = before + (c + 1) / 2, before + c
    plus = sum(rank[abs(x)] for x in d if x > 0)
    n = len(d)
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and len(rank) == n and n == len(differences):
        ways = [1] + [0] * (n * (n + 1) // 2)  # subsets of 1..n by their sum
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return low, min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    ties = sum(c**3 - c for c in sizes.values())
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return low, (2 * NORMAL.cdf((low - n * (n + 1) / 4) / sd) if sd else math.nan)


def _each(f):
    """f on rows of two columns; NULL or NaN gives NaN. Meant for aggregated rows: a Pandas UDF."""
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([math.nan if pd.isna(x) or pd.isna(y) else f(float(x), float(y)) for x, y in zip(a, b)], dtype=float)

    return over


def t_quantile(p: Column, df: Column) -> Column:
    return F.nanvl(F.pandas_udf(_each(t_ppf), "double")(p.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return F.nanvl(F.pandas_udf(_each(two_sided_p), "double")(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))
