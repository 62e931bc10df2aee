"""Upper tail probabilities, evaluated by Arrow-batched helpers on result rows only (a handful each)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), na_action="ignore").astype("float64")


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            return front * h
        if i > 10000:
            return math.nan  # not settled: no value rather than a wrong one


@F.pandas_udf(DoubleType())
def chi2_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    def one(s: float, k: float) -> float:
        return float("nan") if pd.isna(s) or k < 1 else _upper_gamma(k / 2.0, s / 2.0)

    return pd.Series([one(s, k) for s, k in zip(stat, dof)], dtype="float64")


#: Up to this many values on one side, and without ties, the rank sum's own distribution is used.
SMALL_SIDE = 8


def rank_sum_counts(m: int, n: int) -> list[int]:
    """Orders of m + n different values by the number of pairs (one of m above one of n), from 0 to m * n pairs.

    The generating function is a product over i of (1 - x^(n + i)) / (1 - x^i), taken in one factor at a time.
    """
    m, n = min(m, n), max(m, n)
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            counts[u] -= counts[u - n - i]
        for u in range(i, m * n + 1):
            counts[u] += counts[u - i]
    return counts


@F.pandas_udf(DoubleType())
def rank_sum_tail(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    """P(U >= u): exact for a small side without ties, else by the normal deviate z."""

    def one(at: float, m: float, n: float, tied: float, deviate: float) -> float:
        if min(m, n) > SMALL_SIDE or tied:
            return float("nan") if pd.isna(deviate) else 0.5 * math.erfc(deviate / math.sqrt(2.0))
        counts = rank_sum_counts(int(m), int(n))
        return sum(counts[math.ceil(at):]) / sum(counts)

    return pd.Series([one(*row) for row in zip(u, n1, n2, ties, z)], dtype="float64")
