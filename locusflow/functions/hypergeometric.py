"""Fisher's exact test and the conditional odds ratio of 2 x 2 tables.

Both sum over a window of the support, outside of which nothing adds to a double:
the distributions are those of sums of independent trials, so their variance is
at most the mean's distance from either end of the support.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Standard deviations, and places besides, that a window reaches to either side.
REACH, MORE = 40, 200


def _choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _logs(row: int, other: int, column: int, first: int, last: int) -> np.ndarray:
    """Logarithms of C(row, i) C(other, column - i) for i from first to last, less that of first."""
    i = np.arange(first, last, dtype=np.float64)
    return np.concatenate(([0.0], np.cumsum(np.log((row - i) * (column - i)) - np.log((i + 1) * (other - column + i + 1)))))


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """The hypergeometric probability of a or more; 1 if a cell is negative."""
    if min(a, b, c, d) < 0:
        return 1.0
    row, other, column = a + b, c + d, a + c
    low, high = max(0, a - d), min(row, column)
    mean = row * column / max(1, row + other)
    reach = int(REACH * math.sqrt(max(0.0, min(mean - low, high - mean)))) + MORE
    first = max(a, min(high, int(mean)) - reach)
    last = min(high, max(a, int(mean)) + reach)
    start = _choose(row, first) + _choose(other, column - first) - _choose(row + other, column)
    return min(1.0, math.fsum(np.exp(start + _logs(row, other, column, first, last))))


def odds_ratio(a: int, b: int, c: int, d: int) -> float:
    """The conditional maximum likelihood estimate: where the mean of the
    noncentral hypergeometric distribution is a, found by bisection in log space."""
    if min(a, b, c, d) < 0:
        return math.nan
    low, high = max(0, a - d), min(a + b, a + c)
    if a == low:
        return 0.0
    if a == high:
        return math.inf
    reach = int(REACH * math.sqrt(min(a - low, high - a))) + MORE
    first, last = max(low, a - reach), min(high, a + reach)
    i, logs = np.arange(first, last + 1) - a, _logs(a + b, c + d, a + c, first, last)

    def mean(theta: float) -> float:
        w = logs + i * theta
        e = np.exp(w - w.max())
        return float((i * e).sum() / e.sum())

    guess = math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    left, right = guess - 1, guess + 1
    while mean(left) > 0:
        left -= 2 * (right - left)
    while mean(right) < 0:
        right += 2 * (right - left)
    for _ in range(100):
        mid = (left + right) / 2
        if mid in (left, right):
            break
        left, right = (mid, right) if mean(mid) < 0 else (left, mid)
    return math.exp((left + right) / 2)


@F.pandas_udf(DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_greater(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(DoubleType())
def odds_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([odds_ratio(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")
