"""Statistics shared by the callers: BH adjustment, tail probabilities, test statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def bh_adjust(d: DataFrame, p: str, out: str = "q", by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """d with Benjamini-Hochberg q-values of column p within groups `by`; null p stay null and do not count.

    One window sorts a group; a group is a set of tested hypotheses (peaks, boundaries), not raw data.
    """
    by = by or []
    has = F.col(p).isNotNull()
    asc = Window.partitionBy(*by, has).orderBy(F.col(p))
    ranked = F.col(p) * F.count(p).over(Window.partitionBy(*by, has)) / F.count(p).over(asc.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__bh", ranked)
    rest = Window.partitionBy(*by, has).orderBy(F.col(p)).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return d.withColumn(out, F.when(has, F.least(F.lit(1.0), F.min("__bh").over(rest)))).drop("__bh")


def _distinct(f, *columns: pd.Series) -> pd.Series:
    """f of each row of columns, found once for rows that are equal; null where a column is."""
    rows = np.stack([c.to_numpy(float) for c in columns], 1)
    out = np.full(len(rows), np.nan)
    ok = ~np.isnan(rows).any(1)
    if ok.any():
        each, back = np.unique(rows[ok], axis=0, return_inverse=True)
        out[ok] = np.array([f(*r) for r in each.tolist()])[back.ravel()]
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|) of a standard normal."""
    return _distinct(lambda x: math.erfc(abs(x) / math.sqrt(2)), z)


def poisson_upper(k: float, mean: float) -> float:
    """P(X > floor(k)) of a Poisson variable."""
    n = math.floor(k)
    if n < 0:
        return 1.0
    if mean <= 0:
        return 0.0
    if n + 1 > mean:  # the tail itself, from its largest term
        term, total, i = math.exp(-mean + (n + 1) * math.log(mean) - math.lgamma(n + 2)), 0.0, n + 1
        while term > total * 1e-17 and term > 0:
            total += term
            i += 1
            term *= mean / i
        return min(1.0, total)
    logs = np.arange(n + 1)
    terms = -mean + logs * math.log(mean) - np.array([math.lgamma(i + 1) for i in logs])
    return max(0.0, 1.0 - float(np.exp(terms).sum()))


@F.pandas_udf(DoubleType())
def poisson_tail(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X > floor(k)) of a Poisson variable."""
    return _distinct(poisson_upper, k, mean)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, f = 1e-300, 1.0, 1.0
    dd = 1 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    f = dd
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            dd = 1 + num * dd
            dd = 1 / (dd if abs(dd) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * dd
        if abs(c * dd - 1) < 1e-15:
            break
    return front * f


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) of Student's t."""
    return _distinct(lambda x, n: incomplete_beta(n / 2, 0.5, n / (n + x * x)) if n > 0 else math.nan, t, df)


def one_proportion_z(count: Column, total: Column, p0: Column) -> Column:
    """z of count in total trials against p0; null where count or the rest is 0, or an expectation is below 5.

    Below 30 the deviation loses its sign and half a count.
    """
    e1, e2 = total * p0, total * (1 - p0)
    sd = F.sqrt(total * p0 * (1 - p0))
    z = F.when((e1 >= 30) & (e2 >= 30), (count - e1) / sd).otherwise((F.abs(count - e1) - 0.5) / sd)
    return F.when((count > 0) & (total > count) & (F.least(e1, e2) >= 5), z)


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    p = (x1 + x2) / (n1 + n2)
    return (x1 / n1 - x2 / n2) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
