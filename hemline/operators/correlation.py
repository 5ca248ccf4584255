"""Correlation, its p-value, and the line through a scatter."""

from __future__ import annotations

from math import erfc, exp, isnan, lgamma, log, log1p, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hemline.functions.common import ColumnLike, col

FRACTION_TERMS = 100_000


def _pairs(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    """Both values where both are there, else two nulls."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(both, x), F.when(both, y)


def pearson_r(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate: r over complete pairs; null for a constant side or no pairs."""
    x, y = _pairs(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def pearson(df: DataFrame, x: ColumnLike, y: ColumnLike) -> DataFrame:
    """One row: r and the number of complete pairs."""
    return df.agg(pearson_r(x, y).alias("r"), pair_count(x, y).alias("n"))


def pair_count(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate: number of complete pairs."""
    return F.count(_pairs(x, y)[0])


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):                   # where the fraction of the other side is the short one
        return 1 - incomplete_beta(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(FRACTION_TERMS):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        value *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (value - 1)


def p_value(r: float | None, n: int, method: str = "t") -> float | None:
    """Two-sided p of a correlation over n pairs.

    ``t`` is exact: the t distribution with n - 2 degrees of freedom (1 for two
    pairs).  ``fisher`` is the normal approximation of the Fisher transform.
    """
    if r is None or isnan(r):
        return None
    if method == "fisher":
        if n <= 3 or abs(r) >= 0.999999:
            return None
        return erfc(abs(0.5 * log((1 + r) / (1 - r))) * sqrt(n - 3) / sqrt(2.0))
    if n < 2:
        return None
    return 1.0 if n == 2 else incomplete_beta(max(0.0, 1 - r * r), (n - 2) / 2, 0.5)


def with_p_value(summary: DataFrame, r: str = "r", n: str = "n", method: str = "t") -> DataFrame:
    """Add the two-sided p to a summary of a few rows; the built-in functions have no such distribution."""
    @F.pandas_udf(DoubleType())
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(None if pd.isna(a) else a, int(b), method) for a, b in zip(r, n)], dtype="float64")

    return summary.withColumn("p", p(F.col(r), F.col(n)))


def point_biserial(df: DataFrame, flag: ColumnLike, x: ColumnLike) -> DataFrame:
    """Correlation of a yes/no column with a number; null if no rows."""
    return df.agg(pearson_r(col(flag).cast("int"), x).alias("r"))


def line_through(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    """Aggregates: slope and intercept of y on x over complete pairs; null for constant x."""
    x, y = _pairs(x, y)
    return F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")


def regression_line(df: DataFrame, x: ColumnLike, y: ColumnLike) -> DataFrame:
    return df.agg(*line_through(x, y))
