"""Correlation between two per-task metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.runtime import join_per_key, prefix_sums, ship_by_value

ship_by_value(__name__)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def regularised_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(min(max(x, 0), 1))
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation over n pairs."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    return regularised_beta((n - 2) / 2, 0.5, 1 - r * r)


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([pearson_p(a, int(b)) for a, b in zip(r, n)])


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok(x) & ok(y))


def pearson(df: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """(pearson, n[, p]) over rows where both values exist."""
    row = _complete(df, x, y).agg(F.corr(x, y).alias("pearson"), F.count("*").alias("n"))
    return row.withColumn("p", _p_value("pearson", "n")) if with_p else row


def with_mid_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank by value, ties sharing their mean rank; exact for any number of rows."""
    values = df.groupBy(column).agg(F.count("*").alias("_c"))
    below = prefix_sums(values, [], [F.col(column)], {"_below": "_c"})
    ranks = below.select(column, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
    return join_per_key(df, ranks, [column])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman, n): Pearson correlation of mid-ranks."""
    ranked = with_mid_rank(with_mid_rank(_complete(df, x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))
