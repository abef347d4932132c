"""Student's t without a statistics library."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return _beta_inc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or k < 1 else t_two_sided(x, k) for x, k in zip(t, df)], dtype="float64")


def paired_t(pairs: DataFrame, keys, a: str, b: str) -> DataFrame:
    """t and two-sided p of the mean difference per key; NULL where all differences are equal."""
    d: Column = F.col(a) - F.col(b)
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    t = F.col("_m") / (F.nullif(F.col("_s"), F.lit(0.0)) / F.sqrt("n"))
    return g.select(*keys, "n", t.alias("t")).withColumn("p", t_p_value("t", F.col("n") - 1))
