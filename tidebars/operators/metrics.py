"""Performance metrics of equity curves and return series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import block_scan, halo, in_block, owned
from tidebars.operators.features import ratio

RISK_FREE = 0.05
YEAR = 252


def with_returns(equity: DataFrame, keys, value: str = "v", out: str = "r", block: int | None = None) -> DataFrame:
    """Return on the previous bar; 0 on the first bar and after a value of 0."""
    d = halo(equity, 1, block)
    prev = F.lag(value).over(in_block(keys))
    return owned(d.withColumn(out, F.coalesce(ratio(F.col(value), prev) - 1, F.lit(0.0))))


def with_drawdown(equity: DataFrame, keys, value: str = "v", floor: Column | None = None, block: int | None = None) -> DataFrame:
    """``peak`` and ``dd``, the fraction below the running peak (never below ``floor`` if given)."""
    d = block_scan(equity, {"peak": ("max", F.col(value))}, keys, block)
    if floor is not None:
        d = d.withColumn("peak", F.greatest("peak", floor))
    return d.withColumn("dd", F.greatest(F.coalesce(1 - ratio(F.col(value), F.col("peak")), F.lit(0.0)), F.lit(0.0)))


def performance(equity: DataFrame, keys, value: str = "v", rf: float = RISK_FREE, year: int = YEAR, calendar: bool = True, block: int | None = None) -> DataFrame:
    """One row of metrics per key from a curve with ``ts``, ``i``, ``n``.

    ``calendar`` takes years from the span of ``ts`` (at least one bar's worth); otherwise from the bar count.
    Drawdown is reported as a negative number.
    """
    return performance_of(with_drawdown(with_returns(equity, keys, value, block=block), keys, value, block=block), keys, rf, year, calendar)


def performance_of(df: DataFrame, keys, rf: float = RISK_FREE, year: int = YEAR, calendar: bool = True) -> DataFrame:
    r, rf_d = F.coalesce(F.col("r"), F.lit(0.0)), math.pow(1 + rf, 1 / year) - 1
    g = df.groupBy(*keys).agg(
        F.count("*").alias("bars"),
        (F.product(1 + r) - 1).alias("cum_return"),
        F.avg(r).alias("_m"),
        F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_dsd"),
        F.max("dd").alias("_dd"),
        F.datediff(F.max("ts"), F.min("ts")).alias("_days"),
    )
    years = F.greatest(F.col("_days") / 365.25, F.lit(1 / year)) if calendar else F.col("bars") / year
    cum = F.col("cum_return")
    g = g.withColumn("ann_return", F.when(cum <= -1, -1.0).otherwise(F.pow(1 + cum, 1 / years) - 1))
    root = math.sqrt(year)

    def per(sd: str) -> Column:
        return F.coalesce(ratio((F.col("_m") - rf_d) * root, F.col(sd)), F.lit(0.0))

    return g.select(
        *keys, "bars", "cum_return", "ann_return",
        F.coalesce(F.col("_sd") * root, F.lit(0.0)).alias("ann_vol"),
        per("_sd").alias("sharpe"),
        per("_dsd").alias("sortino"),
        (-F.col("_dd")).alias("max_drawdown"),
        F.coalesce(ratio(F.col("ann_return"), F.col("_dd")), F.lit(0.0)).alias("calmar"),
    )


METRICS = ["cum_return", "ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar"]


def zero_if_missing(wanted: DataFrame, metrics: DataFrame, keys) -> DataFrame:
    """Every wanted key with its metrics, zeros where a key has no bars."""
    keys = list(keys)
    return wanted.join(metrics, keys, "left").select(
        *keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in metrics.columns if c not in keys]
    )


def versus(metrics: DataFrame, benchmark: DataFrame, keys, names=METRICS) -> DataFrame:
    """Long table of strategy, benchmark and difference per metric."""
    def tall(df, out):
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(out)) for c in names])).alias("m")).select(*keys, "m.*")

    return tall(metrics, "strategy").join(tall(benchmark, "benchmark"), [*keys, "metric"]).withColumn("diff", F.col("strategy") - F.col("benchmark"))


def ranked(metrics: DataFrame, by: str = "sharpe", tie: str = "config_id", within=("symbol",)) -> DataFrame:
    """Rank the configs of each group by a metric, best first. A group holds one row per config, so its size
    is that of the config list, never that of the bars."""
    from pyspark.sql import Window

    return metrics.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), tie)))
