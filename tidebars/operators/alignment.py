"""Several series on common timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators.blocks import index_series

LEG_KEYS = ("portfolio", "leg", "symbol")


def portfolios(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Legs: portfolio, leg (1-based), symbol, weight, q, r, stop. A literal relation, so its size is known to the planner."""
    return spark.createDataFrame(
        list(rows), "portfolio string, leg int, symbol string, leg_weight double, q double, r double"
    )


def aligned(series: DataFrame, legs: DataFrame, chunk: str = "year") -> DataFrame:
    """Bars of each portfolio's legs on the timestamps all its legs have, re-indexed."""
    d = series.drop("i", "n", "blk", "more").join(legs, "symbol")
    size = legs.groupBy("portfolio").agg(F.countDistinct("leg").alias("_k"))
    common = (
        d.groupBy("portfolio", "ts").agg(F.countDistinct("leg").alias("_have"))
        .join(size, "portfolio").where("_have = _k").select("portfolio", "ts")
    )
    return index_series(d.join(common, ["portfolio", "ts"], "left_semi"), LEG_KEYS, "ts", chunk)


def common_times(series: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Bars of the given symbols at timestamps that all of them have."""
    d = series.where(F.col("symbol").isin(*symbols))
    times = d.groupBy("ts").agg(F.countDistinct("symbol").alias("_k")).where(F.col("_k") == len(set(symbols))).select("ts")
    return d.join(times, "ts", "left_semi")


def pairwise(series: DataFrame, a: str, b: str, col: str = "close") -> DataFrame:
    """Two symbols side by side at their common timestamps."""
    left = series.where(F.col("symbol") == a).select("timeframe", "ts", F.col(col).alias(f"{col}_a"))
    right = series.where(F.col("symbol") == b).select("timeframe", "ts", F.col(col).alias(f"{col}_b"))
    return left.join(right, ["timeframe", "ts"])
