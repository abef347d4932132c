"""Volatility regimes with hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import block_scan, halo, in_block, owned, rows
from tidebars.operators.features import log_return
from tidebars.session import KEYS

# Regime names with their ordinals, and the two published agent mappings.
ORDINALS = {"LOW_VOLATILITY": 1, "NORMAL_VOLATILITY": 2, "HIGH_VOLATILITY": 3, "EXTREME_VOLATILITY": 4}
LOW, NORMAL, HIGH, EXTREME = ORDINALS
ROUTES_BY_CODE = {LOW: "DDPG", NORMAL: "PPO", HIGH: "A2C", EXTREME: "DQN"}
ROUTES_PROPOSED = {LOW: "DQN", NORMAL: "PPO", HIGH: "DDPG", EXTREME: "A2C"}


def classify(v: Column, m: Column, s: Column) -> Column:
    return (
        F.when((v <= 0) | (m <= 0), NORMAL)
        .when(v > m + s, EXTREME)
        .when(v > m, HIGH)
        .when(v > m - s, NORMAL)
        .otherwise(LOW)
    )


def with_volatility(series: DataFrame, lookback: int = 30, baseline: int = 252, keys=KEYS, block: int | None = None, col: str = "close", tail: int = 4) -> DataFrame:
    """``vol``, ``vol_mean``, ``vol_std`` as known before the bar, and ``raw_regime``.

    ``vol`` is the sample deviation of the last ``lookback`` log returns of earlier bars, the baseline the mean
    and deviation of the last ``baseline`` such values. Too few returns give 0, a single value deviation 0.
    """
    d = halo(series, lookback + baseline + 2 + tail, block)
    d = d.withColumn("_r", log_return(col, keys))
    d = d.withColumn("_v", F.when(F.col("i") > lookback, F.stddev_samp("_r").over(rows(1 - lookback, keys=keys))))
    w = rows(1 - baseline, keys=keys)
    d = d.withColumn("_m", F.avg("_v").over(w)).withColumn("_s", F.when(F.col("_v").isNotNull(), F.coalesce(F.stddev_samp("_v").over(w), F.lit(0.0))))
    for out, c in (("vol", "_v"), ("vol_mean", "_m"), ("vol_std", "_s")):
        d = d.withColumn(out, F.coalesce(F.lag(c).over(in_block(keys)), F.lit(0.0)))
    d = d.withColumn("raw_regime", classify(F.col("vol"), F.col("vol_mean"), F.col("vol_std")))
    return d.drop("_r", "_v", "_m", "_s")


def with_regime(series: DataFrame, lookback: int = 30, baseline: int = 252, persist: int = 3, start: int = 252, keys=KEYS, block: int | None = None) -> DataFrame:
    """Confirmed ``regime`` for bars after row ``start``.

    A raw regime is confirmed once it has held for ``persist`` bars (at least two); before the first
    confirmation the regime is NORMAL. A run of equal values needs only lags, and the regime in force is the
    last confirmed one, so no row-by-row state machine is needed.
    """
    need = max(persist, 2)
    d = with_volatility(series, lookback, baseline, keys, block, tail=need)
    same = F.col("i") - need + 1 > start
    for k in range(1, need):
        same = same & (F.col("raw_regime") == F.lag("raw_regime", k).over(in_block(keys)))
    d = owned(d.withColumn("_sure", F.when(same, F.col("raw_regime")))).where(F.col("i") > start)
    d = block_scan(d, {"regime": ("last", F.col("_sure"))}, keys, block)
    return d.withColumn("regime", F.coalesce("regime", F.lit(NORMAL))).drop("_sure")


def lookup(c: Column, mapping: dict, default=None) -> Column:
    """Value of a small fixed mapping as a literal map, with a default for unknown keys."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def agent_of(regime: Column, routes: dict[str, str], default: str = "PPO") -> Column:
    return lookup(regime, routes, default)


def ordinal_of(regime: Column) -> Column:
    return lookup(regime, ORDINALS, 2)


def distribution(df: DataFrame, keys=KEYS, col: str = "regime") -> DataFrame:
    """Bars and share of bars per regime."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys, col).agg(F.count("*").alias("bars"))
    return counts.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy(*keys)))
