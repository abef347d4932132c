"""Crossover and momentum signals over config lists.

A *strategy* is a function from a feature frame to (series keys, ts, i, n, config_id, close, sig, prev_sig): ``sig`` is the
position wanted on the bar, known from earlier bars only; ``prev_sig`` the one wanted on the bar before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import halo, in_block, owned, rows
from tidebars.operators.features import sma
from tidebars.session import KEYS

START = 252  # rows before the first tradable bar


@dataclass(frozen=True)
class Config:
    """One ledger configuration; costs in basis points, stop as a fraction (None: no stop)."""

    config_id: str
    fast: int = 15
    slow: int = 80
    leverage: float = 1.0
    stop: float | None = None
    buy_bps: float = 5.0
    sell_bps: float = 15.0
    weight: float = 1.0
    only_leg: int = 0  # 0: every leg of a portfolio


_TYPES = {"config_id": "string", "fast": "int", "slow": "int", "only_leg": "int"}


def config_array(configs: Sequence[Config]) -> Column:
    """The list as an array literal: a row is multiplied in place, no join is planned."""
    return F.array(*[
        F.struct(*[F.lit(getattr(c, f.name)).cast(_TYPES.get(f.name, "double")).alias(f.name) for f in fields(Config)])
        for c in configs
    ])


def with_configs(df: DataFrame, configs: Sequence[Config]) -> DataFrame:
    d = df.withColumn("_cfg", F.explode(config_array(configs))).select("*", "_cfg.*").drop("_cfg")
    if "leg" in df.columns:
        d = d.where((F.col("only_leg") == 0) | (F.col("only_leg") == F.col("leg")))
    return d.drop("only_leg")


# The ten-pair sweep and the fee table (buy, sell bps; a quarter and three quarters of the round trip).
SMA_GRID = [(5, 30), (5, 60), (10, 30), (10, 50), (15, 60), (15, 100), (20, 80), (2, 40), (8, 40), (12, 120)]
FEES = {"10 bps": (2.5, 7.5), "20 bps": (5.0, 15.0), "30 bps": (7.5, 22.5), "50 bps": (12.5, 37.5)}


def sma_grid(leverage: float = 1.0, **kw) -> list[Config]:
    return [Config(f"sma_{f}_{s}", f, s, leverage, **kw) for f, s in SMA_GRID]


def fee_grid(fast: int, slow: int, leverage: float = 1.0, stop: float | None = None) -> list[Config]:
    return [Config(k, fast, slow, leverage, stop, b, s) for k, (b, s) in FEES.items()]


def crossover(series: DataFrame, configs: Sequence[Config], price: str = "close", start: int = START, keys=KEYS, keep: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Fast over slow mean of the bars before each bar. Each distinct width is averaged once per bar; the
    config list multiplies the rows afterwards."""
    widths = sorted({w for c in configs for w in (c.fast, c.slow)})
    d = halo(series, max(widths) + 2, block)
    w = in_block(keys)
    d = d.select("*", *[sma(price, k, keys, 1).alias(f"_s{k}") for k in widths])
    d = d.select("*", *[F.lag(f"_s{k}").over(w).alias(f"_p{k}") for k in widths], F.lag("close").over(w).alias("prev_close"))
    means = [f"{side}{k}" for side in ("_s", "_p") for k in widths]
    d = owned(d.select(*keys, "ts", "i", "n", "blk", "more", "_run", "_own", "close", "prev_close", *keep, *means))
    d = with_configs(d, configs)

    def mean(side: str, field: str) -> Column:
        return F.coalesce(*[F.when(F.col(field) == k, F.col(f"{side}{k}")) for k in widths])

    def above(side: str, first: int) -> Column:
        on = (F.col("i") > first) & (mean(side, "fast") > mean(side, "slow"))
        return F.coalesce(on.cast("double"), F.lit(0.0))

    return d.withColumn("sig", above("_s", start)).withColumn("prev_sig", above("_p", start + 1)).drop(*means)


def momentum(series: DataFrame, configs: Sequence[Config], width: int = 252, start: int = START, keys=KEYS, block: int | None = None) -> DataFrame:
    """Close above its ``width``-bar mean on the bar before."""
    d = halo(series, width + 3, block)
    w = in_block(keys)
    d = d.withColumn("_on", F.coalesce((F.col("close") > sma("close", width, keys)).cast("double"), F.lit(0.0)))
    d = d.withColumn("prev_close", F.lag("close").over(w))
    lag1, lag2 = F.lag("_on", 1, 0.0).over(w), F.lag("_on", 2, 0.0).over(w)
    d = d.withColumn("sig", F.when(F.col("i") > start, lag1).otherwise(0.0))
    d = d.withColumn("prev_sig", F.when(F.col("i") > start + 1, lag2).otherwise(0.0))
    return with_configs(owned(d).select(*keys, "ts", "i", "n", "blk", "more", "_run", "close", "prev_close", "sig", "prev_sig"), configs)


def month_starts(series: DataFrame, start: int = START, keys=KEYS, block: int | None = None) -> DataFrame:
    """``rebalance``: the first tradable bar and every first bar of a month after it."""
    d = halo(series, 1, block)
    m = F.month("ts")
    change = (m != F.lag(m).over(in_block(keys))) | (F.col("i") == start + 1)
    return owned(d.withColumn("rebalance", F.coalesce(change, F.lit(True)) & (F.col("i") > start)))


def trend_policy(price: str = "close", fast: int = 10, slow: int = 30, keys=KEYS) -> Column:
    """+1 while the fast mean is above the slow one, otherwise -1; inside a ``halo`` frame."""
    up = F.avg(price).over(rows(1 - fast, keys=keys)) > F.avg(price).over(rows(1 - slow, keys=keys))
    return F.when(up, 1.0).otherwise(-1.0)


# Size of the trend position per agent label.
AGENT_SIZE = {"DQN": 0.5, "PPO": 0.95, "DDPG": 0.75, "A2C": 0.8}
