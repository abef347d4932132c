"""The study of which agent label should act in which volatility regime."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators import regime as rg
from tidebars.operators.alignment import LEG_KEYS
from tidebars.operators.blocks import halo, owned
from tidebars.operators.features import sma
from tidebars.operators.signals import AGENT_SIZE, START

# Volatility targets and trailing stops per agent label, by leg, with the stop of unknown labels.
TARGET_VOL = {1: 0.006, 2: 0.015}
AGENT_STOPS = {1: {"DQN": 0.015, "A2C": 0.02, "DDPG": 0.03, "PPO": 0.05}, 2: {"DQN": 0.008, "A2C": 0.01, "DDPG": 0.015, "PPO": 0.02}}
DEFAULT_STOP = {1: 0.05, 2: 0.02}


def inverse_vol_weight(within=("portfolio", "ts")) -> Column:
    """Share of 1/vol among a portfolio's legs at one time; equal shares where a vol is 0."""
    w = Window.partitionBy(*within)  # one row per leg
    inv = 1 / F.nullif(F.col("vol"), F.lit(0.0))
    return F.when(F.min("vol").over(w) > 0, inv / F.sum(inv).over(w)).otherwise(1 / F.count("*").over(w))


def vol_target_leverage(top: float = 5.0) -> Column:
    target = rg.lookup(F.col("leg"), TARGET_VOL)
    lev = F.least(F.lit(top), F.greatest(F.lit(1.0), top * target / F.nullif(F.col("vol"), F.lit(0.0))))
    return F.when(F.col("vol") > 0, lev).otherwise(top)


def agent_stop(agent: Column, leg: Column) -> Column:
    one, two = (rg.lookup(agent, AGENT_STOPS[k], DEFAULT_STOP[k]) for k in (1, 2))
    return F.when(leg == 1, one).otherwise(two)


def mappings() -> Column:
    """All assignments of the four labels to the four regimes, as an array of (config_id, routes)."""
    made = []
    for perm in permutations(AGENT_SIZE):
        pairs = [F.lit(x) for kv in zip(rg.ORDINALS, perm) for x in kv]
        made.append(F.struct(F.lit("|".join(perm)).alias("config_id"), F.create_map(*pairs).alias("routes")))
    return F.array(*made)


def with_mappings(df: DataFrame) -> DataFrame:
    return df.withColumn("_m", F.explode(mappings())).select("*", "_m.config_id", F.element_at("_m.routes", F.col("regime")).alias("agent")).drop("_m")


def routed_legs(legs: DataFrame, fast: int = 10, slow: int = 30, block: int | None = None) -> DataFrame:
    """Bars of every leg under every mapping: sig, size (weight x leverage) and stop. The trend uses earlier bars only."""
    d = halo(legs, slow + 1, block)
    d = owned(d.withColumn("trend", F.when(sma("close", fast, LEG_KEYS, 1) > sma("close", slow, LEG_KEYS, 1), 1.0).otherwise(-1.0)))
    d = rg.with_regime(d, keys=LEG_KEYS, start=START, block=block)
    d = d.withColumn("size", inverse_vol_weight() * vol_target_leverage())
    d = with_mappings(d)
    return d.withColumns({"sig": rg.lookup(F.col("agent"), AGENT_SIZE) * F.col("trend"), "stop": agent_stop(F.col("agent"), F.col("leg"))})


def wide_legs(d: DataFrame, keys=("portfolio", "config_id"), buy: float = 0.0005, sell: float = 0.0015) -> DataFrame:
    leg = F.struct("leg", F.col("close").alias("price"), "sig", "size", "stop")
    g = d.groupBy(*keys, "i").agg(F.max("ts").alias("ts"), F.max("n").alias("n"), F.array_sort(F.collect_list(leg)).alias("_l"))
    return g.select(*keys, "i", "ts", "n", F.lit(buy).alias("b"), F.lit(sell).alias("s"), *[F.col(f"_l.{c}").alias(c) for c in ("price", "sig", "size", "stop")])
