"""Step rewards of an equity table: rolling ratios, drawdown and the three reward columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import halo, in_block, owned, rows
from tidebars.operators.metrics import with_drawdown

LAMBDAS = {"drawdown": 0.5, "turnover": 1.0, "ratio": 0.1}  # fixed values
WINDOW, RF_STEP = 30, 0.05 / 252


def _guarded(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n >= 2) & (sd >= 1e-10), (mean - RF_STEP) / sd).otherwise(0.0)


def with_rolling_ratios(equity: DataFrame, keys, ret: str = "r", width: int = WINDOW, block: int | None = None) -> DataFrame:
    """``sharpe_roll`` (sample deviation) and ``sortino_roll`` (root mean square below the risk-free step)."""
    d = halo(equity, width, block)
    w = rows(1 - width, keys=keys)
    n, m = F.count(ret).over(w), F.avg(ret).over(w)
    below = F.when(F.col(ret) < RF_STEP, F.pow(F.col(ret) - RF_STEP, 2))
    d = d.withColumns({
        "sharpe_roll": _guarded(m, F.stddev_samp(ret).over(w), n),
        "sortino_roll": F.coalesce(_guarded(m, F.sqrt(F.avg(below).over(w)), n), F.lit(0.0)),
    })
    return owned(d)


def with_rewards(ledger: DataFrame, keys, capital: float = 100_000.0, block: int | None = None) -> DataFrame:
    """``reward_risk``, ``reward_pnl``, ``reward_sortino`` from ``v``, ``cost`` and ``action``."""
    d = halo(ledger, 1, block)
    w = in_block(keys)
    d = d.withColumns({"_pv": F.coalesce(F.lag("v").over(w), F.lit(capital)), "_pa": F.coalesce(F.lag("action").over(w), F.lit(0.0))})
    d = d.withColumn("dv", F.col("v") - F.col("_pv")).withColumn("r", F.col("dv") / F.greatest("_pv", F.lit(1e-8)))
    d = with_rolling_ratios(owned(d), keys, block=block)
    d = with_drawdown(d, keys, floor=F.lit(capital), block=block)
    turn = F.abs(F.col("action") - F.col("_pa")) * F.col("cost")
    lam = LAMBDAS
    return d.withColumns({
        "reward_risk": F.col("dv") - lam["drawdown"] * F.col("dd") - lam["turnover"] * turn + lam["ratio"] * F.col("sharpe_roll"),
        "reward_pnl": F.col("dv"),
        "reward_sortino": F.col("dv") + lam["ratio"] * F.col("sortino_roll"),
    }).drop("_pv", "_pa")
