"""Report tables: month and year returns, baselines, trade statistics, range logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.features import ratio


def month_ends(equity: DataFrame, keys, value: str = "v") -> DataFrame:
    """Last value of each month, with the key's first value (``start``); months without bars have no row."""
    keys = list(keys)
    g = equity.groupBy(*keys, F.date_trunc("month", "ts").alias("month")).agg(
        F.max_by(value, "i").alias("v"), F.min(F.struct("i", F.col(value).alias("x"))).alias("_first")
    )
    w = Window.partitionBy(*keys)  # one row per month
    return g.withColumn("start", F.min("_first").over(w)["x"]).drop("_first")


def monthly_returns(equity: DataFrame, keys, value: str = "v") -> DataFrame:
    """Return on the previous month end; the first month on the first value; 0 after a value of 0."""
    w = Window.partitionBy(*keys).orderBy("month")
    m = month_ends(equity, keys, value)
    prev = F.coalesce(F.lag("v").over(w), "start")
    return m.withColumn("ret", F.coalesce(ratio(F.col("v"), prev) - 1, F.lit(0.0))).withColumn("year", F.year("month"))


def annual_returns(equity: DataFrame, keys, value: str = "v") -> DataFrame:
    """Return on the previous year end; the first year (or one after a gap) on its own first value; -1 from 0."""
    keys = list(keys)
    y = equity.groupBy(*keys, F.year("ts").alias("year")).agg(F.max_by(value, "i").alias("v"), F.min_by(value, "i").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("year")
    base = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("v").over(w)).otherwise(F.col("_first"))
    return y.withColumn("annual", F.coalesce(ratio(F.col("v"), base) - 1, F.lit(-1.0))).drop("_first")


def month_matrix(equity: DataFrame, keys, value: str = "v") -> DataFrame:
    """Year by month matrix (columns m1..m12) with the year's return; order by year descending when shown."""
    keys = list(keys)
    m = monthly_returns(equity, keys, value).withColumn("mon", F.month("month"))
    wide = m.groupBy(*keys, "year").agg(*[F.max(F.when(F.col("mon") == k, F.col("ret"))).alias(f"m{k}") for k in range(1, 13)])
    return wide.join(annual_returns(equity, keys, value).select(*keys, "year", "annual"), [*keys, "year"])


def buy_and_hold(series: DataFrame, keys, capital: float = 100_000.0, start: int = 252, lot: int | None = None) -> DataFrame:
    """Equity of a purchase at the first tradable close; with ``lot`` whole lots are bought and the rest stays cash."""
    keys = list(keys)
    first = series.where(F.col("i") == start + 1).select(*keys, F.col("close").alias("_c0"))
    qty = capital / F.col("_c0")
    if lot:
        qty = (capital / (F.col("_c0") * lot)).cast("bigint") * lot
    d = series.where(F.col("i") > start).join(first, keys)
    return d.withColumn("v", capital - qty * F.col("_c0") + qty * F.col("close")).drop("_c0")


def equal_weight_hold(legs: DataFrame, capital: float = 100_000.0, start: int = 252) -> DataFrame:
    """Equity of an equal split over a portfolio's legs, bought once."""
    keys = [c for c in ("portfolio", "leg", "symbol") if c in legs.columns]
    size = legs.where(F.col("i") == start + 1).select(*keys, F.col("close").alias("_c0"))
    d = legs.where(F.col("i") > start).join(size, keys)
    return d.groupBy("portfolio", "ts", "i").agg(
        F.max("n").alias("n"), (capital * F.sum(F.col("close") / F.col("_c0")) / F.count("*")).alias("v")
    )


def trade_totals(log: DataFrame, keys) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum("cost").alias("total_cost"), F.sum("realized_net_pnl").alias("net_pnl")
    )


def round_trips(log: DataFrame, keys) -> DataFrame:
    """Closed trades: entry bar, exit bar, duration in bars, PnL net of both costs. Windows run over trade rows only."""
    w = Window.partitionBy(*keys).orderBy("i")
    d = log.withColumns({"entry_i": F.lag("i").over(w), "entry_cost": F.lag("cost").over(w)})
    return d.where("action = 'SELL'").select(
        *keys, "entry_i", F.col("i").alias("exit_i"), (F.col("i") - F.col("entry_i")).alias("bars"),
        (F.col("realized_net_pnl") - F.col("entry_cost")).alias("pnl"),
    )


def trip_statistics(trips: DataFrame, keys, span: DataFrame, year: int = 252) -> DataFrame:
    """Win rate, profit factor, win/loss ratio, mean duration and trips per year; ``span`` has keys and n (bars)."""
    keys = list(keys)
    pnl = F.col("pnl")
    win, loss = F.when(pnl > 0, pnl), F.when(pnl <= 0, -pnl)
    g = trips.groupBy(*keys).agg(
        F.count("*").alias("trips"), F.count(win).alias("_w"), F.sum(win).alias("_sw"), F.sum(loss).alias("_sl"),
        F.avg(win).alias("_aw"), F.avg(loss).alias("_al"), F.avg("bars").alias("mean_bars"),
    )
    return g.join(span, keys).select(
        *keys, "trips", (F.col("_w") / F.col("trips")).alias("win_rate"), ratio(F.col("_sw"), F.col("_sl")).alias("profit_factor"),
        ratio(F.col("_aw"), F.col("_al")).alias("win_loss_ratio"), "mean_bars", (F.col("trips") / (F.col("n") / year)).alias("trips_per_year"),
    )


def range_log(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))
