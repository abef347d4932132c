"""From targets and positions to an orders table. Nothing is sent anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Discrete actions as target fractions.
ACTIONS = {0: -1.0, 1: -0.5, 2: 0.0, 3: 0.5, 4: 1.0}
MIN_TRADE = 100.0
MARGIN_SHARE = 0.95


def action_fraction(code: Column, strict: bool = True) -> Column:
    """Target fraction of a discrete action; unknown codes raise, or mean hold when not ``strict``."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), code)
    other = F.raise_error(F.concat(F.lit("invalid action "), code.cast("string"))).cast("double") if strict else F.lit(0.0)
    return F.coalesce(known, other)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def min_trade(qty: Column, price: Column, least: float = MIN_TRADE) -> Column:
    """Quantity, or 0 when the trade is worth less than ``least``."""
    return F.when(F.abs(qty) * price < least, 0.0).otherwise(qty)


def signed_positions(positions: DataFrame, key: str = "symbol") -> DataFrame:
    """Signed quantity per symbol from rows with a text quantity and a side; unreadable quantities count as 0."""
    q = F.coalesce(F.expr("try_cast(qty AS double)"), F.lit(0.0))
    return positions.groupBy(key).agg(F.sum(F.when(F.col("side") == "short", -q).otherwise(q)).alias("qty"))


def latest(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """Last value per key; reduces before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def size_orders(targets: DataFrame, positions: DataFrame, prices: DataFrame, value: float, key: str = "symbol", lot: int = 1) -> DataFrame:
    """Orders that move each symbol to ``action`` of the portfolio value, in whole lots; no order where nothing changes.

    Symbols without a position hold 0; symbols without a positive price get no order.
    """
    d = targets.join(positions, key, "left").join(prices, key, "left").where("price > 0")
    held = F.coalesce(F.col("qty"), F.lit(0)).cast("bigint")
    target = (value * F.col("action") / (F.col("price") * lot)).cast("bigint")
    diff = target - held
    return d.select(
        key, "action", "price", target.alias("target_qty"), held.alias("held_qty"),
        F.when(diff > 0, "buy").otherwise("sell").alias("side"), F.abs(diff).alias("order_qty"),
    ).where("order_qty <> 0")


def margin_scaled(signals: DataFrame, cycle: list[str], value: float, buying_power: float, share: float = 0.5) -> DataFrame:
    """Capital per symbol, scaled down where a cycle's total exceeds the margin cap. A cycle holds one row per symbol;
    totals are joined back, so a cycle with very many symbols is still summed map-side first."""
    d = signals.withColumn("required", F.col("sig") * share * value * F.col("leverage"))
    tot = d.groupBy(*cycle).agg(F.sum("required").alias("total"))
    cap = MARGIN_SHARE * buying_power
    return d.join(tot, cycle).withColumn("factor", F.when(F.col("total") > cap, cap / F.col("total")).otherwise(1.0)).withColumn(
        "scaled", F.col("required") * F.col("factor")
    )


def nearest_expiry(instruments: DataFrame, key: str) -> DataFrame:
    """Instrument with the earliest expiry per key; missing or unreadable dates come last. Ties by instrument key."""
    when = F.coalesce(F.expr("try_to_date(expiry, 'yyyy-MM-dd')"), F.lit("9999-12-31").cast("date"))
    best = F.min_by(F.struct("instrument_key", "trading_symbol", "expiry"), F.struct(when, F.col("instrument_key")))
    return instruments.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def last_rank(within: list[str], order: Column):
    return F.row_number().over(Window.partitionBy(*within).orderBy(order.desc()))
