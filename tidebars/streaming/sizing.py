"""Signals of each micro-batch to orders, with a state table of every symbol's signal and holding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators.orders import MARGIN_SHARE
from tidebars.session import cut

STATE = "symbol string, ts timestamp, close double, sig double, held bigint"


def batch_orders(signals: DataFrame, state: DataFrame, value: float, buying_power: float, leverage: float = 5.0, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Orders of a micro-batch and the state after it.

    The latest bar of each symbol counts, unless it is no later than the one in ``state``. Margin is scaled over all symbols, also those that have
    no bar in the batch. An order is the difference from the holding and is made only when the signal changes.
    """
    last = signals.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "sig"), "ts").alias("x"), F.count("*").alias("bars"))
    d = state.select("symbol", F.struct("ts", "close", "sig", "held").alias("o")).join(last, "symbol", "full")
    fresh = F.col("x").isNotNull() & (F.col("o").isNull() | (F.col("x.ts") > F.col("o.ts")))
    was, held = F.coalesce("o.sig", F.lit(0.0)), F.coalesce("o.held", F.lit(0).cast("bigint"))
    now = {c: F.when(fresh, F.col(f"x.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("ts", "close", "sig")}
    d = cut(d.select("symbol", *now.values(), held.alias("held"), (fresh & (now["sig"] != was)).alias("changed"), F.coalesce("bars", F.lit(0)).alias("bars")))
    required = F.col("sig") * share * value * leverage
    total = d.agg(F.sum(required)).first()[0] or 0.0  # one number
    cap = MARGIN_SHARE * buying_power
    factor = cap / total if total > cap else 1.0
    target = F.when(F.col("sig") > 0, (required * factor / F.col("close")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    d = d.withColumns({"factor": F.lit(factor), "target_qty": target}).withColumn("order_qty", F.when(F.col("changed"), F.col("target_qty") - F.col("held")).otherwise(F.lit(0).cast("bigint")))
    orders = d.where("order_qty <> 0").select(
        "symbol", "ts", "close", "sig", "bars", "factor", "target_qty", F.col("held").alias("held_qty"), F.when(F.col("order_qty") > 0, "buy").otherwise("sell").alias("side"), F.abs("order_qty").alias("order_qty"))
    return orders, d.select("symbol", "ts", "close", "sig", (F.col("held") + F.col("order_qty")).alias("held"))


def write_orders(stream: DataFrame, path: str, checkpoint: str, value: float, buying_power: float, **kw):
    """Append every micro-batch's orders. A batch reads the state that the one before it wrote, and both results lie in folders named by the
    batch, so a repeated batch overwrites itself with the same rows."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(f"{path}-state/{batch_id - 1}") if batch_id else spark.createDataFrame([], STATE)
        orders, after = batch_orders(batch, before, value, buying_power, **kw)
        orders.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}-state/{batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
