"""Tick streams and the bars they close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_SCHEMA = "symbol string, ts timestamp, tick_id bigint, px double, qty double"


def arrivals(df: DataFrame, path: str, slices: int, ts: str = "ts", close_after: float | None = None, by: str | None = None):
    """Append ``df`` to a folder in ``slices`` pieces of equal time span, yielding after each: a stream that is drained in
    between sees the data as it would have come in. Every piece is written by as many tasks as it needs.

    ``by``: a column with the time of arrival, where it is not ``ts``; it is not written. With ``close_after`` the last piece brings a row
    that holds nothing but a time, so many seconds after the last: the watermark passes all rows."""
    at = F.col(by or ts).cast("double")
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    width = (hi - lo) / slices or 1.0
    piece = F.least(F.floor((at - lo) / width), F.lit(slices - 1))
    kept = df.drop(by) if by else df
    for k in range(slices):
        df.where(piece == k).select(*kept.columns).write.mode("append").parquet(path)
        if close_after is not None and k == slices - 1:
            last = F.timestamp_seconds(F.lit(hi + close_after))
            alone = [(last if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in kept.schema]
            df.sparkSession.range(1).select(*alone).write.mode("append").parquet(path)
        yield k


def read_ticks(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """Ticks of a growing folder; a repeated (symbol, ts, tick_id) within the delay is dropped."""
    d = spark.readStream.schema(TICK_SCHEMA).parquet(path)
    return d.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts", "tick_id"])


def stream_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars of closed windows. Ticks that arrive after their window closed are dropped by the watermark."""
    at = F.struct("ts", "tick_id")
    g = ticks.groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("qty").alias("volume")
    )
    return g.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, then stop; the next call with the same checkpoint goes on from there."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
