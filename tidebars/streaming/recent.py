"""The last bars of every symbol, kept in a stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebars.streaming.live import ROCKSDB

BAR = "at bigint, open double, high double, low double, close double, volume double"
NAMES = [f.strip().split(" ")[0] for f in BAR.split(",")]
OUTPUT = "symbol string, bars bigint, first_at bigint, last_at bigint"


class KeepLast(StatefulProcessor):
    def __init__(self, n: int, ttl_ms: int | None) -> None:
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", BAR, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.bars.get()), columns=NAMES)
        for pdf in rows:  # never more than n bars and one batch
            pdf = pdf[NAMES].dropna(subset=["at"])
            kept = pd.concat([kept, pdf]) if len(kept) else pdf
            kept = kept.drop_duplicates("at").sort_values("at").tail(self.n)
        if len(kept):
            self.bars.put([(int(b[0]), *(None if pd.isna(x) else float(x) for x in b[1:])) for b in kept.itertuples(index=False)])
            yield pd.DataFrame([(key[0], len(kept), int(kept["at"].iloc[0]), int(kept["at"].iloc[-1]))], columns=["symbol", "bars", "first_at", "last_at"])

    def close(self) -> None:
        pass


def keep_last(bars: DataFrame, n: int, ttl_ms: int | None = None) -> DataFrame:
    """Keep the ``n`` latest bars of every symbol, in whatever order they arrive; a bar that is there already is not replaced.

    The stream says after each batch how many bars a symbol has and from when to when. With ``ttl_ms`` the bars of a symbol without
    new ones are removed that long after its last batch.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = bars.select("symbol", F.unix_micros("ts").alias("at"), *NAMES[1:])
    d = d.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=KeepLast(n, ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
    return d.select("symbol", "bars", F.timestamp_micros("first_at").alias("first_ts"), F.timestamp_micros("last_at").alias("last_ts"))


def last_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bars that the state of ``keep_last`` holds after its last batch."""
    d = spark.read.format("statestore").option("stateVarName", "bars").load(checkpoint)
    return d.select(F.col("key.symbol").alias("symbol"), F.timestamp_micros("list_element.at").alias("ts"), *[F.col(f"list_element.{c}").alias(c) for c in NAMES[1:]])
