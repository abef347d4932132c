"""Bar tables in storage and vendor feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timeframe", T.StringType()), T.StructField("ts", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
])
OHLCV = ["open", "high", "low", "close", "volume"]

# Timeframe names to feed intervals, and the names a feed accepts.
INTERVALS = {
    "1d": "day", "1h": "30minute", "30m": "30minute", "1m": "1minute", "1w": "week", "1M": "month",
    "day": "day", "30minute": "30minute", "1minute": "1minute", "week": "week", "month": "month",
}
MAX_REQUEST_DAYS = 365


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite", files_per_symbol: int | None = None) -> None:
    """Parquet partitioned by timeframe and symbol. Rows are spread by year as well, so a long symbol is written
    by many tasks; Spark merges small partitions at run time."""
    d = bars.select("symbol", "timeframe", "ts", *OHLCV)
    spread = [F.col("timeframe"), F.col("symbol"), F.date_trunc("year", "ts")]
    (d.repartition(files_per_symbol, *spread) if files_per_symbol else d.repartition(*spread)).write.mode(mode).partitionBy("timeframe", "symbol").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None, skip_unreadable: bool = False) -> DataFrame:
    """Scan with a fixed schema; symbol and timeframe prune folders, the time range is pushed to the files.
    Unknown symbols simply have no rows. An unreadable file fails the scan unless ``skip_unreadable`` says otherwise."""
    d = spark.read.schema(BAR_SCHEMA).option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(path)
    if symbols is not None:
        d = d.where(F.col("symbol").isin(*symbols))
    if timeframe is not None:
        d = d.where(F.col("timeframe") == timeframe)
    if start is not None:
        d = d.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        d = d.where(F.col("ts") < F.lit(end).cast("timestamp"))
    return d.select(*BAR_SCHEMA.fieldNames())


def canonical(vendor: DataFrame, timeframe: str) -> DataFrame:
    """Vendor columns in any case, extras dropped, numbers coerced (unreadable ones become NULL)."""
    d = vendor.toDF(*[c.lower() for c in vendor.columns])
    at = "timestamp" if "timestamp" in d.columns else "ts"
    return d.select(
        "symbol", F.lit(timeframe).alias("timeframe"), F.expr(f"try_cast({at} AS timestamp)").alias("ts"),
        *[F.expr(f"try_cast({c} AS double)").alias(c) for c in OHLCV if c in d.columns],
    )


CANDLES = "struct<data:struct<candles:array<array<string>>>>"


def candles(docs: DataFrame, body: str = "body", keep: Sequence[str] = ("symbol",)) -> DataFrame:
    """Positional candle arrays ``[ts, open, high, low, close, volume, open interest]`` to typed rows."""
    d = docs.select(*keep, F.explode(F.from_json(body, CANDLES)["data"]["candles"]).alias("c"))
    num = lambda k, name: F.get("c", F.lit(k)).cast("double").alias(name)
    return d.select(*keep, F.get("c", F.lit(0)).cast("timestamp").alias("ts"), *[num(k + 1, c) for k, c in enumerate([*OHLCV, "open_interest"])])


def request_ranges(spans: DataFrame, start: str = "start", end: str = "end", days: int = MAX_REQUEST_DAYS) -> DataFrame:
    """Date ranges of at most ``days`` days after their first; each begins the day after the last one ended, and
    none begins on or after the end."""
    s, e = F.col(start), F.col(end)
    starts = F.when(s < e, F.sequence(s, F.date_sub(e, 1), F.expr(f"interval {days + 1} days")))
    d = spans.withColumn("from_date", F.explode(starts))
    return d.withColumn("to_date", F.least(F.date_add("from_date", days), e))


def first_of_duplicates(chunks: Sequence[DataFrame], keys=("symbol", "ts")) -> DataFrame:
    """Union of chunks; of rows with equal keys the one from the earliest chunk stays. An aggregation, so
    duplicates are reduced before they are shuffled."""
    tagged = [c.withColumn("_chunk", F.lit(k)) for k, c in enumerate(chunks)]
    d = tagged[0]
    for t in tagged[1:]:
        d = d.unionByName(t)
    rest = [c for c in d.columns if c not in (*keys, "_chunk")]
    return d.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_chunk").alias("_r")).select(*keys, "_r.*")


def interval_of(timeframe: Column, strict: bool = False) -> Column:
    """Feed interval of a timeframe name; NULL (or an error when ``strict``) for unknown names."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv]), timeframe)
    if strict:
        return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown timeframe "), timeframe)).cast("string"))
    return known


QUOTES = "struct<data:map<string,struct<ohlc:struct<close:double>>>>"


def last_price(body: Column, key: Column) -> Column:
    """Close of ``key`` in a quote document, 0 when it is missing."""
    return F.coalesce(F.element_at(F.from_json(body, QUOTES)["data"], key)["ohlc"]["close"], F.lit(0.0))


def sane_quotes(ticks: DataFrame, keys, price: str = "ltp", sentinels=(75.0, 100.0, 220.0)) -> DataFrame:
    """Quotes that are not positive or equal a placeholder are replaced by the last good one of the series.
    ``ticks`` is indexed (i, n); the carry crosses blocks."""
    from tidebars.operators.blocks import block_scan

    ok = F.when((F.col(price) > 0) & ~F.col(price).isin(*sentinels), F.col(price))
    return block_scan(ticks, {"clean": ("last", ok)}, keys)


def gbm_bars(symbols: DataFrame, bars: int = 500, seed: str = "42", base: float = 80.0, drift: float = 0.0003, vol: float = 0.012, last_day: str = "2024-12-31") -> DataFrame:
    """Log-normal daily walk per symbol with jittered open, high and low; every number is a hash of (seed, symbol, bar)."""
    from tidebars.functions.hashing import normal, uniform
    from tidebars.operators.blocks import block_scan

    d = symbols.select("symbol", F.lit("1d").alias("timeframe"), F.explode(F.sequence(F.lit(1), F.lit(bars))).alias("i")).withColumn("n", F.lit(bars))
    z = lambda name: normal(F.concat(F.lit(f"{seed}/{name}/"), F.col("symbol")), F.col("i"))
    d = d.withColumn("ts", F.date_add(F.lit(last_day).cast("date"), F.col("i") - bars).cast("timestamp"))
    d = block_scan(d.withColumn("_r", drift + vol * z("ret")), {"_s": ("sum", F.col("_r"))}, ("symbol", "timeframe"))
    d = d.withColumn("close", base * F.exp("_s")).withColumn("open", F.col("close") * (1 + 0.0015 * z("open")))
    return d.select(
        "symbol", "timeframe", "ts", "i", "n", "open",
        (F.greatest("open", "close") * (1 + F.abs(0.003 * z("high")))).alias("high"),
        (F.least("open", "close") * (1 - F.abs(0.003 * z("low")))).alias("low"), "close",
        F.floor(500 + 4500 * uniform(F.concat(F.lit(f"{seed}/volume/"), F.col("symbol")), F.col("i"))).cast("double").alias("volume"),
    )

