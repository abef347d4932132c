"""Tick tables and the bars built from them.

A tick table has symbol, timeframe, ts, part (coarse order inside a bar, below 2**31), order columns, inc (integer price
step) and qty. The price of a tick is ``100*exp(scale * running sum of inc)``: integer steps add up to the
same total in any order, so bars do not depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.operators.blocks import index_series
from tidebars.session import KEYS, cut

PART_KEYS = 1_000_000  # order keys that share one part of a bar
EVENT_ORDER = ["at", "event_id"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_ticks(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag", part_keys: int = PART_KEYS) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col(symbol).cast("string").alias("symbol"),
        F.lit("1d").alias("timeframe"),
        F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.expr(f"l_orderkey div {part_keys}").alias("part"),
        *LINE_ORDER,
        (F.round(F.col("l_discount") * 100).cast("bigint") - 5).alias("inc"),
        F.col("l_quantity").alias("qty"),
    )


def event_ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    ev = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return ev.select(
        F.col(symbol).cast("string").alias("symbol"),
        F.lit("1h").alias("timeframe"),
        F.date_trunc("hour", at).alias("ts"),
        F.minute(at).cast("bigint").alias("part"),
        at.alias("at"), "event_id",
        (F.round(F.col("value") * 100).cast("bigint") - 5000).alias("inc"),
        F.lit(1.0).alias("qty"),
    )


def priced(ticks: DataFrame, scale: float, order: list[str]) -> DataFrame:
    """Add ``px`` and ``rn``. The running sum is taken in three levels, (bar, part) then bar then series, so
    that neither a busy symbol nor a busy bar ends up in one task."""
    keys = list(KEYS)
    per_part = ticks.groupBy(*keys, "ts", "part").agg(F.sum("inc").alias("_s"))
    in_bar = Window.partitionBy(*keys, "ts").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_series = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    per_bar = per_part.groupBy(*keys, "ts").agg(F.sum("_s").alias("_b")).select(
        *keys, "ts", F.coalesce(F.sum("_b").over(in_series), F.lit(0)).alias("_cb")
    )
    carry = (
        per_part.select(*keys, "ts", "part", F.coalesce(F.sum("_s").over(in_bar), F.lit(0)).alias("_cp"))
        .join(per_bar, [*keys, "ts"])
        .select(*keys, "ts", "part", (F.col("_cp") + F.col("_cb")).alias("_carry"))
    )
    w = Window.partitionBy(*keys, "ts", "part").orderBy(*order)
    run = F.sum("inc").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        ticks.join(carry, [*keys, "ts", "part"])
        .select(
            *keys, "ts", "part", "qty", *order,
            F.row_number().over(w).alias("rn"),
            (100 * F.exp((run + F.col("_carry")) * F.lit(scale))).alias("px"),
        )
    )


def to_bars(ticks: DataFrame) -> DataFrame:
    """Ticks with ``px`` to OHLCV, six decimals; partial aggregation runs before the second shuffle."""
    at = F.shiftleft("part", 32) + F.col("rn")  # one number, so that the aggregation hashes instead of sorting

    def r6(c: Column) -> Column:
        return F.round(c, 6)

    return ticks.groupBy(*KEYS, "ts").agg(
        r6(F.min_by("px", at)).alias("open"),
        r6(F.max("px")).alias("high"),
        r6(F.min("px")).alias("low"),
        r6(F.max_by("px", at)).alias("close"),
        F.sum("qty").alias("volume"),
    )


def lineitem_bars(spark, sf_dir, symbol="l_returnflag") -> DataFrame:
    return to_bars(priced(lineitem_ticks(spark, sf_dir, symbol), 1 / 400, LINE_ORDER))


def event_bars(spark, sf_dir) -> DataFrame:
    return to_bars(priced(event_ticks(spark, sf_dir), 2e-6, EVENT_ORDER))


_kept: dict[tuple, tuple[tuple, DataFrame]] = {}


def files_of(spark: SparkSession, folder: str) -> tuple:
    """Path, length and time of every file under ``folder``, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def kept(spark: SparkSession, key: tuple, make) -> DataFrame:
    """One materialised copy per session and input (the first of ``key`` is its folder), written once and read by many jobs.

    A copy is made anew when any file of the folder has changed, and takes the old one's place."""
    full, now = (spark.sparkContext.applicationId, *key), files_of(spark, key[0])
    if full not in _kept or _kept[full][0] != now:
        _kept[full] = (now, cut(make()))
    return _kept[full][1]


def daily(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """Indexed daily series: symbol, timeframe, ts, OHLCV, n, i."""
    bars = kept(spark, (sf_dir, "daily-bars", symbol), lambda: lineitem_bars(spark, sf_dir, symbol))
    return kept(spark, (sf_dir, "daily", symbol), lambda: index_series(bars, chunk="year"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = kept(spark, (sf_dir, "hourly-bars"), lambda: event_bars(spark, sf_dir))
    return kept(spark, (sf_dir, "hourly"), lambda: index_series(bars, chunk="month"))
