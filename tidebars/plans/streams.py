"""Registered queries: streams, drained with ``availableNow`` over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebars.plans import oracle as o
from tidebars.plans.common import Registry, r, second
from tidebars.session import checkpoint_dir
from tidebars.sources.ticks import EVENT_ORDER, event_ticks, hourly, kept, priced
from tidebars.streaming import live, recent, sizing
from tidebars.streaming import ticks as st

Q = Registry()
SLICES = 2
DAY = 86_400.0
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def _path(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _run(spark, source, read, name, **kw):
    """Let ``source`` arrive in slices and drain the stream after each; the result as a table."""
    inbox, out, state = (_path(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    for _ in st.arrivals(source, inbox, SLICES, **kw):
        stream = read(inbox)
        st.drain(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark, sf):
    def make():
        d = priced(event_ticks(spark, sf), 2e-6, EVENT_ORDER)
        return d.select("symbol", F.col("at").alias("ts"), F.col("event_id").alias("tick_id"), "px", "qty")

    return kept(spark, (sf, "event-stream"), make)


def bar_stream(spark, sf):
    return hourly(spark, sf).select("symbol", "ts", "open", "high", "low", "close", "volume")


def read_bar_stream(spark, path):
    return spark.readStream.schema(BARS).parquet(path)


@Q.add("k1_deduplicated_ticks", "SELECT event_type AS symbol, count(*) AS ticks FROM events GROUP BY event_type")
def ticks(spark, sf):
    src = event_stream(spark, sf)
    doubled = src.unionByName(src)  # every tick comes twice
    d = _run(spark, doubled, lambda p: st.read_ticks(spark, p), "k1")
    return d.groupBy("symbol").agg(F.count("*").alias("ticks"))


@Q.add("k2_stream_bars", o.hourly("SELECT symbol, ds AS d, open, high, low, close, volume FROM b WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"))
def bars(spark, sf):
    d = _run(spark, event_stream(spark, sf), lambda p: st.stream_bars(st.read_ticks(spark, p)), "k2")
    return d.select("symbol", second().alias("d"), *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


def signals(spark, sf):
    return kept(spark, (sf, "live"), lambda: _run(spark, bar_stream(spark, sf), lambda p: live.live_signals(read_bar_stream(spark, p)), "live", close_after=DAY))


_K = o.adaptive_kalman()


_FILTERED = o.hourly(_K + f" SELECT symbol, ds AS d, {o.rnd('kalman_price')} AS kalman_price, {o.rnd('kalman_velocity')} AS kalman_velocity FROM k")


def _prices(d):
    return d.select("symbol", second().alias("d"), r("kalman_price").alias("kalman_price"), r("kalman_velocity").alias("kalman_velocity"))


@Q.add("k3_stream_filter", _FILTERED)
def filtered(spark, sf):
    return _prices(signals(spark, sf))


@Q.add("k3_shuffled_arrival", _FILTERED)
def shuffled(spark, sf):
    """Every bar arrives up to two days late, in an order of its own: the filter's answer is that of bars in order."""
    late = F.pmod(F.xxhash64("symbol", "ts"), F.lit(2 * 86_400))
    d = bar_stream(spark, sf).withColumn("arrives", F.timestamp_seconds(F.col("ts").cast("double") + late))
    return _prices(_run(spark, d, lambda p: live.live_signals(read_bar_stream(spark, p), delay="3 days"), "shuffled", close_after=4 * DAY, by="arrives"))


@Q.add("k4_stream_regime", o.hourly(o.HYSTERESIS + " SELECT symbol, ds AS d, regime FROM reg"))
def regimes(spark, sf):
    return signals(spark, sf).where("i > 252").select("symbol", second().alias("d"), "regime")


def _live_sql(select):
    from tidebars.operators.signals import Config

    return o.hourly(_K + ", kd AS (SELECT *, h AS d FROM k), " + o.crossover([Config("live", 15, 80, 1.0, 0.15)], "kalman_price", "kd") + "," + o.LEDGER + select)


@Q.add("k5_stream_signals", _live_sql(" SELECT symbol, ds AS d, prev AS sig FROM eq WHERE i > 252"))
def stopped(spark, sf):
    return signals(spark, sf).where("i > 252").select("symbol", second().alias("d"), "sig")


@Q.add("k6_stream_orders")
def orders(spark, sf):
    inbox, out, state = (_path(spark, f"orders-{x}") for x in ("in", "out", "state"))
    for _ in st.arrivals(bar_stream(spark, sf), inbox, SLICES, close_after=DAY):
        sizing.write_orders(live.live_signals(read_bar_stream(spark, inbox)), out, state, 100_000.0, 400_000.0).awaitTermination()
    d = spark.read.schema("symbol string, ts timestamp, close double, sig double, bars bigint, factor double, target_qty bigint, held_qty bigint, side string, order_qty bigint, batch_id int").parquet(out)
    return d.select("batch_id", "symbol", second().alias("d"), "sig", r("factor", 8).alias("factor"), "target_qty", "held_qty", "side", "order_qty")


_HELD = _live_sql(", s AS (SELECT symbol, sum(prev) AS bars_in FROM eq WHERE i > 252 GROUP BY symbol) SELECT b.symbol, count(*) AS bars, any_value(bars_in) AS bars_in FROM b LEFT JOIN s ON s.symbol = b.symbol GROUP BY b.symbol")


@Q.add("k7_resumed_positions", _HELD)
def resumed(spark, sf):
    """The same stream when every symbol is already held at its first close: without history the position is closed on the first bar."""
    first = hourly(spark, sf).where("i = 1").select("symbol", F.lit(10.0).alias("qty"), F.col("close").alias("last_price"))
    d = _run(spark, bar_stream(spark, sf), lambda p: live.live_signals(read_bar_stream(spark, p), held=first), "resumed", close_after=DAY)
    return d.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum(F.when(F.col("i") > 252, F.col("sig"))).alias("bars_in"))


@Q.add("k7_restarted_run", _live_sql(f" SELECT eq.symbol, eq.ds AS d, {o.rnd('kalman_price')} AS kalman_price, prev AS sig FROM eq JOIN k ON k.symbol = eq.symbol AND k.i = eq.i WHERE eq.i > 252"))
def restarted(spark, sf):
    """A run stops after the first part of its bars; another takes over its state and reads the whole source again."""
    inbox, first, before, second_out, after = (_path(spark, f"restart-{x}") for x in ("in", "one", "one-state", "two", "two-state"))
    source = read_bar_stream
    for k in st.arrivals(bar_stream(spark, sf), inbox, SLICES, close_after=DAY):
        if k == 0:
            st.drain(live.live_signals(source(spark, inbox)), first, before)
    stream = live.live_signals(source(spark, inbox), held=live.saved_state(spark, before))
    st.drain(stream, second_out, after)
    d = spark.read.schema(stream.schema).parquet(first, second_out)
    return d.where("i > 252").select("symbol", second().alias("d"), r("kalman_price").alias("kalman_price"), "sig")


@Q.add("e33_stream_last_bars", o.hourly("SELECT symbol, ds AS d, close FROM b WHERE i > n - 300"))
def last_bars(spark, sf):
    """The bars that a stream keeps in its state, 300 a symbol, read from its checkpoint."""
    inbox, out, state = (_path(spark, f"last-{x}") for x in ("in", "out", "state"))
    for _ in st.arrivals(bar_stream(spark, sf), inbox, SLICES):
        st.drain(recent.keep_last(read_bar_stream(spark, inbox), 300), out, state)
    return recent.last_bars(spark, state).select("symbol", second().alias("d"), "close")


@Q.add("k8_bounded_run", o.hourly("SELECT symbol, count(*) AS bars, max(ds) AS last FROM b GROUP BY symbol"))
def bounded(spark, sf):
    return signals(spark, sf).groupBy("symbol").agg(F.count("*").alias("bars"), F.max(second()).alias("last"))
