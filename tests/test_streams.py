import tempfile

import numpy as np
import pandas as pd
from market_helpers import walk

from tidebars.operators import denoise as dn
from tidebars.operators import ledger as lg
from tidebars.operators import regime as rg
from tidebars.operators import signals as sg
from tidebars.session import KEYS
from pyspark.sql import functions as F

from tidebars.streaming import live, sizing
from tidebars.streaming import ticks as st

SCHEMA = "symbol string, ts timestamp, high double, low double, close double"


def new(name):
    return tempfile.mkdtemp(prefix=f"run-{name}-") + "/x"


def test_stream_equals_batch(spark):
    pdf = pd.concat([walk(330, 31, symbol="A"), walk(340, 32, symbol="B")])
    d = spark.createDataFrame(pdf).cache()
    cfg = live.Settings(fast=5, slow=20, stop=0.05, start=100)
    inbox, out, state = new("in"), new("out"), new("state")
    for _ in st.arrivals(d.select("symbol", "ts", "high", "low", "close"), inbox, 3, close_after=86_400.0):
        s = live.live_signals(spark.readStream.schema(SCHEMA).parquet(inbox), cfg)
        st.drain(s, out, state)
    got = spark.read.parquet(out).orderBy("symbol", "i").toPandas()
    k = dn.denoise(d, "adaptive").cache()
    sig = sg.crossover(k, [sg.Config("c", 5, 20, 1.0, 0.05)], "kalman_price", start=100)
    want = lg.with_stops(sig, [*KEYS, "config_id"]).orderBy("symbol", "i").toPandas()
    price = k.orderBy("symbol", "i").toPandas()
    np.testing.assert_allclose(got["kalman_price"], price["kalman_price"], rtol=1e-10)
    assert list(got["sig"]) == list(want["sig"]) and got["sig"].sum() > 0
    reg = rg.with_regime(d, start=100).orderBy("symbol", "i").toPandas()
    assert list(got[got["i"] > 100]["regime"]) == list(reg["regime"])


def test_late_and_repeated_ticks_are_dropped(spark):
    t = pd.Timestamp("2024-01-01")
    mk = lambda rows: spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "tick_id", "px", "qty"]))
    m = pd.Timedelta(minutes=1)
    first = mk([("A", t, 1, 10.0, 1.0), ("A", t + 30 * m, 2, 12.0, 1.0), ("A", t + 30 * m, 2, 12.0, 1.0), ("A", t + 100 * m, 3, 11.0, 1.0)])
    second = mk([("A", t + 20 * m, 4, 99.0, 1.0), ("A", t + 110 * m, 5, 13.0, 1.0), ("A", t + 300 * m, 6, 14.0, 1.0)])
    inbox, out, state = new("in"), new("out"), new("state")
    for part in (first, second):
        part.write.mode("append").parquet(inbox)
        st.drain(st.stream_bars(st.read_ticks(spark, inbox)), out, state)
    got = spark.read.parquet(out).orderBy("ts").toPandas()
    assert list(got["ts"].dt.hour) == [0, 1]
    assert got.iloc[0][["open", "high", "low", "close", "volume"]].tolist() == [10, 12, 10, 12, 2]  # the late 99 and the repeat are gone
    assert got.iloc[1][["open", "close", "volume"]].tolist() == [11, 13, 2]


def test_resumed_position_stops_on_its_peak(spark):
    """Both symbols come back long in an uptrend at a close of 100; only the one last seen at 120 is stopped (15 %)."""
    bars = pd.concat([pd.DataFrame({"symbol": x, "ts": pd.date_range("2024-01-01", periods=2), "high": 100.0, "low": 100.0, "close": 100.0}) for x in ("far", "near", "flat")])
    inbox, out, state = new("in"), new("out"), new("state")
    for _ in st.arrivals(spark.createDataFrame(bars), inbox, 1, close_after=86_400.0):
        pass
    up = [float(x) for x in np.linspace(80, 99, 80)]
    down = up[::-1]
    held = spark.createDataFrame(
        [("far", 5.0, 120.0, 400, up, 2.0), ("near", 5.0, 102.0, 400, up, 2.0), ("flat", 5.0, 102.0, 400, down, 2.0)],
        "symbol string, qty double, last_price double, i bigint, smooth array<double>, atr double",
    )
    st.drain(live.live_signals(spark.readStream.schema(SCHEMA).parquet(inbox), held=held), out, state)
    got = spark.read.parquet(out).where("i = 401").toPandas().set_index("symbol")["sig"].to_dict()
    assert got == {"far": 0.0, "near": 1.0, "flat": 0.0}


def bars_of(spark, *walks):
    return spark.createDataFrame(pd.concat(walks)).select("symbol", "ts", "high", "low", "close")


CFG = live.Settings(fast=5, slow=20, stop=0.05, start=60)


def plain(pdf):
    """The rules one bar after the other."""
    stt = live.fresh()
    return [live.advance(stt, h, lo, c, CFG) for h, lo, c in zip(pdf["high"], pdf["low"], pdf["close"])]


def collected(spark, out):
    return spark.read.parquet(out).orderBy("symbol", "i").toPandas()


def test_bars_in_any_order_and_late_bars(spark):
    """Bars up to five days late give the answer of bars in order; one that is later than the delay, and one seen already, change nothing."""
    pdf = walk(200, 33, symbol="A")
    d = bars_of(spark, pdf).withColumn("arrives", F.timestamp_seconds(F.col("ts").cast("double") + F.pmod(F.xxhash64("ts"), F.lit(5 * 86_400))))
    inbox, out, state = new("in"), new("out"), new("state")
    read = lambda: live.live_signals(spark.readStream.schema(SCHEMA).parquet(inbox), CFG, delay="6 days", span=11 * 86_400_000_000)
    for k in st.arrivals(d, inbox, 4, close_after=8 * 86_400.0, by="arrives"):
        if k == 2:
            late = pdf.iloc[[3, 40]].assign(ts=lambda x: x["ts"] + pd.Timedelta(hours=1), close=1e6, high=1e6)
            bars_of(spark, late, pdf.iloc[[50]]).write.mode("append").parquet(inbox)
        st.drain(read(), out, state)
    got = collected(spark, out)
    assert list(got["i"]) == list(range(1, 201)) and list(got["close"]) == list(pdf["close"])
    want = plain(pdf)
    np.testing.assert_allclose(got["kalman_price"], [w[0] for w in want], rtol=1e-12)
    assert list(got["sig"]) == [w[3] for w in want] and list(got["regime"]) == [w[2] for w in want]


def test_restart_equals_one_run(spark):
    """Stopped after any part, with bars still waiting, and taken over by another checkpoint: nothing is lost or done twice."""
    walks = [walk(150, 34, symbol="A"), walk(90, 35, symbol="B")]
    inbox, out, again = new("in"), new("out"), new("out")
    read = lambda held=None: live.live_signals(spark.readStream.schema(SCHEMA).parquet(inbox), CFG, held, delay="10 days")
    state = new("state")
    for k in st.arrivals(bars_of(spark, *walks), inbox, 3, close_after=20 * 86_400.0):
        if k == 1:
            st.drain(read(), out, state)
    held = live.saved_state(spark, state)
    assert sorted(r.symbol for r in held.collect()) == ["A", "B"] and spark.read.parquet(out).count() < 240
    st.drain(read(held), again, new("state"))
    got = pd.concat([collected(spark, out), collected(spark, again)])
    for w in walks:
        g, want = got[got["symbol"] == w["symbol"].iloc[0]].sort_values("i"), plain(w)
        assert list(g["i"]) == list(range(1, len(w) + 1))
        np.testing.assert_allclose(g["kalman_price"], [x[0] for x in want], rtol=1e-12)
        assert list(g["sig"]) == [x[3] for x in want] and list(g["regime"]) == [x[2] for x in want]


def test_bars_without_price_or_symbol(spark):
    pdf = walk(30, 36, symbol="A")
    odd = pdf.copy()
    odd.loc[[4, 9], "close"] = np.nan
    inbox, out = new("in"), new("out")
    d = bars_of(spark, odd).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    for _ in st.arrivals(d.union(d.limit(1).withColumn("symbol", F.lit(None).cast("string"))), inbox, 1, close_after=86_400.0):
        st.drain(live.live_signals(spark.readStream.schema(SCHEMA).parquet(inbox), CFG), out, new("state"))
    want = plain(pdf.drop(index=[4, 9]))
    np.testing.assert_allclose(collected(spark, out)["kalman_price"], [w[0] for w in want], rtol=1e-12)


def test_last_bars_stay_in_the_state(spark):
    from tidebars.streaming import recent

    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    pdf = pd.concat([walk(60, 37, symbol="A"), walk(7, 38, symbol="B")])
    d = spark.createDataFrame(pdf).select(*[c.split()[0] for c in schema.split(", ")])
    inbox, out, state = new("in"), new("out"), new("state")
    for _ in st.arrivals(d.withColumn("arrives", F.timestamp_seconds(F.pmod(F.xxhash64("ts"), F.lit(1000)))), inbox, 3, by="arrives"):
        st.drain(recent.keep_last(spark.readStream.schema(schema).parquet(inbox), 10), out, state)
    got = recent.last_bars(spark, state).orderBy("symbol", "ts").toPandas()
    want = pdf.groupby("symbol").tail(10)
    assert list(got["ts"]) == list(want["ts"]) and list(got["close"]) == list(want["close"])
    assert spark.read.parquet(out).agg(F.max("bars")).first()[0] == 10


def test_orders_keep_the_holdings_of_absent_symbols(spark):
    """Two batches: margin counts symbols that have no bar, an unchanged signal gives no order, and late bars change nothing."""
    bars = "symbol string, ts int, close double, sig double"
    stamp = lambda rows: spark.createDataFrame(rows, bars).withColumn("ts", F.timestamp_seconds("ts"))
    none = spark.createDataFrame([], sizing.STATE)
    args = {"value": 100_000.0, "buying_power": 200_000.0, "leverage": 2.0}
    first, state = sizing.batch_orders(stamp([("A", 1, 10.0, 0.0), ("A", 2, 20.0, 1.0), ("B", 2, 50.0, 1.0), ("C", 2, 5.0, 0.0)]), none, **args)
    cap = sizing.MARGIN_SHARE * 200_000.0
    factor = min(1.0, cap / 200_000.0)
    got = {r.symbol: (r.side, r.order_qty) for r in first.collect()}
    assert got == {"A": ("buy", int(100_000 * factor / 20)), "B": ("buy", int(100_000 * factor / 50))}
    second, after = sizing.batch_orders(stamp([("A", 3, 25.0, 1.0)]), state, **args)
    assert second.count() == 0
    held = {r.symbol: r.held for r in after.collect()}
    assert held == {"A": int(100_000 * factor / 20), "B": int(100_000 * factor / 50), "C": 0}
    third, after = sizing.batch_orders(stamp([("B", 1, 1.0, 0.0), ("A", 4, 30.0, 0.0)]), after, **args)
    assert [(r.symbol, r.side, r.order_qty) for r in third.collect()] == [("A", "sell", held["A"])]
    assert {r.symbol: r.held for r in after.collect()} == {"A": 0, "B": held["B"], "C": 0}


def test_search_by_agent(spark):
    from tidebars.plans.relational import search_trades

    log = spark.createDataFrame([("A", "BUY", "PPO"), ("B", "SELL", None)], "symbol string, action string, active_agent string")
    assert [r.symbol for r in search_trades(log, agent="PPO").collect()] == ["A"] and search_trades(log, "b").count() == 2


def test_advance_is_flat_before_start():
    stt, cfg = live.fresh(), live.Settings(start=5, fast=1, slow=2)
    outs = [live.advance(stt, c, c, c, cfg) for c in np.linspace(100, 120, 10)]
    assert all(o[3] == 0 for o in outs[:5]) and outs[-1][3] == 1
