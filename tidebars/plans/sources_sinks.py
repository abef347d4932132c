"""Registered queries: sources, sinks, dimensions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebars.operators import orders as od
from tidebars.operators.blocks import index_series
from tidebars.plans import oracle as o
from tidebars.plans.aggregates import _P, plain_metrics
from tidebars.plans.common import Registry, day, r, second
from tidebars.session import checkpoint_dir
from tidebars.sources import bars as br
from tidebars.sources import configs as cf
from tidebars.sources.ticks import daily, files_of, hourly, kept, table

Q = Registry()


def _new_path(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_bars(spark, sf):
    """Daily and hourly bars as a partitioned table in the shared folder; written once per session, and anew when an input file has changed."""
    key = (spark.sparkContext.applicationId, sf)
    now = files_of(spark, sf)
    if _paths.get(key, (None,))[0] != now:
        path = _new_path(spark, "bars")
        cols = ["symbol", "timeframe", "ts", *br.OHLCV]
        br.write_bars(daily(spark, sf).select(*cols).unionByName(hourly(spark, sf).select(*cols)), path)
        _paths[key] = (now, path)
    return _paths[key][1]


_paths: dict = {}


@Q.add("a1_scan_bars", o.daily("SELECT symbol, ds AS d, open, high, low, close, volume FROM b"))
def scan(spark, sf):
    return br.read_bars(spark, stored_bars(spark, sf), timeframe="1d").select("symbol", day().alias("d"), *br.OHLCV)


@Q.add("a2_partitioned_sink", o.hourly("SELECT symbol, '1h' AS timeframe, count(*) AS bars, sum(volume) AS volume FROM b GROUP BY symbol"))
def sink(spark, sf):
    d = br.read_bars(spark, stored_bars(spark, sf), timeframe="1h")
    return d.groupBy("symbol", "timeframe").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


@Q.add("a4_many_symbols", o.daily("SELECT symbol, ds AS d, close FROM b WHERE symbol IN ('A', 'R', 'nowhere') AND d >= DATE '1996-01-01' AND d < DATE '1999-01-01'"))
def many(spark, sf):
    d = br.read_bars(spark, stored_bars(spark, sf), ["A", "R", "nowhere"], "1d", "1996-01-01", "1999-01-01")
    return d.select("symbol", day().alias("d"), "close")


@Q.add("a3_canonical_bars", o.daily("SELECT symbol, ds AS d, open, high, low, close, CASE WHEN volume < 100 THEN NULL ELSE volume END AS volume FROM b"))
def canonical(spark, sf):
    v = daily(spark, sf)
    vendor = v.select(
        F.col("symbol").alias("Symbol"), second().alias("Timestamp"), *[F.col(c).cast("string").alias(c.capitalize()) for c in br.OHLCV[:4]],
        F.when(F.col("volume") < 100, "n/a").otherwise(F.col("volume").cast("string")).alias("Volume"),
        F.lit(1).alias("trade_count"), F.col("close").alias("vwap"),
    )
    return br.canonical(vendor, "1d").select("symbol", day().alias("d"), *br.OHLCV)


def candle_docs(spark, sf):
    """Bars as feed documents, one per symbol and month."""
    c = F.array(second(), *[F.col(x).cast("string") for x in br.OHLCV], F.lit("0"))
    g = daily(spark, sf).groupBy("symbol", F.trunc("ts", "MM").alias("m")).agg(F.collect_list(c).alias("candles"))
    return g.select("symbol", F.to_json(F.struct(F.struct("candles").alias("data"))).alias("body"))


@Q.add("a5_candle_documents", o.daily("SELECT symbol, ds AS d, open, high, low, close, volume, 0.0 AS open_interest FROM b"))
def candles(spark, sf):
    return br.candles(candle_docs(spark, sf)).select("symbol", day().alias("d"), *br.OHLCV, "open_interest")


@Q.add("a6_request_ranges", o.daily("""sp AS (SELECT symbol, min(d) AS s, max(d) AS e FROM b GROUP BY symbol), ch AS (SELECT symbol, e, CAST(s + CAST(k*366 AS INT) AS DATE) AS f FROM sp, range(0, 100000) r(k) WHERE s + CAST(k*366 AS INT) < e)
  SELECT symbol, strftime(f, '%Y-%m-%d') AS from_date, strftime(least(CAST(f + 365 AS DATE), e), '%Y-%m-%d') AS to_date FROM ch"""))
def ranges(spark, sf):
    sp = daily(spark, sf).groupBy("symbol").agg(F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("end"))
    return br.request_ranges(sp).select("symbol", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"))


@Q.add("a7_concat_first_wins", o.daily("SELECT symbol, ds AS d, CASE WHEN i <= 1500 THEN close ELSE close+1000 END AS close FROM b"))
def concat(spark, sf):
    d = daily(spark, sf).select("symbol", "ts", "i", "close")
    one = d.where("i <= 1500").drop("i")
    two = d.where("i >= 1000").select("symbol", "ts", (F.col("close") + 1000).alias("close"))
    return br.first_of_duplicates([one, two]).select("symbol", day().alias("d"), "close")


_NAMES = "CASE o_orderpriority WHEN '1-URGENT' THEN '1m' WHEN '2-HIGH' THEN '1h' WHEN '3-MEDIUM' THEN '1d' WHEN '5-LOW' THEN '1M' ELSE '2d' END"


@Q.add("a9_timeframe_names", f"SELECT tf AS timeframe, CASE tf WHEN '1m' THEN '1minute' WHEN '1h' THEN '30minute' WHEN '1d' THEN 'day' WHEN '1M' THEN 'month' END AS interval, count(*) AS orders FROM (SELECT {_NAMES} AS tf FROM orders) GROUP BY tf")
def names(spark, sf):
    d = table(spark, sf, "orders").select(F.expr(_NAMES).alias("timeframe"))
    return d.groupBy("timeframe").agg(F.count("*").alias("orders")).withColumn("interval", br.interval_of(F.col("timeframe")))


@Q.add("a10_config_documents", """SELECT s_suppkey AS id, g AS "group", a AS asset, CAST(s_suppkey % 20 + 2 AS INT) AS fast_window, CAST(CASE WHEN a = 'A' THEN 80 ELSE s_nationkey + 30 END AS INT) AS slow_window,
  CASE WHEN g = 'swing' THEN round(s_acctbal/1000, 2) ELSE 5.0 END AS leverage_factor, 0.15 AS stop_loss_pct FROM supplier, (VALUES ('swing'), ('monthly')) v(g), (VALUES ('A'), ('R')) w(a)""")
def configs(spark, sf):
    fast = (F.col("s_suppkey") % 20 + 2).cast("int").alias("fast_window")
    slow = (F.col("s_nationkey") + 30).cast("int").alias("slow_window")
    lev = F.round(F.col("s_acctbal") / 1000, 2).alias("leverage_factor")
    doc = F.struct(
        F.struct(F.struct(fast, lev).alias("A"), F.struct(fast, slow, lev).alias("R")).alias("swing"),
        F.struct(F.struct(fast).alias("A"), F.struct(fast, slow).alias("R")).alias("monthly"),
    )
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.to_json(doc).alias("body"))
    return cf.flatten_configs(docs, keep=["id"]).select("id", "group", "asset", "fast_window", "slow_window", "leverage_factor", "stop_loss_pct")


@Q.add("a10_config_files", """SELECT n_nationkey AS id, CASE WHEN bad = 0 THEN 'swing' END AS "group", CASE WHEN bad = 0 THEN a END AS asset, CAST(CASE WHEN bad = 0 THEN n_nationkey % 20 + 2 ELSE 0 END AS INT) AS fast_window,
  CAST(CASE WHEN bad = 0 THEN CASE WHEN a = 'A' THEN 80 ELSE n_nationkey + 30 END ELSE 0 END AS INT) AS slow_window, bad = 1 AS broken, CASE WHEN bad = 1 THEN 20 ELSE 0 END AS chars
  FROM (SELECT *, (n_nationkey % 7 = 3)::INT AS bad FROM nation), (VALUES ('A'), ('R')) w(a) WHERE bad = 0 OR a = 'A'""")
def config_files(spark, sf):
    """A file for each nation, some of them cut short, written and scanned."""
    fast = (F.col("n_nationkey") % 20 + 2).cast("int").alias("fast_window")
    doc = F.to_json(F.struct(F.struct(F.struct(fast).alias("A"), F.struct(fast, (F.col("n_nationkey") + 30).cast("int").alias("slow_window")).alias("R")).alias("swing")))
    path = _new_path(spark, "configs")
    body = F.when(F.col("n_nationkey") % 7 == 3, F.substring(doc, 1, 20)).otherwise(doc)
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), body.alias("value")).write.option("lineSep", " ").partitionBy("id").text(path)
    d = cf.read_configs(spark, f"{path}/*/*.txt")
    return d.select(F.regexp_extract("file", r"id=(\d+)/", 1).cast("bigint").alias("id"), "group", "asset", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fast_window", "slow_window")], F.col("malformed").isNotNull().alias("broken"), F.coalesce(F.length(F.trim("malformed")), F.lit(0)).alias("chars"))


def assets(spark):
    p = lambda lev, f, s, st: (lev, f, s, st, False)
    return cf.asset_dimension(spark, [
        ("Returned", "A", 1, 50000.0, 4.0, 6.0, 3.0, 12, 36, 0.11, False, {"1d": p(3.0, 12, 36, 0.11), "1h": p(1.25, 96, 288, 0.04)}),
        ("Refused", "R", 1, 50000.0, 4.0, 6.0, 2.5, 9, 27, 0.07, False, {"1h": p(1.75, 72, 216, 0.05)}),
        ("Clicks", "click", 1, 50000.0, 4.0, 6.0, 1.5, 8, 32, 0.09, True, {"1h": p(1.2, 64, 192, 0.045)}),
    ])


_AS = "a(symbol, tf, name, leverage, fast) AS (VALUES ('A', '1d', 'Returned', 3.0, 12), ('R', '1d', 'Refused', 2.5, 9), ('click', '1h', 'Clicks', 1.2, 64))"
_BOTH = o.DAILY.replace("t AS (", "td AS (").replace("FROM t GROUP", "FROM td GROUP").replace("b AS MAT", "bd AS MAT") + ", " + o.HOURLY.replace("t AS (", "th AS (").replace("FROM t GROUP", "FROM th GROUP").replace("b AS MAT", "bh AS MAT") + ", bb AS (SELECT symbol, '1d' AS tf FROM bd UNION ALL SELECT symbol, '1h' FROM bh)"


def both(spark, sf):
    return daily(spark, sf).select("symbol", "timeframe", "ts", "close").unionByName(hourly(spark, sf).select("symbol", "timeframe", "ts", "close"))


@Q.add("a11_asset_dimension", f"WITH {_BOTH}, {_AS} SELECT symbol, tf AS timeframe, CAST(coalesce(leverage, 1) AS DOUBLE) AS leverage, CAST(coalesce(fast, 0) AS INT) AS fast, count(*) AS bars FROM bb LEFT JOIN a USING (symbol, tf) GROUP BY ALL")
def asset_params(spark, sf):
    d = cf.with_asset(both(spark, sf), assets(spark))
    return d.groupBy("symbol", "timeframe", F.coalesce("cfg_leverage", F.lit(1.0)).alias("leverage"), F.coalesce("cfg_fast", F.lit(0)).alias("fast")).agg(F.count("*").alias("bars"))


@Q.add("a11_unknown_symbols", f"WITH {_BOTH}, {_AS} SELECT DISTINCT symbol FROM bb WHERE symbol NOT IN (SELECT symbol FROM a)")
def unknown(spark, sf):
    return cf.unknown_symbols(both(spark, sf), assets(spark))


@Q.add("c3_asset_lookup", o.daily("SELECT symbol, ds AS d, CASE symbol WHEN 'A' THEN 'Returned' WHEN 'R' THEN 'Refused' END AS name, CASE symbol WHEN 'A' THEN 3.0 WHEN 'R' THEN 2.5 END*close AS exposure FROM b"))
def asset_lookup(spark, sf):
    return cf.with_asset(daily(spark, sf), assets(spark)).select("symbol", day().alias("d"), "name", (F.col("cfg_leverage") * F.col("close")).alias("exposure"))


@Q.add("a12_json_report", o.daily(_P + f" SELECT symbol, config_id, {o.rnd('sharpe', 7)} AS sharpe, {o.rnd('cum_return', 7)} AS cum_return FROM p"))
def report(spark, sf):
    path = _new_path(spark, "report")
    m = plain_metrics(spark, sf)
    cf.write_report(cf.nested_report(m, "symbol", "config_id", ["sharpe", "cum_return"]), path)
    back = spark.read.schema("symbol string, results array<struct<config_id:string,metrics:struct<sharpe:double,cum_return:double>>>").json(path)
    d = back.select("symbol", F.explode("results").alias("x"))
    return d.select("symbol", "x.config_id", r("x.metrics.sharpe", 7).alias("sharpe"), r("x.metrics.cum_return", 7).alias("cum_return"))


@Q.add("a13_quote_documents", "SELECT event_id, event_type AS key, CASE WHEN value < 20 THEN 0.0 ELSE value END AS last_price FROM events")
def quotes(spark, sf):
    ev = table(spark, sf, "events")
    name = F.when(F.col("value") < 20, F.lit("elsewhere")).otherwise(F.col("event_type"))
    body = F.to_json(F.struct(F.create_map(name, F.struct(F.struct(F.col("value").alias("close")).alias("ohlc"))).alias("data")))
    return ev.select("event_id", F.col("event_type").alias("key"), br.last_price(body, F.col("event_type")).alias("last_price"))


@Q.add("a16_synthetic_bars", f"""WITH z AS (SELECT s_name AS symbol, i, 0.0003+0.012*{o.normal("'42/ret/' || s_name", 'i')} AS r, 1+0.0015*{o.normal("'42/open/' || s_name", 'i')} AS jo, 1+abs(0.003*{o.normal("'42/high/' || s_name", 'i')}) AS jh,
  1-abs(0.003*{o.normal("'42/low/' || s_name", 'i')}) AS jl, floor(500+4500*{o.uniform("'42/volume/' || s_name", 'i')}) AS volume FROM supplier, range(1, 501) a(i)),
  c AS (SELECT *, 80*exp(sum(r) OVER (PARTITION BY symbol ORDER BY i)) AS close FROM z)
  SELECT symbol, strftime(DATE '2024-12-31' + CAST(i-500 AS INT), '%Y-%m-%d') AS d, {o.rnd('close*jo', 5)} AS open, {o.rnd('greatest(close*jo, close)*jh', 5)} AS high, {o.rnd('least(close*jo, close)*jl', 5)} AS low, {o.rnd('close', 5)} AS close, volume FROM c""")
def synthetic(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"))
    d = br.gbm_bars(s)
    return d.select("symbol", day().alias("d"), *[r(c, 5).alias(c) for c in br.OHLCV[:4]], "volume")


@Q.add("b11_quote_sanity", """WITH q AS (SELECT *, round(value) AS ltp FROM events), s AS (SELECT *, CASE WHEN ltp > 0 AND ltp NOT IN (75, 100, 220) THEN ltp END AS ok FROM q)
  SELECT event_id, event_type AS symbol, ltp, last_value(ok IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clean FROM s""")
def sanity(spark, sf):
    return br.sane_quotes(quote_series(spark, sf), ("symbol",)).select("event_id", "symbol", "ltp", "clean")


def quote_series(spark, sf):
    """Event quotes numbered by (time, id): the pair is unique, so it serves as the series order."""
    def make():
        ev = table(spark, sf, "events")
        d = ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round("value").alias("ltp"))
        return index_series(d, ("symbol",), "ts", "day", tie="event_id")

    return kept(spark, (sf, "quotes"), make)


@Q.add("b14_futures_filter", "SELECT p_partkey AS instrument_key, upper(p_name) || CASE p_type WHEN 'ECONOMY' THEN ' FUT' WHEN 'SMALL' THEN ' FUT CE' ELSE ' OPT' END AS trading_symbol FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def futures(spark, sf):
    return instruments(spark, sf).where(F.col("trading_symbol").contains("FUT")).select("instrument_key", "trading_symbol")


def instruments(spark, sf):
    """Parts as instruments; expiry dates include missing and unreadable ones."""
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", " FUT").when(F.col("p_type") == "SMALL", " FUT CE").otherwise(" OPT")
    day_ = F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size") * 9).cast("string")
    exp = F.when(F.col("p_size") < 10, F.lit(None)).when(F.col("p_size") < 20, F.lit("soon")).otherwise(day_)
    return p.select(F.col("p_partkey").alias("instrument_key"), F.concat(F.upper("p_name"), kind).alias("trading_symbol"), exp.alias("expiry"), F.col("p_name").alias("base"))


@Q.add("h4_nearest_expiry", """WITH x AS (SELECT p_name AS base, p_partkey AS instrument_key, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN 'soon' ELSE strftime(DATE '2026-01-01' + p_size*9, '%Y-%m-%d') END AS expiry FROM part)
  SELECT base, instrument_key, expiry FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY coalesce(TRY_CAST(expiry AS DATE), DATE '9999-12-31'), instrument_key) AS k FROM x) WHERE k = 1""")
def expiry(spark, sf):
    return od.nearest_expiry(instruments(spark, sf), "base").select("base", "instrument_key", "expiry")
