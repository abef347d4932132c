"""Registered queries: window and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import denoise as dn
from tidebars.operators import features as ft
from tidebars.operators import regime as rg
from tidebars.operators import signals as sg
from tidebars.operators.blocks import halo, in_block, owned, rows
from tidebars.plans import oracle as o
from tidebars.plans.common import Registry, day, r, second
from tidebars.sources.ticks import daily, hourly

Q = Registry()


def _window_query(name, out, k, spark_col, sql_col, lookback, source=daily):
    """A query whose result is one window expression over bars."""
    wrap = o.daily if source is daily else o.hourly

    def run(spark, sf):
        at = day() if source is daily else second()
        d = owned(halo(source(spark, sf), lookback).withColumn(out, spark_col()))
        return d.select("symbol", at.alias("d"), r(out, k).alias(out))

    Q.add(name, wrap(f"SELECT symbol, ds AS d, {o.rnd(out, k)} AS {out} FROM (SELECT *, {sql_col} AS {out} FROM b)"))(run)


_window_query("e1_simple_return", "return_simple", 8, ft.simple_return, f"close/lag(close) OVER {o.W} - 1", 1)
_window_query("e2_log_return", "return_log", 8, ft.log_return, f"ln(close/lag(close) OVER {o.W})", 1)
_window_query("e1_simple_return_hourly", "return_simple", 8, ft.simple_return, f"close/lag(close) OVER {o.W} - 1", 1, hourly)
_window_query(
    "e8_bollinger_width", "bb_width", 8, ft.bollinger_width,
    f"CASE WHEN i >= 20 THEN 4*stddev_pop(close) OVER {o.over(-19)}/nullif(avg(close) OVER {o.over(-19)}, 0) END", 20,
)
_window_query("e13_sma", "sma", 6, lambda: ft.sma("close", 15), o.mean("close", 15), 15)
_window_query("e13_sma_before_bar", "sma", 10, lambda: ft.sma("close", 80, shift=1), o.mean("close", 80, 1), 82)
_window_query(
    "e15_momentum_signal", "sig", 1, lambda: F.coalesce((F.col("close") > ft.sma("close", 252)).cast("double"), F.lit(0.0)),
    f"CASE WHEN close > {o.mean('close', 252)} THEN 1.0 ELSE 0.0 END", 252,
)
_window_query(
    "e34_month_start", "first_of_month", 1,
    lambda: F.coalesce((F.month("ts") != F.lag(F.month("ts")).over(in_block())).cast("double"), F.lit(1.0)),
    f"CASE WHEN month(d) = lag(month(d)) OVER {o.W} THEN 0.0 ELSE 1.0 END", 1,
)


@Q.add("e3_rolling_vol", o.daily(
    f"""lr AS (SELECT *, ln(close/lag(close) OVER {o.W}) AS lr FROM b)
    SELECT symbol, ds AS d, {o.rnd('v', 8)} AS vol_rolling_30 FROM (SELECT *, stddev_samp(lr) OVER {o.over(-29)} AS v FROM lr)"""))
def rolling_vol(spark, sf):
    d = halo(daily(spark, sf), 31).withColumn("lr", ft.log_return())
    return owned(d.withColumn("v", ft.rolling_vol("lr", 30))).select("symbol", day().alias("d"), r("v", 8).alias("vol_rolling_30"))


@Q.add("e4_ewma_vol", o.daily(
    f"""lr AS (SELECT *, ln(close/lag(close) OVER {o.W}) AS x FROM b),
    ew(symbol, i, s0, s1, s2, ss) AS (SELECT symbol, i, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM lr WHERE i = 1
      UNION ALL SELECT x.symbol, x.i, s0*29/31.0+1, s1*29/31.0+x.x, s2*29/31.0+x.x*x.x, ss*29*29/31.0/31.0+1 FROM ew JOIN lr x ON x.symbol = ew.symbol AND x.i = ew.i+1)
    SELECT b.symbol, b.ds AS d, CASE WHEN b.i > 2 THEN {o.rnd('sqrt(greatest(s2/s0-(s1/s0)*(s1/s0), 0)*s0*s0/(s0*s0-ss))', 8)} END AS vol_ewma
    FROM ew JOIN b ON b.symbol = ew.symbol AND b.i = ew.i"""))
def ewma_vol(spark, sf):
    return ft.add_ewma_vol(daily(spark, sf)).select("symbol", day().alias("d"), r("vol_ewma", 8).alias("vol_ewma"))


@Q.add("e6_rsi", o.daily(
    f"""dl AS (SELECT symbol, i, coalesce(close-lag(close) OVER {o.W}, 0) AS x FROM b),
    ru(symbol, i, g, l) AS (SELECT symbol, i, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM dl WHERE i = 1
      UNION ALL SELECT x.symbol, x.i, (g*13+greatest(x.x, 0))/14, (l*13+greatest(-x.x, 0))/14 FROM ru JOIN dl x ON x.symbol = ru.symbol AND x.i = ru.i+1)
    SELECT b.symbol, b.ds AS d, CASE WHEN b.i >= 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE {o.rnd('100-100/(1+g/l)')} END END AS rsi_14
    FROM ru JOIN b ON b.symbol = ru.symbol AND b.i = ru.i"""))
def rsi(spark, sf):
    d = ft.add_rsi(daily(spark, sf))
    return d.select("symbol", day().alias("d"), r("rsi_14").alias("rsi_14"))


@Q.add("e7_macd", o.daily(
    f"""em(symbol, i, f, s, g) AS (SELECT symbol, i, close, close, CAST(NULL AS DOUBLE) FROM b WHERE i = 1
      UNION ALL SELECT symbol, i, f, s, CASE WHEN i = 26 THEN f-s WHEN i > 26 THEN g*0.8+(f-s)*0.2 END FROM (
        SELECT x.symbol, x.i, em.f*11/13+x.close*2/13 AS f, em.s*25/27+x.close*2/27 AS s, em.g FROM em JOIN b x ON x.symbol = em.symbol AND x.i = em.i+1))
    SELECT b.symbol, b.ds AS d, CASE WHEN b.i >= 26 THEN {o.rnd('f-s')} END AS macd, CASE WHEN b.i >= 34 THEN {o.rnd('g')} END AS macd_signal,
      CASE WHEN b.i >= 34 THEN {o.rnd('f-s-g')} END AS macd_diff FROM em JOIN b ON b.symbol = em.symbol AND b.i = em.i"""))
def macd(spark, sf):
    d = ft.add_macd(daily(spark, sf))
    return d.select("symbol", day().alias("d"), *[r(c).alias(c) for c in ("macd", "macd_signal", "macd_diff")])


@Q.add("e9_cci", o.daily(
    f"""tp AS (SELECT *, (high+low+close)/3 AS tp FROM b), tw AS (SELECT *, avg(tp) OVER {o.over(-29)} AS m, list(tp) OVER {o.over(-29)} AS ts FROM tp)
    SELECT symbol, ds AS d, CASE WHEN i >= 30 THEN {o.rnd('(tp-m)/nullif(0.015*list_sum(list_transform(ts, lambda x: abs(x-m)))/30, 0)')} END AS cci_30 FROM tw"""))
def cci(spark, sf):
    return owned(ft.cci(halo(daily(spark, sf), 30))).select("symbol", day().alias("d"), r("cci_30").alias("cci_30"))


_ADX = o.TRUE_RANGE + f""",
dm0 AS (SELECT symbol, i, tr, high-lag(high) OVER {o.W} AS up, lag(low) OVER {o.W}-low AS dn FROM tr),
dm AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM dm0),
di(symbol, i, p, m, t) AS (SELECT symbol, CAST(31 AS BIGINT), avg(pdm), avg(mdm), avg(tr) FROM dm WHERE i BETWEEN 2 AND 31 GROUP BY symbol HAVING count(*) = 30
  UNION ALL SELECT x.symbol, x.i, (p*29+x.pdm)/30, (m*29+x.mdm)/30, (t*29+x.tr)/30 FROM di JOIN dm x ON x.symbol = di.symbol AND x.i = di.i+1),
dx AS MATERIALIZED (SELECT symbol, i, coalesce(100*abs(p/nullif(t,0)-m/nullif(t,0))/nullif(p/nullif(t,0)+m/nullif(t,0), 0), 0) AS dx FROM di),
ax(symbol, i, a) AS (SELECT symbol, CAST(60 AS BIGINT), avg(dx) FROM dx WHERE i BETWEEN 31 AND 60 GROUP BY symbol HAVING count(*) = 30
  UNION ALL SELECT x.symbol, x.i, (a*29+x.dx)/30 FROM ax JOIN dx x ON x.symbol = ax.symbol AND x.i = ax.i+1)"""


@Q.add("e10_adx", o.daily(_ADX + f" SELECT b.symbol, b.ds AS d, {o.rnd('a')} AS dx_30 FROM b LEFT JOIN ax ON ax.symbol = b.symbol AND ax.i = b.i"))
def adx(spark, sf):
    d = ft.add_adx(daily(spark, sf))
    return d.select("symbol", day().alias("d"), r("dx_30").alias("dx_30"))


@Q.add("e11_atr", o.daily(o.ATR + f" SELECT b.symbol, b.ds AS d, {o.rnd('atr')} AS atr_14 FROM b LEFT JOIN atr a ON a.symbol = b.symbol AND a.i = b.i"))
def atr(spark, sf):
    d = ft.add_atr(daily(spark, sf))
    return d.select("symbol", day().alias("d"), r("atr_14").alias("atr_14"))


@Q.add("e12_atr_backfilled", o.daily(
    o.ATR + f" SELECT b.symbol, b.ds AS d, {o.rnd('coalesce(a.atr, seed.a)')} AS atr FROM b LEFT JOIN atr a ON a.symbol = b.symbol AND a.i = b.i JOIN seed ON seed.symbol = b.symbol"))
def atr_backfilled(spark, sf):
    return dn.noise_scale(daily(spark, sf), backfill=True).select("symbol", day().alias("d"), r("atr").alias("atr"))


@Q.add("e14_crossover_signal", o.daily(
    f"SELECT symbol, ds AS d, CASE WHEN f > s THEN 1.0 ELSE 0.0 END AS sig FROM (SELECT *, {o.mean('close', 15)} AS f, {o.mean('close', 80)} AS s FROM b)"))
def crossover_signal(spark, sf):
    d = halo(daily(spark, sf), 80)
    sig = F.coalesce((ft.sma("close", 15) > ft.sma("close", 80)).cast("double"), F.lit(0.0))
    return owned(d.withColumn("sig", sig)).select("symbol", day().alias("d"), "sig")


_CFG = [sg.Config("a", 15, 80), sg.Config("b", 10, 40)]


@Q.add("e16_next_bar_execution", o.daily(o.crossover(_CFG) + " SELECT symbol, config_id, ds AS d, sig FROM x"))
def next_bar(spark, sf):
    return sg.crossover(daily(spark, sf), _CFG).select("symbol", "config_id", day().alias("d"), "sig")


@Q.add("e17_router_volatility", o.daily(o.REGIME + f" SELECT symbol, ds AS d, {o.rnd('vol', 8)} AS vol, {o.rnd('vol_mean', 8)} AS vol_mean, {o.rnd('vol_std', 8)} AS vol_std FROM raw"))
def router_volatility(spark, sf):
    d = owned(rg.with_volatility(daily(spark, sf)))
    return d.select("symbol", day().alias("d"), *[r(c, 8).alias(c) for c in ("vol", "vol_mean", "vol_std")])


@Q.add("e18_raw_regime", o.daily(o.REGIME + " SELECT symbol, ds AS d, raw_regime FROM raw"))
def raw_regime(spark, sf):
    return owned(rg.with_volatility(daily(spark, sf))).select("symbol", day().alias("d"), "raw_regime")


@Q.add("e19_regime_hysteresis", o.daily(o.HYSTERESIS + " SELECT symbol, ds AS d, raw_regime, regime FROM reg"))
def hysteresis(spark, sf):
    return rg.with_regime(daily(spark, sf)).select("symbol", day().alias("d"), "raw_regime", "regime")


def _filter_query(name, preset, sql):
    def run(spark, sf):
        d = dn.denoise(daily(spark, sf), preset)
        return d.select("symbol", day().alias("d"), *[r(c).alias(c) for c in ("kalman_price", "kalman_velocity", "kalman_residual")])

    Q.add(name, o.daily(sql + f" SELECT symbol, ds AS d, {o.rnd('kalman_price')} AS kalman_price, {o.rnd('kalman_velocity')} AS kalman_velocity, {o.rnd('close-kalman_price')} AS kalman_residual FROM k"))(run)


_filter_query("e20_kalman_price", "price", o.kalman("0.3", "3.0"))
_filter_query("e21_kalman_adaptive", "adaptive", o.adaptive_kalman())
_filter_query("e22_kalman_trend", "trend", o.kalman("0.1", "10.0"))


@Q.add("e23_residual_summary", o.daily(o.kalman("0.3", "3.0") + f" SELECT symbol, count(*) AS bars, {o.rnd('avg(close-kalman_price)')} AS mean_residual, {o.rnd('max(abs(close-kalman_price))')} AS worst FROM k GROUP BY symbol"))
def residual_summary(spark, sf):
    d = dn.denoise(daily(spark, sf), "price")
    return d.groupBy("symbol").agg(F.count("*").alias("bars"), r(F.avg("kalman_residual")).alias("mean_residual"), r(F.max(F.abs("kalman_residual"))).alias("worst"))


_FEAT = f"""f AS (SELECT *, close/lag(close) OVER {o.W}-1 AS return_simple, ln(close/lag(close) OVER {o.W}) AS return_log,
  CASE WHEN i >= 20 THEN 4*stddev_pop(close) OVER {o.over(-19)}/nullif(avg(close) OVER {o.over(-19)}, 0) END AS bb_width FROM b)"""


def _simple_features(spark, sf):
    d = halo(daily(spark, sf), 20)
    return owned(d.withColumn("return_simple", ft.simple_return()).withColumn("return_log", ft.log_return()).withColumn("bb_width", ft.bollinger_width()))


_PARTS = ["e1_simple_return", "e2_log_return", "e3_rolling_vol", "e4_ewma_vol", "e6_rsi", "e7_macd", "e8_bollinger_width", "e9_cci", "e10_adx", "e11_atr"]
_DIGITS = {c: 8 for c in (*ft.RETURNS, "bb_width")}


_ALL = "SELECT * FROM " + " JOIN ".join(f"({Q[p][1]}) AS f{k}{' USING (symbol, d)' if k else ''}" for k, p in enumerate(_PARTS))
#: The twelve features, rounded, as CTE ``f`` with the bar number.
ALL_FEATURES = f"WITH f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM ({_ALL}))"


def rounded_features(spark, sf, block=None):
    d = ft.with_features(daily(spark, sf), block=block)
    return d.select("symbol", "timeframe", "ts", F.col("i").cast("bigint").alias("i"), F.col("n").cast("bigint").alias("n"), *[r(c, _DIGITS.get(c, 6)).alias(c) for c in ft.FEATURES])


@Q.add("e_all_features", _ALL)
def all_features(spark, sf):
    return rounded_features(spark, sf).select("symbol", day().alias("d"), *ft.FEATURES)


@Q.add("e_features_in_blocks", _ALL)
def features_in_blocks(spark, sf):
    """The same, with series cut into blocks of 500 bars, so that every carry is used."""
    return rounded_features(spark, sf, 500).select("symbol", day().alias("d"), *ft.FEATURES)


def _z(c):
    w = "PARTITION BY symbol ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW"
    return f"{o.rnd(f'CASE WHEN max({c}) OVER ({w}) > min({c}) OVER ({w}) THEN ({c}-avg({c}) OVER ({w}))/nullif(stddev_samp({c}) OVER ({w}), 0) END', 5)} AS {c}_z"


@Q.add("e5_rolling_zscore", ALL_FEATURES + f" SELECT symbol, d, {', '.join(_z(c) for c in ft.FEATURES)} FROM f")
def zscore(spark, sf):
    d = ft.with_zscores(rounded_features(spark, sf), ft.FEATURES)
    return d.select("symbol", day().alias("d"), *[r(f"{c}_z", 5).alias(f"{c}_z") for c in ft.FEATURES])


_VEC = ", ".join(f"CAST(coalesce({c}, 0) AS FLOAT)" for c in ft.FEATURES)


@Q.add("e24_state_tensor", ALL_FEATURES + f""", v AS (SELECT *, list([{_VEC}]) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ten FROM f)
  SELECT symbol, d, CAST(len(ten) AS BIGINT) AS steps, {o.rnd('CAST(ten[1][1] AS DOUBLE)', 4)} AS oldest, {o.rnd('CAST(ten[60][12] AS DOUBLE)', 4)} AS newest,
  {o.rnd('list_sum(list_transform(ten, lambda x: list_sum(list_transform(x, lambda y: CAST(y AS DOUBLE)))))', 4)} AS total FROM v WHERE i >= 60""")
def tensor(spark, sf):
    d = ft.state_tensor(rounded_features(spark, sf), ft.FEATURES)
    t = F.col("tensor")
    inner = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y.cast("double"))
    return d.select(
        "symbol", day().alias("d"), F.size(t).cast("bigint").alias("steps"),
        r(t[0][0].cast("double"), 4).alias("oldest"), r(t[59][11].cast("double"), 4).alias("newest"),
        r(F.aggregate(t, F.lit(0.0), lambda s, x: s + inner(x)), 4).alias("total"),
    )


@Q.add("e25_walk_forward", o.daily(
    """len AS (SELECT symbol, max(n) AS n FROM b GROUP BY symbol),
    f AS (SELECT symbol, n, k, k*63 AS train_start, k*63+252 AS train_end, least(k*63+315, n) AS test_end FROM len, range(0, 100000) r(k) WHERE k*63+252 < n),
    g AS (SELECT * FROM f WHERE train_start+315 <= n OR n-train_end >= 10)
    SELECT g.symbol, k AS fold, train_start, train_end, train_end AS test_start, test_end, count(*) AS test_bars, round(avg(close), 6)+0.0 AS mean_close
    FROM g JOIN b ON b.symbol = g.symbol AND b.i-1 >= train_end AND b.i-1 < test_end GROUP BY ALL"""))
def walk_forward(spark, sf):
    d = sg_folds(daily(spark, sf))
    return d.groupBy("symbol", "fold", "train_start", "train_end", "test_start", "test_end").agg(
        F.count("*").alias("test_bars"), r(F.avg("close")).alias("mean_close")
    )


def sg_folds(series):
    from tidebars.operators.folds import with_test_fold

    return with_test_fold(series)


@Q.add("e32_tick_bar", o.hourly(f"SELECT symbol, ds AS d, close, coalesce(lag(close) OVER {o.W}, close) AS open, greatest(close, lag(close) OVER {o.W}) AS high, least(close, lag(close) OVER {o.W}) AS low FROM b"))
def tick_bar(spark, sf):
    d = halo(hourly(spark, sf), 1)
    prev = F.lag("close").over(in_block())
    d = d.withColumn("p", prev)
    return owned(d).select("symbol", second().alias("d"), "close", F.coalesce("p", "close").alias("open"), F.greatest("close", "p").alias("high"), F.least("close", "p").alias("low"))


@Q.add("e32_ohlc_bar", o.hourly("SELECT symbol, ds AS d, open, high, low, close, volume FROM b"))
def ohlc_bar(spark, sf):
    return hourly(spark, sf).select("symbol", second().alias("d"), "open", "high", "low", "close", "volume")


@Q.add("e33_last_bars", o.daily("SELECT symbol, ds AS d, close FROM b WHERE i > n - 300"))
def last_bars(spark, sf):
    return daily(spark, sf).where("i > n - 300").select("symbol", day().alias("d"), "close")


@Q.add("h5_last_vols", o.daily(f"""rv AS (SELECT *, CASE WHEN i > 30 THEN stddev_samp(lr) OVER {o.over(-29)} END AS v FROM (SELECT *, ln(close/lag(close) OVER {o.W}) AS lr FROM b))
  SELECT symbol, ds AS d, CAST(count(v) OVER {o.over(-251)} AS BIGINT) AS vols, {o.rnd(f'max(v) OVER {o.over(-251)}', 8)} AS highest FROM rv"""))
def last_vols(spark, sf):
    d = halo(daily(spark, sf), 285).withColumn("lr", ft.log_return())
    d = d.withColumn("v", ft.full(ft.rolling_vol("lr", 30), 31))
    w = rows(-251)
    return owned(d.withColumn("c", F.count("v").over(w)).withColumn("m", F.max("v").over(w))).select("symbol", day().alias("d"), F.col("c").alias("vols"), r("m", 8).alias("highest"))
