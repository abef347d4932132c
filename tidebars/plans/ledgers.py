"""Registered queries: signals to positions, ledgers, trade logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.functions.hashing import normal
from tidebars.operators import ledger as lg
from tidebars.operators import regime as rg
from tidebars.operators import routing as rt
from tidebars.operators import signals as sg
from tidebars.operators.alignment import LEG_KEYS, aligned, portfolios
from tidebars.operators.denoise import denoise
from tidebars.operators.metrics import performance, ranked, with_returns
from tidebars.plans import oracle as o
from tidebars.plans.common import Registry, day, r
from tidebars.session import KEYS
from tidebars.sources.ticks import daily, kept

Q = Registry()
CK = [*KEYS, "config_id"]
PK = ["portfolio", "config_id"]
# Filter parameters go by leg: the first one's, and all others'.
LEGS = [(name, k, symbol, 0.5, *((0.3, 3.0) if k == 1 else (0.8, 8.0))) for name, pair in o.PAIRS.items() for k, symbol in enumerate(pair, 1)]
THREE = [("anr", k, symbol, 1 / 3, *((0.3, 3.0) if k == 1 else (0.8, 8.0))) for k, symbol in enumerate("ANR", 1)]
EQ = f"SELECT symbol, config_id, ds AS d, {o.rnd('v', 3)} AS v FROM eq"

PLAIN = [sg.Config("l2", 15, 80, 2.0), sg.Config("l1", 10, 40, 1.0)]
STOPPED = [sg.Config("tight", 15, 80, 2.0, 0.05), sg.Config("loose", 10, 40, 1.0, 0.12)]


def _eq(df):
    return df.select("symbol", "config_id", day().alias("d"), r("v", 3).alias("v"))


def plain_equity(spark, sf):
    return kept(spark, (sf, "plain-equity"), lambda: lg.single(sg.crossover(daily(spark, sf), PLAIN)))


def stopped_equity(spark, sf):
    return kept(spark, (sf, "stopped-equity"), lambda: lg.single(lg.with_stops(sg.crossover(daily(spark, sf), STOPPED), CK)))


Q.add("f1_equity", o.daily(o.crossover(PLAIN) + "," + o.LEDGER + " " + EQ))(
    lambda spark, sf: _eq(lg.single(sg.crossover(daily(spark, sf), PLAIN)))
)
Q.add("f2_stopped_equity", o.daily(o.crossover(STOPPED) + "," + o.LEDGER + " " + EQ))(
    lambda spark, sf: _eq(lg.single(lg.with_stops(sg.crossover(daily(spark, sf), STOPPED), CK)))
)

_GATE = [sg.Config("gated", 15, 80, 2.0, 0.08)]


@Q.add("f2_regime_backtest", o.daily(
    o.HYSTERESIS + ", br AS (SELECT b.*, reg.regime FROM b LEFT JOIN reg ON reg.symbol = b.symbol AND reg.i = b.i), "
    + o.crossover(_GATE, src="br").replace("WHEN i > 252 AND", "WHEN i > 252 AND regime <> 'EXTREME_VOLATILITY' AND")
    + "," + o.LEDGER + f""" SELECT symbol, ds AS d, {o.rnd('v', 3)} AS portfolio_value,
      CASE WHEN v <= 0 THEN 'LIQUIDATED' WHEN regime = 'EXTREME_VOLATILITY' THEN 'DQN' WHEN regime = 'HIGH_VOLATILITY' THEN 'A2C' WHEN regime = 'LOW_VOLATILITY' THEN 'DDPG' ELSE 'PPO' END AS active_agent,
      CASE WHEN v <= 0 THEN 'EXTREME_VOLATILITY' ELSE regime END AS regime, close AS price, {o.rnd('coalesce(v/nullif(pv, 0)-1, 0)', 8)} AS returns, {o.rnd('100000/c0*close', 3)} AS buy_and_hold
      FROM (SELECT eq.*, reg.regime, lag(v) OVER (PARTITION BY eq.symbol ORDER BY eq.i) AS pv, first_value(eq.close) OVER (PARTITION BY eq.symbol ORDER BY eq.i) AS c0
        FROM eq JOIN reg ON reg.symbol = eq.symbol AND reg.i = eq.i WHERE eq.i > 252)"""))
def regime_backtest(spark, sf):
    """The whole chain: regimes gate crossover signals (flat while the extreme-regime agent is active), stops, equity, baseline."""
    series = daily(spark, sf)
    routed = rg.with_regime(series).select(*KEYS, F.col("i").cast("bigint").alias("i"), "regime")
    routed = routed.withColumn("active_agent", rg.agent_of(F.col("regime"), rg.ROUTES_BY_CODE))
    sig = sg.crossover(series, _GATE).where(f"i >= {sg.START}").withColumn("i", F.col("i").cast("bigint"))
    d = sig.join(routed, [*KEYS, "i"], "left")
    gate = routed.select(*KEYS, (F.col("i") + 1).alias("i"), F.col("active_agent").alias("prev_agent"))
    d = d.join(gate, [*KEYS, "i"], "left")
    flat = lambda agent, s: F.when(F.col(agent) == "DQN", 0.0).otherwise(F.col(s))
    d = d.withColumns({"sig": flat("active_agent", "sig"), "prev_sig": flat("prev_agent", "prev_sig")})
    eq = lg.single(lg.with_stops(d, CK))
    eq = lg.liquidation_labels(eq.where(f"i > {sg.START}"))
    eq = with_returns(eq, CK, out="returns").withColumn("returns", F.when(F.col("i") == sg.START + 1, 0.0).otherwise(F.col("returns")))
    first = series.where(f"i = {sg.START + 1}").select(*KEYS, F.col("close").alias("c0"))
    return eq.join(first, list(KEYS)).select(
        "symbol", day().alias("d"), r("v", 3).alias("portfolio_value"), "active_agent", "regime", F.col("close").alias("price"),
        r("returns", 8).alias("returns"), r(lg.CAPITAL / F.col("c0") * F.col("close"), 3).alias("buy_and_hold"),
    )


# ── trade logs ───────────────────────────────────────────────────────────────────────────────────────
_LOG_SQL = o.daily(o.crossover(STOPPED) + "," + o.LEDGER + f""",
  pre AS (SELECT *, lag(sh, 1, 0) OVER w AS sh0, lag(v) OVER w AS v0 FROM eq WINDOW w AS (PARTITION BY symbol, config_id ORDER BY i)),
  tr0 AS (SELECT *, max(CASE WHEN traded = 1 AND sh > sh0 THEN i END) OVER (PARTITION BY symbol, config_id ORDER BY i) AS bi FROM pre WHERE traded = 1 AND v > 0),
  tl AS (SELECT a.*, e.close AS entry FROM tr0 a LEFT JOIN eq e ON e.symbol = a.symbol AND e.config_id = a.config_id AND e.i = a.bi)
  SELECT symbol, config_id, ds AS d, i AS step, CASE WHEN sh > sh0 THEN 'BUY' ELSE 'SELL' END AS action, {o.rnd('abs(sh-sh0)', 4)} AS qty, close AS price, {o.rnd('cost', 4)} AS cost,
  CASE WHEN sh > sh0 THEN close ELSE 0 END AS avg_entry_price, CASE WHEN sh > sh0 THEN 0 ELSE {o.rnd('sh0*(close-entry)', 3)} END AS realized_gross_pnl,
  CASE WHEN sh > sh0 THEN 0 ELSE {o.rnd('sh0*(close-entry)-cost', 3)} END AS realized_net_pnl, {o.rnd('sh', 4)} AS position_size FROM tl""")


def stopped_log(spark, sf):
    return kept(spark, (sf, "stopped-log"), lambda: lg.trade_log(stopped_equity(spark, sf)))


@Q.add("f17_trade_log", _LOG_SQL)
def trade_log(spark, sf):
    return stopped_log(spark, sf).select(
        "symbol", "config_id", day().alias("d"), "step", "action", r("qty", 4).alias("qty"), "price", r("cost", 4).alias("cost"), "avg_entry_price",
        r("realized_gross_pnl", 3).alias("realized_gross_pnl"), r("realized_net_pnl", 3).alias("realized_net_pnl"), r("position_size", 4).alias("position_size"),
    )


@Q.add("f14_realized_pnl", f"SELECT symbol, config_id, count(*) AS trades, {o.rnd('sum(realized_gross_pnl)', 1)} AS gross, {o.rnd('sum(realized_net_pnl)', 1)} AS net FROM ({_LOG_SQL}) GROUP BY symbol, config_id")
def realized(spark, sf):
    return stopped_log(spark, sf).groupBy("symbol", "config_id").agg(
        F.count("*").alias("trades"), r(F.sum("realized_gross_pnl"), 1).alias("gross"), r(F.sum("realized_net_pnl"), 1).alias("net")
    )


@Q.add("f15_lot_rounding", o.daily("SELECT symbol, ds AS d, CAST(trunc(100000/(close*10)) AS BIGINT)*10 AS units, CAST(trunc(-50000/(close*25)) AS BIGINT)*25 AS short_units FROM b"))
def lot_rounding(spark, sf):
    return daily(spark, sf).select("symbol", day().alias("d"), lg.lots(F.lit(100000.0), F.col("close"), 10).alias("units"), lg.lots(F.lit(-50000.0), F.col("close"), 25).alias("short_units"))


_RUIN = [sg.Config("l12", 5, 30, 12.0), sg.Config("l25", 2, 40, 25.0)]


@Q.add("f16_ruin", o.daily(o.crossover(_RUIN) + "," + o.LEDGER + f" SELECT symbol, config_id, count(*) FILTER (v <= 0) AS dead_bars, min(CASE WHEN v <= 0 THEN ds END) AS ruined_on, {o.rnd('max(v)', 2)} AS best FROM eq GROUP BY symbol, config_id"))
def ruin(spark, sf):
    eq = lg.single(sg.crossover(daily(spark, sf), _RUIN))
    dead = F.col("v") <= 0
    return eq.groupBy("symbol", "config_id").agg(
        F.count(F.when(dead, 1)).alias("dead_bars"), F.min(F.when(dead, day())).alias("ruined_on"), r(F.max("v"), 2).alias("best")
    )


# ── shared-cash portfolios ───────────────────────────────────────────────────────────────────────────
def pair(spark, sf):
    return kept(spark, (sf, "pair"), lambda: aligned(daily(spark, sf), portfolios(spark, LEGS)))


def pair_denoised(spark, sf):
    return kept(spark, (sf, "pair-denoised"), lambda: denoise(pair(spark, sf), "adaptive", LEG_KEYS, q="q", r="r"))


def _sized(sig):
    return sig.withColumn("weight", F.lit(0.5))


def _joint(sig, trade=None, **kw):
    return lg.joint(lg.wide(_sized(sig), PK, trade), PK, **kw)


def _joint_out(eq):
    return eq.select("portfolio", "config_id", day().alias("d"), r("v", 2).alias("v"), F.col("trades").cast("bigint").alias("trades"))


_SEL = f"SELECT config_id, strftime(d, '%Y-%m-%d') AS d, {o.rnd('v', 2)} AS v, CAST(trades AS BIGINT) AS trades FROM eq"


def _x(cfgs, leg, price="close", src="b"):
    """Crossover signals of one leg's configs as SQL table ``x{leg}``."""
    sql = o.crossover(cfgs, price, src).replace("cfg(", f"cfg{leg}(").replace("CROSS JOIN cfg", f"CROSS JOIN cfg{leg}").replace("cfg.config_id", f"cfg{leg}.config_id")
    return sql.replace("sm AS", f"sm{leg} AS").replace("FROM sm ", f"FROM sm{leg} ").replace("sm.symbol", f"sm{leg}.symbol").replace("x AS MAT", f"x{leg} AS MAT")


def _legs_sql(cfgs, symbols, price="close", src="b", noise=None):
    """SQL table ``j`` for a portfolio from one crossover config list for each leg."""
    ks = range(1, len(symbols) + 1)
    sig = (lambda k: f"x{k}.sig") if noise is None else lambda k: f"least(1.0, greatest(0.0, x{k}.sig + {noise}*" + o.normal(f"(x{k}.config_id || '/' || x{k}.symbol)", f"x{k}.i") + "))"
    cols = ", ".join(f"x{k}.close AS c{k}, {sig(k)} AS s{k}, {'0.5' if len(symbols) == 2 else f'1.0/{len(symbols)}'}*x{k}.leverage AS w{k}, x{k}.stop AS st{k}, false AS t{k}" for k in ks)
    joins = " ".join(f"JOIN x{k} ON x1.config_id = x{k}.config_id AND x1.i = x{k}.i AND x{k}.symbol = '{symbols[k - 1]}'" for k in ks if k > 1)
    return ", ".join(_x(c, k, price, src) for k, c in enumerate(cfgs, 1)) + f", j AS MATERIALIZED (SELECT x1.config_id, x1.i, x1.d, x1.bb, x1.ss, {cols} FROM x1 {joins} WHERE x1.symbol = '{symbols[0]}')"


def _j(cfg_a, cfg_r, price="close", src="b", noise=None):
    return _legs_sql([cfg_a, cfg_r], "AR", price, src, noise)


def _both(name, a, b):
    """Config for leg 1 and leg 2 under one id."""
    return [sg.Config(name, *a, only_leg=1), sg.Config(name, *b, only_leg=2)]


_J1, _J2 = (15, 80, 2.0, 0.15, 5.0, 15.0), (10, 40, 1.5, 0.12, 5.0, 15.0)
_JOINT = _both("joint", _J1, _J2) + _both("tight", (15, 80, 2.0, 0.04, 5.0, 15.0), (10, 40, 1.5, 0.05, 5.0, 15.0))


def _leg(cfgs, leg):
    return [c for c in cfgs if c.only_leg in (0, leg)]


def _pair_kalman():
    src = o.ATR + ", ba AS (SELECT b.*, a.atr, CASE WHEN symbol = 'A' THEN 0.3 ELSE 0.8 END AS bq, CASE WHEN symbol = 'A' THEN 3.0 ELSE 8.0 END AS br FROM b LEFT JOIN atr a USING (symbol, i)), "
    return src + o.kalman("bq", "br", "ba", o.ADAPTIVE.format(r="br"))


@Q.add("f3_joint_ledger", o.portfolios(_pair_kalman() + ", " + _j(_leg(_JOINT, 1), _leg(_JOINT, 2), "kalman_price", "k") + "," + o.joint(2) + " " + _SEL))
def joint_ledger(spark, sf):
    sig = sg.crossover(pair_denoised(spark, sf), _JOINT, "kalman_price", keys=LEG_KEYS)
    return _joint_out(_joint(lg.with_stops(sig, [*LEG_KEYS, "config_id"])))


_J3 = (12, 60, 1.0, 0.08, 5.0, 15.0)
_JOINT3 = [sg.Config("joint", *p, only_leg=k) for k, p in enumerate((_J1, _J2, _J3), 1)]


@Q.add("f3_three_legs", o.aligned_three(_pair_kalman() + ", " + _legs_sql([_leg(_JOINT3, k) for k in (1, 2, 3)], "ANR", "kalman_price", "k") + "," + o.joint(3) + f" SELECT 'anr' AS portfolio, * FROM ({_SEL})"))
def three_legs(spark, sf):
    """One portfolio of all symbols, on the bars that all of them have."""
    legs = denoise(aligned(daily(spark, sf), portfolios(spark, THREE)), "adaptive", LEG_KEYS, q="q", r="r")
    sig = lg.with_stops(sg.crossover(legs, _JOINT3, "kalman_price", keys=LEG_KEYS), [*LEG_KEYS, "config_id"])
    return _joint_out(lg.joint(lg.wide(sig.withColumn("weight", F.lit(1 / 3)), PK), PK))


_GRID = sg.sma_grid(1.5)


def grid_equity(spark, sf):
    return kept(spark, (sf, "pair-grid"), lambda: _joint(sg.crossover(pair_denoised(spark, sf), _GRID, "kalman_price", keys=LEG_KEYS)))


@Q.add("f4_sma_grid", o.portfolios(_pair_kalman() + ", " + _j(_GRID, _GRID, "kalman_price", "k") + "," + o.joint(2) + " " + _SEL))
def sma_grid(spark, sf):
    return _joint_out(grid_equity(spark, sf))


_MOM = [sg.Config("momentum", 1, 252, 2.0, only_leg=1), sg.Config("momentum", 1, 252, 1.5, only_leg=2)]


@Q.add("f5_momentum", o.portfolios(f"""ms AS (SELECT *, CASE WHEN i > 252 AND lag(on_) OVER {o.W} = 1 THEN 1.0 ELSE 0.0 END AS sig FROM (SELECT *, CASE WHEN close > {o.mean('close', 252)} THEN 1 ELSE 0 END AS on_ FROM b)),
  j AS MATERIALIZED (SELECT 'momentum' AS config_id, a.i, a.d, 0.0005 AS bb, 0.0015 AS ss, a.close AS c1, r.close AS c2, a.sig AS s1, r.sig AS s2, 1.0 AS w1, 0.75 AS w2, 9.0 AS st1, 9.0 AS st2, false AS t1, false AS t2
    FROM ms a JOIN ms r ON a.i = r.i AND a.symbol = 'A' AND r.symbol = 'R'),""" + o.joint(2) + " " + _SEL))
def momentum(spark, sf):
    return _joint_out(_joint(sg.momentum(pair(spark, sf), _MOM, keys=LEG_KEYS)))


@Q.add("f6_monthly_rebalance", o.portfolios(f"""mo AS (SELECT *, (month(d) <> lag(month(d)) OVER {o.W} OR i = 253) AND i > 252 AS t FROM b),
  j AS MATERIALIZED (SELECT 'monthly' AS config_id, a.i, a.d, 0.0005 AS bb, 0.0015 AS ss, a.close AS c1, r.close AS c2, CASE WHEN a.i > 252 THEN 1.0 ELSE 0.0 END AS s1, CASE WHEN a.i > 252 THEN 1.0 ELSE 0.0 END AS s2, 1.0 AS w1, 0.75 AS w2, 9.0 AS st1, 9.0 AS st2, a.t AS t1, r.t AS t2
    FROM mo a JOIN mo r ON a.i = r.i AND a.symbol = 'A' AND r.symbol = 'R'),""" + o.joint(2) + " " + _SEL))
def monthly(spark, sf):
    d = sg.month_starts(pair(spark, sf), keys=LEG_KEYS)
    d = sg.with_configs(d, [sg.Config("monthly", leverage=2.0, only_leg=1), sg.Config("monthly", leverage=1.5, only_leg=2)])
    d = d.withColumns({"sig": F.when(F.col("i") > sg.START, 1.0).otherwise(0.0), "prev_sig": F.lit(0.0)})
    return _joint_out(_joint(d, F.col("rebalance")))


_RAW = [sg.Config("raw", 10, 50, 2.0, only_leg=1), sg.Config("raw", 10, 50, 1.5, only_leg=2)]


@Q.add("f7_raw_sma", o.portfolios(_j(_leg(_RAW, 1), _leg(_RAW, 2)) + "," + o.joint(2) + " " + _SEL))
def raw_sma(spark, sf):
    return _joint_out(_joint(sg.crossover(pair(spark, sf), _RAW, keys=LEG_KEYS)))


_FEE = [c for k, (b, s) in sg.FEES.items() for c in _both(k, (15, 80, 2.0, 0.15, b, s), (10, 40, 1.5, 0.12, b, s))]


def fee_equity(spark, sf):
    def make():
        sig = sg.crossover(pair_denoised(spark, sf), _FEE, "kalman_price", keys=LEG_KEYS)
        return _joint(lg.with_stops(sig, [*LEG_KEYS, "config_id"]))

    return kept(spark, (sf, "pair-fees"), make)


_FEE_SQL = _pair_kalman() + ", " + _j(_leg(_FEE, 1), _leg(_FEE, 2), "kalman_price", "k") + "," + o.joint(2)


@Q.add("f8_fee_sweep", o.portfolios(_FEE_SQL + " " + _SEL))
def fee_sweep(spark, sf):
    return _joint_out(fee_equity(spark, sf))


_SEEDS = [c for k in range(1, 21) for c in _both(f"seed{k}", _J1, _J2)]


def _seed_equity(spark, sf, sigma):
    def make():
        sig = sg.crossover(pair_denoised(spark, sf), _SEEDS, "kalman_price", keys=LEG_KEYS).where(f"i > {sg.START}")
        noise = sigma * normal(F.concat("config_id", F.lit("/"), "symbol"), F.col("i"))
        sig = sig.withColumn("sig", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sig") + noise)))
        sig = lg.with_threshold(sig, [*LEG_KEYS, "config_id"])
        return _joint(sig, F.col("moved"))

    return kept(spark, (sf, "seeds", sigma), make)


def _seed_sql(sigma):
    return _pair_kalman() + ", " + _j(_leg(_SEEDS, 1), _leg(_SEEDS, 2), "kalman_price", "k", noise=sigma) + "," + o.joint(2, "(abs(e{k}-p{k}) > 0.05)")


def _seed_query(name, sigma):
    sql = _seed_sql(sigma).replace("j AS MATERIALIZED (SELECT", "j0 AS (SELECT", 1).replace(
        "WHERE x1.symbol = 'A'),", "WHERE x1.symbol = 'A'), j AS MATERIALIZED (SELECT * REPLACE (CASE WHEN i > 252 THEN s1 ELSE 0 END AS s1, CASE WHEN i > 252 THEN s2 ELSE 0 END AS s2) FROM j0),", 1)
    Q.add(name, o.portfolios(sql + f" SELECT config_id, {o.rnd('100*(max_by(v, i)/100000-1)', 4)} AS return_pct, CAST(sum(trades) AS BIGINT) AS trades FROM eq WHERE i > 252 GROUP BY config_id"))(
        lambda spark, sf: _seed_equity(spark, sf, sigma).groupBy(*PK).agg(
            r(100 * (F.max_by("v", "i") / lg.CAPITAL - 1), 4).alias("return_pct"), F.sum("trades").alias("trades")))


_seed_query("f9_perturbed_low", 0.02)
_seed_query("f9_perturbed_high", 0.08)


# ── sizing columns ───────────────────────────────────────────────────────────────────────────────────
_PAIR_VOL = o.REGIME


def pair_vol(spark, sf):
    from tidebars.operators.blocks import owned

    return owned(rg.with_volatility(pair(spark, sf), keys=LEG_KEYS)).where(f"i > {sg.START}")


@Q.add("f10_inverse_vol_weights", o.portfolios(_PAIR_VOL + f""" SELECT symbol, ds AS d, {o.rnd('CASE WHEN lo > 0 THEN (1/vol)/tot ELSE 0.5 END', 8)} AS weight
  FROM (SELECT *, min(vol) OVER (PARTITION BY d) AS lo, sum(1/nullif(vol, 0)) OVER (PARTITION BY d) AS tot FROM raw WHERE i > 252)"""))
def inverse_vol(spark, sf):
    return pair_vol(spark, sf).select("portfolio", "symbol", day().alias("d"), r(rt.inverse_vol_weight(), 8).alias("weight"))


@Q.add("f11_vol_target_leverage", o.portfolios(_PAIR_VOL + f" SELECT symbol, ds AS d, {o.rnd("CASE WHEN vol > 0 THEN least(5.0, greatest(1.0, 5*CASE symbol WHEN 'A' THEN 0.006 ELSE 0.015 END/vol)) ELSE 5.0 END", 8)} AS leverage FROM raw WHERE i > 252"))
def vol_target(spark, sf):
    return pair_vol(spark, sf).select("portfolio", "symbol", day().alias("d"), r(rt.vol_target_leverage(), 8).alias("leverage"))


_AGENT_SQL = "CASE regime WHEN 'EXTREME_VOLATILITY' THEN 'DQN' WHEN 'HIGH_VOLATILITY' THEN 'A2C' WHEN 'LOW_VOLATILITY' THEN 'DDPG' ELSE 'PPO' END"
_STOP_SQL = "CASE WHEN symbol = 'A' THEN CASE agent WHEN 'DQN' THEN 0.015 WHEN 'A2C' THEN 0.02 WHEN 'DDPG' THEN 0.03 ELSE 0.05 END ELSE CASE agent WHEN 'DQN' THEN 0.008 WHEN 'A2C' THEN 0.01 WHEN 'DDPG' THEN 0.015 ELSE 0.02 END END"


@Q.add("f12_regime_stops", o.portfolios(o.HYSTERESIS + f" SELECT symbol, ds AS d, agent, CAST({_STOP_SQL} AS DOUBLE) AS stop FROM (SELECT *, {_AGENT_SQL} AS agent FROM reg)"))
def regime_stops(spark, sf):
    d = rg.with_regime(pair(spark, sf), keys=LEG_KEYS).withColumn("agent", rg.agent_of(F.col("regime"), rg.ROUTES_BY_CODE))
    return d.select("portfolio", "symbol", day().alias("d"), "agent", rt.agent_stop(F.col("agent"), F.col("leg")).alias("stop"))


# ── routing study ────────────────────────────────────────────────────────────────────────────────────
_ROUTES_SQL = """pm AS (SELECT a || '|' || b_ || '|' || c || '|' || e AS config_id, a, b_, c, e FROM (VALUES ('DQN'), ('PPO'), ('DDPG'), ('A2C')) v1(a), (VALUES ('DQN'), ('PPO'), ('DDPG'), ('A2C')) v2(b_),
  (VALUES ('DQN'), ('PPO'), ('DDPG'), ('A2C')) v3(c), (VALUES ('DQN'), ('PPO'), ('DDPG'), ('A2C')) v4(e) WHERE a <> b_ AND a <> c AND a <> e AND b_ <> c AND b_ <> e AND c <> e)"""
_ROUTED_SQL = o.HYSTERESIS + ", " + _ROUTES_SQL + f""",
  td AS (SELECT symbol, i, CASE WHEN i > 30 AND avg(close) OVER {o.over(-10, -1)} > avg(close) OVER {o.over(-30, -1)} THEN 1.0 ELSE -1.0 END AS trend FROM b),
  sz AS (SELECT reg.*, trend, (1/vol)/sum(1/vol) OVER (PARTITION BY d) * least(5.0, greatest(1.0, 5*CASE reg.symbol WHEN 'A' THEN 0.006 ELSE 0.015 END/vol)) AS size FROM reg JOIN td ON td.symbol = reg.symbol AND td.i = reg.i),
  ag AS (SELECT sz.*, config_id, CASE regime WHEN 'LOW_VOLATILITY' THEN a WHEN 'NORMAL_VOLATILITY' THEN b_ WHEN 'HIGH_VOLATILITY' THEN c ELSE e END AS agent FROM sz CROSS JOIN pm),
  lg AS (SELECT config_id, symbol, i, d, close, size, CAST({_STOP_SQL} AS DOUBLE) AS stop, trend*CASE agent WHEN 'DQN' THEN 0.5 WHEN 'PPO' THEN 0.95 WHEN 'DDPG' THEN 0.75 ELSE 0.8 END AS sig FROM ag),
  j AS MATERIALIZED (SELECT x.config_id, x.i, x.d, x.close AS c1, y.close AS c2, x.sig AS s1, y.sig AS s2, x.size AS w1, y.size AS w2, x.stop AS st1, y.stop AS st2
    FROM lg x JOIN lg y ON x.config_id = y.config_id AND x.i = y.i AND x.symbol = 'A' AND y.symbol = 'R'
    UNION ALL SELECT config_id, 252, NULL, 1, 1, 0, 0, 0, 0, 9, 9 FROM pm),
  led(config_id, i, cash, h1, h2, l1, l2, k1, k2, o1, o2, v, dead, trades) AS (
  SELECT config_id, CAST(252 AS BIGINT), CAST(100000 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), false, false, CAST(100000 AS DOUBLE), false, 0 FROM pm
  UNION ALL SELECT config_id, i, cash-(g1-h1)*c1-f1-(g2-h2)*c2-f2, g1, g2, a1, a2,
    CASE WHEN a1 <> l1 AND g1 > 1e-5 AND g1 > h1 THEN greatest(q1, c1) ELSE q1 END, CASE WHEN a2 <> l2 AND g2 > 1e-5 AND g2 > h2 THEN greatest(q2, c2) ELSE q2 END,
    CASE WHEN a1 <> l1 THEN g1 > 1e-5 ELSE o1 END, CASE WHEN a2 <> l2 THEN g2 > 1e-5 ELSE o2 END,
    CASE WHEN gone THEN 0 ELSE pv-f1-f2 END, gone, CASE WHEN gone THEN 0 ELSE (a1 <> l1)::INT + (a2 <> l2)::INT END
  FROM (SELECT *, abs(g1-h1)*c1*CASE WHEN g1 > h1 THEN 0.0005 ELSE 0.0015 END AS f1, abs(g2-h2)*c2*CASE WHEN g2 > h2 THEN 0.0005 ELSE 0.0015 END AS f2 FROM (
    SELECT *, CASE WHEN a1 = l1 THEN h1 WHEN a1 > 0 THEN a1*pv*w1/c1 ELSE h1*(1+a1) END AS g1, CASE WHEN a2 = l2 THEN h2 WHEN a2 > 0 THEN a2*pv*w2/c2 ELSE h2*(1+a2) END AS g2 FROM (
    SELECT *, CASE WHEN o1 AND (q1-c1)/q1 > st1 THEN -1.0 ELSE s1 END AS a1, CASE WHEN o2 AND (q2-c2)/q2 > st2 THEN -1.0 ELSE s2 END AS a2 FROM (
    SELECT x.*, r.cash, r.h1, r.h2, r.l1, r.l2, r.o1, r.o2, CASE WHEN r.o1 THEN greatest(r.k1, x.c1) ELSE r.k1 END AS q1, CASE WHEN r.o2 THEN greatest(r.k2, x.c2) ELSE r.k2 END AS q2,
      r.cash+r.h1*x.c1+r.h2*x.c2 AS pv, (r.dead OR r.cash+r.h1*x.c1+r.h2*x.c2 <= 0) AS gone FROM led r JOIN j x ON x.config_id = r.config_id AND x.i = r.i+1))))),
  eq AS MATERIALIZED (SELECT led.config_id, led.i, led.v, led.trades, j.d FROM led JOIN j ON j.config_id = led.config_id AND j.i = led.i WHERE led.i > 252)"""


def routing_equity(spark, sf):
    return kept(spark, (sf, "routing"), lambda: lg.routed(rt.wide_legs(rt.routed_legs(pair(spark, sf))), PK))


@Q.add("f13_routing_ablation", o.portfolios(_ROUTED_SQL + ", " + o.perf(keys="config_id") + f""", tt AS (SELECT config_id, CAST(sum(trades) AS BIGINT) AS trades FROM eq GROUP BY config_id)
  SELECT config_id, {o.rnd('cum_return')} AS cum_return, {o.rnd('sharpe')} AS sharpe, {o.rnd('max_drawdown')} AS max_drawdown, trades, row_number() OVER (ORDER BY sharpe DESC, config_id) AS rank, config_id = 'DQN|PPO|DDPG|A2C' AS is_proposed FROM p JOIN tt USING (config_id)"""))
def routing(spark, sf):
    eq = routing_equity(spark, sf)
    m = performance(eq, PK).join(eq.groupBy(*PK).agg(F.sum("trades").alias("trades")), PK)
    d = ranked(m, within=("portfolio",))
    return d.select("portfolio", "config_id", *[r(c).alias(c) for c in ("cum_return", "sharpe", "max_drawdown")], "trades", F.col("rank").cast("bigint").alias("rank"), (F.col("config_id") == "DQN|PPO|DDPG|A2C").alias("is_proposed"))


@Q.add("c6_mapping_permutations", o.daily(o.HYSTERESIS + ", " + _ROUTES_SQL + """ SELECT config_id, symbol, count(*) FILTER (agent = 'DQN') AS cautious_bars, count(*) FILTER (agent = 'PPO') AS trend_bars FROM (
  SELECT symbol, config_id, CASE regime WHEN 'LOW_VOLATILITY' THEN a WHEN 'NORMAL_VOLATILITY' THEN b_ WHEN 'HIGH_VOLATILITY' THEN c ELSE e END AS agent FROM reg CROSS JOIN pm) GROUP BY config_id, symbol"""))
def permutations_of_mappings(spark, sf):
    d = rt.with_mappings(rg.with_regime(daily(spark, sf)))
    return d.groupBy("config_id", "symbol").agg(F.count(F.when(F.col("agent") == "DQN", 1)).alias("cautious_bars"), F.count(F.when(F.col("agent") == "PPO", 1)).alias("trend_bars"))
