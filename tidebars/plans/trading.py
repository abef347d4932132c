"""Registered queries: action ledgers, rewards, order sizing, equity columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import ledger as lg
from tidebars.operators import metrics as mt
from tidebars.operators import orders as od
from tidebars.operators import rewards as rw
from tidebars.operators import signals as sg
from tidebars.operators.blocks import halo, owned
from tidebars.operators.features import simple_return
from tidebars.plans import oracle as o
from tidebars.plans.common import Registry, day, r
from tidebars.plans.ledgers import CK, PLAIN, plain_equity
from tidebars.session import KEYS
from tidebars.sources.ticks import daily, kept, table

Q = Registry()
_EQ = o.crossover(PLAIN) + "," + o.LEDGER

# ── ledger of an action table ────────────────────────────────────────────────────────────────────────
_CODE = "CAST(least(4, greatest(0, floor(coalesce(close/lag(close) OVER (PARTITION BY symbol ORDER BY i)-1, 0)*100+2.5))) AS INT)"
_ACT = f"""ac AS MATERIALIZED (SELECT *, CASE code WHEN 0 THEN -1.0 WHEN 1 THEN -0.5 WHEN 2 THEN 0.0 WHEN 3 THEN 0.5 ELSE 1.0 END AS action FROM (SELECT *, {_CODE} AS code FROM b)),
env(symbol, i, cash, sh, v, cost) AS (SELECT symbol, CAST(0 AS BIGINT), CAST(100000 AS DOUBLE), CAST(0 AS DOUBLE), CAST(100000 AS DOUBLE), CAST(0 AS DOUBLE) FROM ac WHERE i = 1
  UNION ALL SELECT symbol, i, cash-q*px-q_cost, sh+q, cash-q*px-q_cost+(sh+q)*px, q_cost FROM (
    SELECT *, CASE WHEN q > 0 THEN q*px*0.0005 ELSE -q*px*0.0015 END AS q_cost FROM (
    SELECT *, CASE WHEN abs(tgt-sh)*px < 100 THEN 0 WHEN tgt > sh AND (tgt-sh)*px*1.0005 > cash THEN cash/1.0005/px ELSE tgt-sh END AS q FROM (
    SELECT x.symbol, x.i, x.close AS px, e.cash, e.sh, CASE WHEN x.action > 0 THEN x.action*0.95*(e.cash+e.sh*x.close)/x.close WHEN x.action < 0 THEN greatest(e.sh*(1+x.action), 0) ELSE e.sh END AS tgt
    FROM env e JOIN ac x ON x.symbol = e.symbol AND x.i = e.i+1 WHERE e.v >= 1000)))),
ev AS MATERIALIZED (SELECT ac.symbol, ac.i, ds, d, close, action, cash, sh, v, cost FROM env JOIN ac ON ac.symbol = env.symbol AND ac.i = env.i WHERE env.i > 0)"""


def coded(spark, sf):
    """Bars with a discrete action read off the last return: strong falls sell, strong rises buy."""
    d = halo(daily(spark, sf), 1).withColumn("ret", F.coalesce(simple_return(), F.lit(0.0)))
    code = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("ret") * 100 + 2.5))).cast("int")
    return owned(d.withColumn("code", code)).withColumn("action", od.action_fraction(F.col("code")))


def action_ledger(spark, sf):
    return kept(spark, (sf, "action-ledger"), lambda: lg.from_actions(coded(spark, sf)))


@Q.add("b5_action_map", o.daily(_ACT + " SELECT symbol, ds AS d, code, action FROM ac"))
def action_map(spark, sf):
    return coded(spark, sf).select("symbol", day().alias("d"), "code", "action")


@Q.add("f20_action_ledger", o.daily(_ACT + f" SELECT symbol, ds AS d, action, {o.rnd('cash', 3)} AS cash, {o.rnd('sh', 5)} AS shares, {o.rnd('v', 3)} AS v, {o.rnd('cost', 5)} AS cost FROM ev"))
def actions(spark, sf):
    return action_ledger(spark, sf).select("symbol", day().alias("d"), "action", r("cash", 3).alias("cash"), r("shares", 5).alias("shares"), r("v", 3).alias("v"), r("cost", 5).alias("cost"))


@Q.add("f21_portfolio_state", o.daily(_ACT + f" SELECT symbol, ds AS d, {o.rnd('cash/greatest(v, 1e-8)', 7)} AS cash_ratio, {o.rnd('sh*close/greatest(v, 1e-8)', 7)} AS position_ratio, {o.rnd('(v-100000)/100000', 7)} AS pnl_ratio FROM ev"))
def state(spark, sf):
    return lg.portfolio_state(action_ledger(spark, sf)).select("symbol", day().alias("d"), *[r(c, 7).alias(c) for c in ("cash_ratio", "position_ratio", "pnl_ratio")])


_REW = _ACT + f""", r0 AS (SELECT *, v-coalesce(lag(v) OVER {o.W}, 100000) AS dv, (v-coalesce(lag(v) OVER {o.W}, 100000))/greatest(coalesce(lag(v) OVER {o.W}, 100000), 1e-8) AS r, coalesce(lag(action) OVER {o.W}, 0) AS pa FROM ev),
r1 AS (SELECT *, count(r) OVER w AS cn, avg(r) OVER w AS m, stddev_samp(r) OVER w AS sd, sqrt(avg(CASE WHEN r < 0.05/252 THEN pow(r-0.05/252, 2) END) OVER w) AS dn,
  greatest(100000, max(v) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)) AS peak FROM r0 WINDOW w AS {o.over(-29)}),
r2 AS (SELECT *, CASE WHEN cn >= 2 AND sd >= 1e-10 THEN (m-0.05/252)/sd ELSE 0 END AS sr, CASE WHEN cn >= 2 AND dn >= 1e-10 THEN (m-0.05/252)/dn ELSE 0 END AS so, greatest((peak-v)/peak, 0) AS dd FROM r1)"""


def rewards_table(spark, sf):
    return kept(spark, (sf, "rewards"), lambda: rw.with_rewards(action_ledger(spark, sf), KEYS))


for _name, _cols in {
    "e27_rolling_sharpe": {"sharpe_roll": "sr"}, "e28_rolling_sortino": {"sortino_roll": "so"}, "e30_drawdown_fraction": {"dd": "dd"},
}.items():
    def _run(spark, sf, cols=tuple(_cols)):
        return rewards_table(spark, sf).select("symbol", day().alias("d"), *[r(c).alias(c) for c in cols])

    Q.add(_name, o.daily(_REW + " SELECT symbol, ds AS d, " + ", ".join(f"{o.rnd(s)} AS {c}" for c, s in _cols.items()) + " FROM r2"))(_run)


@Q.add("e31_rewards", o.daily(_REW + f" SELECT symbol, ds AS d, {o.rnd('dv-0.5*dd-abs(action-pa)*cost+0.1*sr', 3)} AS reward_risk, {o.rnd('dv', 3)} AS reward_pnl, {o.rnd('dv+0.1*so', 3)} AS reward_sortino FROM r2"))
def rewards(spark, sf):
    return rewards_table(spark, sf).select("symbol", day().alias("d"), *[r(c, 3).alias(c) for c in ("reward_risk", "reward_pnl", "reward_sortino")])


@Q.add("e26_equity_returns", o.daily(_EQ + f" SELECT symbol, config_id, ds AS d, {o.rnd('coalesce(v/nullif(lag(v) OVER (PARTITION BY symbol, config_id ORDER BY i), 0)-1, 0)', 8)} AS r FROM eq"))
def equity_returns(spark, sf):
    return mt.with_returns(plain_equity(spark, sf), CK).select("symbol", "config_id", day().alias("d"), r("r", 8).alias("r"))


@Q.add("e29_trade_islands", o.daily(o.crossover(PLAIN) + """, ch AS (SELECT *, CASE WHEN sig = 1 AND coalesce(lag(sig) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st FROM x WHERE i >= 252 WINDOW w AS (PARTITION BY symbol, config_id ORDER BY i)),
  il AS (SELECT *, sum(st) OVER (PARTITION BY symbol, config_id ORDER BY i) AS k FROM ch)
  SELECT symbol, config_id, min(ds) AS d, min(i) AS start, count(*) AS bars FROM il WHERE sig = 1 GROUP BY symbol, config_id, k"""))
def islands(spark, sf):
    d = lg.holding_start(sg.crossover(daily(spark, sf), PLAIN).where(f"i >= {sg.START}"), CK).where("sig > 0")
    return d.groupBy("symbol", "config_id", "held_from").agg(day(F.min("ts")).alias("d"), F.count("*").alias("bars")).select("symbol", "config_id", "d", F.col("held_from").cast("bigint").alias("start"), "bars")


# ── orders ───────────────────────────────────────────────────────────────────────────────────────────
def supplier_positions(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_quantity").cast("string").alias("qty"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"),
    )
    return od.signed_positions(rows)


def supplier_prices(spark, sf):
    li = table(spark, sf, "lineitem")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    px = li.select(F.col("l_suppkey").cast("string").alias("symbol"), at.alias("at"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"))
    return od.latest(px, "symbol", "price", F.col("at"))


def supplier_targets(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("symbol"), od.clip(F.col("s_acctbal") / 10000, -1.0, 1.0).alias("action"))


_POS = "pos AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS qty FROM lineitem GROUP BY 1)"
_PX = "px AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, max_by(round(l_extendedprice/l_quantity, 2), {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_extendedprice, 'f': l_quantity}) AS price FROM lineitem GROUP BY 1)"
_TG = "tg AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, greatest(-1.0, least(1.0, s_acctbal/10000)) AS action FROM supplier)"


@Q.add("a14_signed_positions", f"WITH {_POS} SELECT symbol, qty FROM pos")
def positions(spark, sf):
    return supplier_positions(spark, sf)


@Q.add("a14_position_lookup", f"WITH {_POS} SELECT CAST(s_suppkey AS VARCHAR) AS symbol, coalesce(qty, 0) AS qty FROM supplier LEFT JOIN pos ON pos.symbol = CAST(s_suppkey AS VARCHAR)")
def position_lookup(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return s.join(supplier_positions(spark, sf), "symbol", "left").select("symbol", F.coalesce("qty", F.lit(0.0)).alias("qty"))


_ORD = f"""WITH {_POS}, {_PX}, {_TG}, od AS (SELECT symbol, action, price, CAST(trunc(5000000*action/(price*@lot)) AS BIGINT) AS target_qty, CAST(trunc(coalesce(qty, 0)) AS BIGINT) AS held_qty
  FROM tg LEFT JOIN pos USING (symbol) LEFT JOIN px USING (symbol) WHERE price > 0)
  SELECT symbol, action, price, target_qty, held_qty, CASE WHEN target_qty > held_qty THEN 'buy' ELSE 'sell' END AS side, abs(target_qty-held_qty) AS order_qty FROM od WHERE target_qty <> held_qty"""


@Q.add("f18_order_sizing", _ORD.replace("@lot", "1"))
def order_sizing(spark, sf):
    return od.size_orders(supplier_targets(spark, sf), supplier_positions(spark, sf), supplier_prices(spark, sf), 5_000_000.0)


@Q.add("c9_targets_positions_prices", _ORD.replace("@lot", "10"))
def lot_orders(spark, sf):
    return od.size_orders(supplier_targets(spark, sf), supplier_positions(spark, sf), supplier_prices(spark, sf), 5_000_000.0, lot=10)


_MARGIN = [sg.Config("m", 10, 40, 4.0)]


@Q.add("f19_margin_scaling", o.daily(o.crossover(_MARGIN) + f""", rq AS (SELECT *, sig*0.5*100000*leverage AS req FROM x WHERE i > 252), tt AS (SELECT d, sum(req) AS total FROM rq GROUP BY d)
  SELECT symbol, ds AS d, req AS required, {o.rnd('CASE WHEN total > 0.95*400000 THEN 0.95*400000/total ELSE 1 END', 8)} AS factor, {o.rnd('req*CASE WHEN total > 0.95*400000 THEN 0.95*400000/total ELSE 1 END', 4)} AS scaled FROM rq JOIN tt USING (d)"""))
def margin(spark, sf):
    sig = sg.crossover(daily(spark, sf), _MARGIN).where(f"i > {sg.START}")
    d = od.margin_scaled(sig, ["ts"], 100_000.0, 400_000.0)
    return d.select("symbol", day().alias("d"), "required", r("factor", 8).alias("factor"), r("scaled", 4).alias("scaled"))
