"""Registered queries: bootstrap, predictive-ability test, paired test, trade shuffling, the combined study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidebars.functions.hashing import uniform
from tidebars.functions.stats import paired_t
from tidebars.operators import metrics as mt
from tidebars.operators import resample as rs
from tidebars.operators import signals as sg
from tidebars.plans import oracle as o
from tidebars.plans.common import Registry, r
from tidebars.plans.ledgers import _GRID, _j, _pair_kalman, _seed_equity, _seed_sql, CK, PK, PLAIN, grid_equity, plain_equity
from tidebars.sources.ticks import kept

Q = Registry()
# Replicates of the bootstrap and the shuffle, and of the predictive-ability test.
REPS, SPA_REPS = 1000, 100


def strategy_returns(spark, sf):
    """Out-of-sample returns of the plain equity curves, re-numbered from 1."""
    def make():
        d = mt.with_returns(plain_equity(spark, sf), CK)
        return d.select(*CK, "ts", (F.col("i") - sg.START + 1).alias("i"), (F.col("n") - sg.START + 1).alias("n"), "r", "v", "close", "sig", "prev_sig")

    return kept(spark, (sf, "plain-returns"), make)


def _uni(seed, i):
    return o.uniform(seed, i)


_RET = o.crossover(PLAIN) + "," + o.LEDGER + """, rr AS MATERIALIZED (SELECT symbol, config_id, CAST(i-252 AS BIGINT) AS k, d, coalesce(v/nullif(lag(v) OVER (PARTITION BY symbol, config_id ORDER BY i), 0)-1, 0) AS r FROM eq)"""


def _draw_sql(lengths, keys, seed, reps=REPS):
    """CTE ``bi``: keys, rep, i, idx, by gathering every row."""
    return f"""bu AS (SELECT {keys}, n, rep, i, i = 0 OR {_uni(f"'restart/{seed}/' || rep", 'i')} < 0.1 AS st, CAST(floor({_uni(f"'place/{seed}/' || rep", 'i')}*n) AS BIGINT) AS pos
    FROM (SELECT *, unnest(range(0, n)) AS i FROM {lengths}, range(1, {reps + 1}) a(rep))),
  bj AS (SELECT *, max(CASE WHEN st THEN i END) OVER w AS i0 FROM bu WINDOW w AS (PARTITION BY {keys}, rep ORDER BY i)),
  bi AS MATERIALIZED (SELECT {keys}, rep, i, (first_value(pos) OVER (PARTITION BY {keys}, rep, i0 ORDER BY i) + i - i0) % n AS idx FROM bj)"""


_BOOT = _RET + ", ln AS (SELECT symbol, config_id, count(*) AS n FROM rr GROUP BY symbol, config_id), " + _draw_sql("ln", "symbol, config_id", "boot") + f""",
  bs AS (SELECT bi.symbol, bi.config_id, rep, CASE WHEN stddev_pop(r) > 1e-12 THEN (avg(r)-(pow(1.05, 1.0/252)-1))/stddev_pop(r)*sqrt(252) ELSE 0 END AS sharpe
    FROM bi JOIN rr ON rr.symbol = bi.symbol AND rr.config_id = bi.config_id AND rr.k = bi.idx GROUP BY ALL)"""


def bootstrapped(spark, sf):
    return kept(spark, (sf, "bootstrap"), lambda: rs.bootstrap_sharpe(strategy_returns(spark, sf), CK, reps=REPS))


@Q.add("g1_bootstrap_sharpe", o.daily(_BOOT + f" SELECT symbol, config_id, CAST(rep AS INT) AS rep, {o.rnd('sharpe')} AS sharpe FROM bs"))
def bootstrap(spark, sf):
    return bootstrapped(spark, sf).select("symbol", "config_id", "rep", r("sharpe").alias("sharpe"))


@Q.add("c8_gather_by_index", o.daily(_BOOT + f" SELECT bi.symbol, bi.config_id, CAST(rep AS INT) AS rep, count(*) AS rows, {o.rnd('avg(r)', 8)} AS mean FROM bi JOIN rr ON rr.symbol = bi.symbol AND rr.config_id = bi.config_id AND rr.k = bi.idx GROUP BY ALL"))
def gather(spark, sf):
    ret = strategy_returns(spark, sf)
    runs = rs.draws(ret.groupBy(*CK).agg(F.max("n").alias("n")), CK, REPS)
    d = rs.gathered(runs, ret, CK, ["r"])
    return d.groupBy("symbol", "config_id", "rep").agg(F.count("*").alias("rows"), r(F.avg("r"), 8).alias("mean"))


@Q.add("d19_bootstrap_interval", o.daily(_BOOT + f" SELECT symbol, config_id, {o.rnd('avg(sharpe)')} AS mean, {o.rnd('quantile_cont(sharpe, 0.025)')} AS low, {o.rnd('quantile_cont(sharpe, 0.975)')} AS high FROM bs GROUP BY symbol, config_id"))
def boot_interval(spark, sf):
    return rs.interval(bootstrapped(spark, sf), ["symbol", "config_id"], "sharpe").select("symbol", "config_id", r("mean").alias("mean"), r("low").alias("low"), r("high").alias("high"))


@Q.add("d20_empirical_p", o.daily(_BOOT + ", " + o.perf() + " SELECT symbol, config_id, avg(CASE WHEN bs.sharpe >= p.sharpe THEN 1.0 ELSE 0.0 END) AS p_value FROM bs JOIN p USING (symbol, config_id) GROUP BY symbol, config_id"))
def empirical(spark, sf):
    from tidebars.plans.aggregates import plain_metrics

    actual = plain_metrics(spark, sf).select(*CK, F.col("sharpe").alias("actual"))
    return rs.exceedance(bootstrapped(spark, sf), actual, CK, "sharpe", "actual").select("symbol", "config_id", "p_value")


_SEED_FINAL = "100*(max_by(v, i)/100000-1)"


@Q.add("d21_seed_spread", o.portfolios(_seed_sql(0.02) + f", fr AS (SELECT config_id, {_SEED_FINAL} AS x FROM eq GROUP BY config_id) SELECT {o.rnd('avg(x)', 4)} AS mean, {o.rnd('stddev_pop(x)', 4)} AS sd FROM fr"))
def seed_spread(spark, sf):
    fin = _seed_equity(spark, sf, 0.02).groupBy(*PK).agg((100 * (F.max_by("v", "i") / 100_000 - 1)).alias("x"))
    return rs.spread(fin, ["portfolio"], "x").select("portfolio", r("mean", 4).alias("mean"), r("sd", 4).alias("sd"))


# ── superior predictive ability and the paired test ──────────────────────────────────────────────────
def _pair_returns(spark, sf):
    def make():
        d = mt.with_returns(grid_equity(spark, sf), PK)
        return d.select(*PK, (F.col("i") - sg.START + 1).alias("i"), (F.col("n") - sg.START + 1).alias("n"), "r")

    return kept(spark, (sf, "grid-returns"), make)


_BENCH = "sma_15_60"
_SPA = _pair_kalman() + ", " + _j(_GRID, _GRID, "kalman_price", "k") + "," + o.joint(2) + f""",
  rr AS MATERIALIZED (SELECT config_id, CAST(i-252 AS BIGINT) AS k, coalesce(v/nullif(lag(v) OVER (PARTITION BY config_id ORDER BY i), 0)-1, 0) AS r FROM eq),
  df AS MATERIALIZED (SELECT a.config_id, a.k, b1.r-a.r AS x FROM rr a JOIN rr b1 ON b1.k = a.k AND b1.config_id = '{_BENCH}' WHERE a.config_id <> '{_BENCH}')"""


@Q.add("g3_superior_ability", o.portfolios(_SPA + ", ln AS (SELECT 'ar' AS portfolio, count(*) AS n FROM rr WHERE config_id = 'sma_15_60'), " + _draw_sql("ln", "portfolio", "spa", SPA_REPS) + f""",
  bm AS (SELECT config_id, rep, avg(x) AS bm FROM bi JOIN df ON df.k = bi.idx GROUP BY ALL),
  ss AS (SELECT config_id, avg(x) AS dbar, count(*) AS n FROM df GROUP BY config_id), vv AS (SELECT config_id, var_pop(bm) AS var FROM bm GROUP BY config_id),
  st AS (SELECT *, greatest(sqrt(var), 1e-8) AS sigma, CASE WHEN dbar > -sqrt(var/n*2*ln(ln(n))) THEN dbar ELSE 0 END AS shift FROM ss JOIN vv USING (config_id)),
  tt AS (SELECT max(sqrt(n)*dbar/sigma) AS t FROM st), nb AS (SELECT rep, max(sqrt(n)*(bm-shift)/sigma) AS tb FROM bm JOIN st USING (config_id) GROUP BY rep)
  SELECT {o.rnd('max(t)')} AS t_spa, avg(CASE WHEN tb >= t THEN 1.0 ELSE 0.0 END) AS p_value FROM nb, tt"""))
def superior(spark, sf):
    ret = _pair_returns(spark, sf)
    b = ret.where(F.col("config_id") == _BENCH)
    d = rs.spa(b, ret.where(F.col("config_id") != _BENCH), ["portfolio"], "config_id", reps=SPA_REPS)
    return d.select("portfolio", r("t_spa").alias("t_spa"), "p_value")


def _paired(spark, sf):
    ret = _pair_returns(spark, sf)
    b = ret.where(F.col("config_id") == _BENCH).select("portfolio", "i", F.col("r").alias("r_b"))
    return ret.where(F.col("config_id") != _BENCH).join(b, ["portfolio", "i"])


@Q.add("c7_paired_returns", o.portfolios(_SPA + f" SELECT config_id, k AS bar, {o.rnd('x', 8)} AS diff FROM df"))
def paired(spark, sf):
    return _paired(spark, sf).select("portfolio", "config_id", (F.col("i") - 1).cast("bigint").alias("bar"), r(F.col("r_b") - F.col("r"), 8).alias("diff"))


@Q.add("g4_paired_t", o.portfolios(_SPA + f" SELECT config_id, count(*) AS n, {o.rnd('avg(x)/(nullif(stddev_samp(x), 0)/sqrt(count(*)))')} AS t FROM df GROUP BY config_id"))
def t_statistic(spark, sf):
    return paired_t(_paired(spark, sf), PK, "r_b", "r").select("portfolio", "config_id", "n", r("t").alias("t"))


@Q.add("g4_paired_t_p_value")
def t_p(spark, sf):
    return paired_t(_paired(spark, sf), PK, "r_b", "r").select("portfolio", "config_id", "n", r("t").alias("t"), r("p").alias("p"))


def _shuffled(spark, sf, reps=REPS):
    def make():
        ret = strategy_returns(spark, sf)
        trades = rs.durations(ret, CK)
        periods = rs.shuffled_trades(trades, ret.groupBy(*CK).agg(F.max("n").alias("n")), CK, reps)
        return rs.shuffled_returns(periods, ret, CK, reps, leverage=2.0)

    return kept(spark, (sf, "shuffled", reps), make)


@Q.add("g2_trade_shuffle")
def shuffle(spark, sf):
    return _shuffled(spark, sf).select("symbol", "config_id", "rep", r("ret").alias("ret"))


@Q.add("g5_study")
def study(spark, sf):
    """One long report: test, series, statistic, value."""
    boot = rs.interval(bootstrapped(spark, sf), CK, "sharpe")
    shuf = rs.spread(_shuffled(spark, sf), CK, "ret")
    actual = strategy_returns(spark, sf).groupBy(*CK).agg((F.max_by("v", "i") / 100_000 - 1).alias("actual"))
    p = rs.exceedance(_shuffled(spark, sf), actual, CK, "ret", "actual")
    ret = _pair_returns(spark, sf)
    spa = rs.spa(ret.where(F.col("config_id") == _BENCH), ret.where(F.col("config_id") != _BENCH), ["portfolio"], "config_id", reps=SPA_REPS)
    tt = paired_t(_paired(spark, sf), PK, "r_b", "r")

    def tall(df, test, series, names):
        cells = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in names])
        return df.select(F.lit(test).alias("test"), series.alias("series"), F.explode(cells).alias("c")).select("test", "series", "c.*")

    sc = F.concat_ws("/", "symbol", "config_id")
    parts = [
        tall(boot, "bootstrap", sc, ["mean", "low", "high"]), tall(shuf, "shuffle", sc, ["mean", "sd"]), tall(p, "shuffle", sc, ["p_value"]),
        tall(spa, "spa", F.col("portfolio"), ["t_spa", "p_value"]), tall(tt, "paired_t", F.concat_ws("/", "portfolio", "config_id"), ["t", "p"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("value", r("value"))


@Q.add("scalar_uniform", "SELECT o_orderkey, " + o.rnd(o.uniform("'seed'", "o_orderkey"), 9) + " AS u FROM orders")
def uniforms(spark, sf):
    from tidebars.sources.ticks import table

    return table(spark, sf, "orders").select("o_orderkey", r(uniform("seed", F.col("o_orderkey")), 9).alias("u"))
