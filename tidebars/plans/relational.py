"""Registered queries: joins, projections, predicates, set operations, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidebars.functions import scalars as sc
from tidebars.operators import alignment as al
from tidebars.operators import features as ft
from tidebars.operators import ledger as lg
from tidebars.operators import orders as od
from tidebars.operators import regime as rg
from tidebars.operators import signals as sg
from tidebars.operators.blocks import halo, owned
from tidebars.plans import oracle as o
from tidebars.plans.common import Registry, day, r
from tidebars.plans.ledgers import _LOG_SQL, stopped_log
from tidebars.plans.windows import _FEAT, ALL_FEATURES, _simple_features, rounded_features
from tidebars.sources.ticks import daily, table

Q = Registry()

# ── joins ────────────────────────────────────────────────────────────────────────────────────────────


@Q.add("c1_common_dates", o.daily("SELECT symbol, ds AS d, close FROM b WHERE d IN (SELECT d FROM b GROUP BY d HAVING count(DISTINCT symbol) = 3)"))
def common(spark, sf):
    return al.common_times(daily(spark, sf), ["A", "N", "R"]).select("symbol", day().alias("d"), "close")


@Q.add("c1_pairwise", o.daily("SELECT x.symbol || y.symbol AS pair, x.ds AS d, x.close AS close_a, y.close AS close_b FROM b x JOIN b y ON x.d = y.d AND x.symbol < y.symbol"))
def pairwise(spark, sf):
    pairs = [al.pairwise(daily(spark, sf), a, b).select(F.lit(a + b).alias("pair"), day().alias("d"), "close_a", "close_b") for a, b in o.PAIRS.values()]
    return reduce(lambda x, y: x.unionByName(y), pairs)


@Q.add("c2_common_dates_of_features", o.daily(_FEAT + f", g AS (SELECT * FROM f WHERE bb_width IS NOT NULL) SELECT symbol, ds AS d, {o.rnd('bb_width', 8)} AS bb_width FROM g WHERE d IN (SELECT d FROM g GROUP BY d HAVING count(DISTINCT symbol) = 3)"))
def common_features(spark, sf):
    f = _simple_features(spark, sf).where("bb_width is not null")
    return al.common_times(f, ["A", "N", "R"]).select("symbol", day().alias("d"), r("bb_width", 8).alias("bb_width"))


@Q.add("c4_agent_lookup", o.daily(o.HYSTERESIS + """ SELECT symbol, CASE regime WHEN 'LOW_VOLATILITY' THEN 'DDPG' WHEN 'NORMAL_VOLATILITY' THEN 'PPO' WHEN 'HIGH_VOLATILITY' THEN 'A2C' ELSE 'DQN' END AS by_code,
  CASE regime WHEN 'LOW_VOLATILITY' THEN 'DQN' WHEN 'NORMAL_VOLATILITY' THEN 'PPO' WHEN 'HIGH_VOLATILITY' THEN 'DDPG' ELSE 'A2C' END AS proposed, count(*) AS bars FROM reg GROUP BY ALL"""))
def agents(spark, sf):
    d = rg.with_regime(daily(spark, sf))
    a, b = rg.agent_of(F.col("regime"), rg.ROUTES_BY_CODE), rg.agent_of(F.col("regime"), rg.ROUTES_PROPOSED)
    return d.groupBy("symbol", a.alias("by_code"), b.alias("proposed")).agg(F.count("*").alias("bars"))


_GRID = sg.sma_grid()


@Q.add("c5_series_by_configs", o.daily(o.crossover(_GRID) + f" SELECT symbol, config_id, count(*) AS bars, CAST(sum(sig) AS BIGINT) AS bars_in, {o.rnd('avg(CASE WHEN sig > 0 THEN close END)')} AS mean_held FROM x GROUP BY symbol, config_id"))
def by_configs(spark, sf):
    d = sg.crossover(daily(spark, sf), _GRID)
    return d.groupBy("symbol", "config_id").agg(F.count("*").alias("bars"), F.sum("sig").cast("bigint").alias("bars_in"), r(F.avg(F.when(F.col("sig") > 0, F.col("close")))).alias("mean_held"))


# ── projections and predicates ───────────────────────────────────────────────────────────────────────


@Q.add("b1_registry_subset", ALL_FEATURES + f" SELECT symbol, d, {', '.join(ft.TECHNICAL)}, {', '.join(ft.RETURNS[:3])} FROM f")
def subset(spark, sf):
    d = rounded_features(spark, sf).drop("vol_ewma")
    return d.select("symbol", day().alias("d"), *ft.existing(d, ft.FEATURES))


@Q.add("b2_fill_forward", o.daily(f"SELECT symbol, ds AS d, filled AS close FROM (SELECT *, last_value(CASE WHEN volume >= 150 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS filled FROM b) WHERE filled IS NOT NULL"))
def fill(spark, sf):
    d = daily(spark, sf).withColumn("close", F.when(F.col("volume") >= 150, F.col("close")))
    return ft.fill_forward(d, ["close"]).select("symbol", day().alias("d"), "close").na.drop()


@Q.add("b3_finite_or_zero", o.daily("SELECT symbol, ds AS d, CASE WHEN volume < 150 OR volume > 500 OR close < 60 THEN 0.0 ELSE close END AS x FROM b"))
def finite(spark, sf):
    x = F.when(F.col("volume") < 150, float("nan")).when(F.col("volume") > 500, float("inf")).when(F.col("close") < 60, F.lit(None)).otherwise(F.col("close"))
    return daily(spark, sf).select("symbol", day().alias("d"), ft.finite_or_zero(x).alias("x"))


@Q.add("b4_out_of_sample", o.daily("SELECT symbol, ds AS d, close FROM b WHERE i > 252"))
def out_of_sample(spark, sf):
    return daily(spark, sf).where(f"i > {sg.START}").select("symbol", day().alias("d"), "close")


@Q.add("b6_clip", "SELECT s_suppkey, greatest(-1.0, least(1.0, s_acctbal/5000)) AS clipped FROM supplier")
def clip(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", od.clip(F.col("s_acctbal") / 5000, -1.0, 1.0).alias("clipped"))


@Q.add("b7_minimum_trade", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_quantity-25)*l_tax*1000 < 100 THEN 0.0 ELSE l_quantity-25 END AS qty FROM lineitem")
def minimum(spark, sf):
    q = F.col("l_quantity") - 25
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", od.min_trade(q, F.col("l_tax") * 1000).alias("qty"))


@Q.add("b8_long_only", o.daily(f"SELECT symbol, ds AS d, CASE WHEN i > 30 AND avg(close) OVER {o.over(-9)} > avg(close) OVER {o.over(-29)} THEN 0.95 ELSE 0.0 END AS sig FROM b"))
def long_only(spark, sf):
    d = halo(daily(spark, sf), 30)
    pol = F.when(F.col("i") > 30, 0.95 * sg.trend_policy()).otherwise(0.0)
    return owned(d.withColumn("s", pol)).select("symbol", day().alias("d"), F.greatest("s", F.lit(0.0)).alias("sig"))


@Q.add("b9_trade_search", f"SELECT symbol, config_id, d, action FROM ({_LOG_SQL}) WHERE action = 'SELL' AND contains(upper(concat_ws(' ', symbol, config_id, d, action)), 'TIGHT 1999')")
def search(spark, sf):
    d = stopped_log(spark, sf).select("symbol", "config_id", day().alias("d"), "action")
    return search_trades(d, "tight 1999", "SELL").select("symbol", "config_id", "d", "action")


def search_trades(log, text="", action="ALL", agent="ALL"):
    """Case-insensitive text over all columns and exact filters; 'ALL' switches a filter off."""
    hay = F.upper(F.concat_ws(" ", *[F.col(c).cast("string") for c in log.columns]))
    cond = hay.contains(text.upper())
    if action != "ALL":
        cond = cond & (F.col("action") == action)
    if agent != "ALL":
        cond = cond & (F.col("active_agent") == agent)
    return log.where(cond)


@Q.add("b10_regime_ordinal", o.daily(o.HYSTERESIS + " SELECT symbol, ds AS d, CASE regime WHEN 'LOW_VOLATILITY' THEN 1 WHEN 'HIGH_VOLATILITY' THEN 3 WHEN 'EXTREME_VOLATILITY' THEN 4 ELSE 2 END AS level FROM reg"))
def ordinal(spark, sf):
    return rg.with_regime(daily(spark, sf)).select("symbol", day().alias("d"), rg.ordinal_of(F.col("regime")).alias("level"))


@Q.add("b12_policy_weight", o.daily(o.HYSTERESIS + f""", tp AS (SELECT symbol, i, CASE WHEN avg(close) OVER {o.over(-9)} > avg(close) OVER {o.over(-29)} THEN 1 ELSE -1 END AS trend FROM b)
  SELECT reg.symbol, ds AS d, trend*CASE regime WHEN 'EXTREME_VOLATILITY' THEN 0.5 WHEN 'NORMAL_VOLATILITY' THEN 0.95 WHEN 'LOW_VOLATILITY' THEN 0.75 ELSE 0.8 END AS weight FROM reg JOIN tp ON tp.symbol = reg.symbol AND tp.i = reg.i"""))
def policy(spark, sf):
    d = owned(halo(daily(spark, sf), 30).withColumn("trend", sg.trend_policy()))
    d = rg.with_regime(d)
    size = rg.lookup(rg.agent_of(F.col("regime"), rg.ROUTES_BY_CODE), sg.AGENT_SIZE, 0.8)
    return d.select("symbol", day().alias("d"), (F.col("trend") * size).alias("weight"))


# ── set operations ───────────────────────────────────────────────────────────────────────────────────
def _dates(spark, sf, symbol):
    return daily(spark, sf).where(F.col("symbol") == symbol).select(day().alias("d"))


Q.add("set_union", o.daily("SELECT ds AS d FROM b WHERE symbol = 'A' UNION ALL SELECT ds FROM b WHERE symbol = 'N'"))(lambda s, f: _dates(s, f, "A").unionByName(_dates(s, f, "N")))
Q.add("set_intersect", o.daily("SELECT ds AS d FROM b WHERE symbol = 'A' INTERSECT SELECT ds FROM b WHERE symbol = 'N'"))(lambda s, f: _dates(s, f, "A").intersect(_dates(s, f, "N")))


@Q.add("set_missing_columns", "SELECT 'vwap' AS column_name, count(*) AS bars FROM (SELECT DISTINCT l_returnflag, CAST(l_shipdate AS DATE) FROM lineitem)")
def missing(spark, sf):
    """Required columns that a bar table lacks, by schema, next to its row count."""
    d = daily(spark, sf)
    lack = sorted({"open", "close", "vwap"} - set(d.columns))
    return d.groupBy().agg(F.count("*").alias("bars")).select(F.explode(F.array(*[F.lit(c) for c in lack])).alias("column_name"), "bars")


# ── scalar functions ─────────────────────────────────────────────────────────────────────────────────


@Q.add("scalar_math", "SELECT o_orderkey, " + ", ".join([
    f"{o.rnd('ln(o_totalprice)', 8)} AS log_price", f"{o.rnd('sqrt(o_totalprice)', 8)} AS root", f"{o.rnd('exp(-o_totalprice/100000)', 8)} AS decay",
    f"{o.rnd('pow(o_totalprice, 0.25)', 8)} AS fourth", f"{o.rnd('ln(ln(o_totalprice+3))', 8)} AS loglog", "CAST((o_custkey+7) % 13 AS BIGINT) AS wrapped", f"{o.rnd('o_totalprice*15/10000', 6)} AS fee",
    "CAST(trunc(-o_totalprice/7) AS BIGINT) AS truncated"]) + " FROM orders")
def math(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", r(F.log(p), 8).alias("log_price"), r(F.sqrt(p), 8).alias("root"), r(F.exp(-p / 100000), 8).alias("decay"), r(F.pow(p, F.lit(0.25)), 8).alias("fourth"),
        r(F.log(F.log(p + 3)), 8).alias("loglog"), F.pmod(F.col("o_custkey") + 7, F.lit(13)).alias("wrapped"), r(sc.fee(p, 15.0), 6).alias("fee"), sc.truncated(-p / 7).alias("truncated"),
    )


@Q.add("scalar_text", """SELECT c_custkey, upper(c_name) AS up, regexp_replace(c_name || '|' || c_mktsegment, '[^A-Za-z0-9_]', '_', 'g') AS safe, substr(md5(c_name), 1, 12) AS tag,
  replace(replace(c_name || '|x', '#', '%23'), '|', '%7C') AS quoted, contains(c_mktsegment, 'BUILD') AS is_building, substr(c_name, 1, 8) AS head FROM customer""")
def text(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", F.upper(n).alias("up"), sc.safe_name(F.concat(n, F.lit("|"), "c_mktsegment")).alias("safe"), sc.short_hash(n).alias("tag"),
        F.url_encode(F.concat(n, F.lit("|x"))).alias("quoted"), F.col("c_mktsegment").contains("BUILD").alias("is_building"), F.substring(n, 1, 8).alias("head"),
    )


@Q.add("scalar_contract_roll", """SELECT o_orderkey, 'MCX_FO|' || 'GOLD' || CAST(year(m) % 100 AS VARCHAR) || upper(strftime(m, '%b')) || 'FUT' AS contract, strftime(CAST(o_orderdate AS DATE) + 365, '%Y-%m-%d') AS plus_year
  FROM (SELECT *, CASE WHEN day(o_orderdate) >= 25 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH ELSE date_trunc('month', o_orderdate) END AS m FROM orders)""")
def roll(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", sc.contract_key(F.lit("gold"), sc.contract_month(d)).alias("contract"), F.date_add(d, 365).cast("string").alias("plus_year"))


@Q.add("scalar_json_map", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(coalesce(json_extract(props, '$.none'), '-1') AS BIGINT) AS missing FROM events")
def json_map(spark, sf):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select("event_id", F.element_at(m, "k").alias("k"), F.coalesce(F.element_at(m, "none"), F.lit(-1)).cast("bigint").alias("missing"))


@Q.add("scalar_array", o.daily(f"""l AS (SELECT symbol, year(d) AS year, list(close ORDER BY i) AS xs FROM b GROUP BY ALL)
  SELECT symbol, year, {o.rnd('list_avg(xs[1:5])')} AS first_mean, xs[3] AS third, CAST(len(list_concat(xs, [1.0, 2.0])) AS BIGINT) AS longer FROM l"""))
def arrays(spark, sf):
    g = daily(spark, sf).groupBy("symbol", F.year("ts").alias("year")).agg(F.array_sort(F.collect_list(F.struct("i", "close"))).alias("s"))
    xs = F.col("s.close")
    head = F.slice(xs, 1, 5)
    return g.select("symbol", "year", r(F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)).alias("first_mean"), F.get(xs, F.lit(2)).alias("third"), F.size(F.concat(xs, F.array(F.lit(1.0), F.lit(2.0)))).cast("bigint").alias("longer"))


@Q.add("scalar_random_normal", f"SELECT o_orderkey, {o.rnd(o.normal(repr('seed'), 'o_orderkey'), 7)} AS z FROM orders")
def normals(spark, sf):
    from tidebars.functions.hashing import normal

    return table(spark, sf, "orders").select("o_orderkey", r(normal("seed", F.col("o_orderkey")), 7).alias("z"))


@Q.add("scalar_lots", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice/(l_quantity*5)) AS BIGINT)*5 AS units FROM lineitem")
def lot_units(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lg.lots(F.col("l_extendedprice"), F.col("l_quantity"), 5).alias("units"))
