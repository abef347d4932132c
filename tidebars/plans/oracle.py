"""SQL fragments of the independent check: the same questions asked of the raw tables in plain SQL."""

from __future__ import annotations

import re

DAILY = """
t AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS d, l_quantity AS q, row_number() OVER w AS rn,
  100*exp(sum(CAST(round(l_discount*100) AS BIGINT)-5) OVER (w ROWS UNBOUNDED PRECEDING)/400.0) AS px
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount)),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i, count(*) OVER (PARTITION BY symbol) AS n,
  strftime(d, '%Y-%m-%d') AS ds FROM (
  SELECT symbol, d, round(min_by(px,rn),6) AS open, round(max(px),6) AS high, round(min(px),6) AS low,
    round(max_by(px,rn),6) AS close, sum(q) AS volume FROM t GROUP BY symbol, d))"""

ALIGNED = DAILY.replace("b AS MATERIALIZED", "b0 AS MATERIALIZED") + """,
b AS MATERIALIZED (SELECT * EXCLUDE (i, n), row_number() OVER (PARTITION BY symbol ORDER BY d) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b0
  WHERE symbol IN ('A', 'R') AND d IN (SELECT d FROM b0 WHERE symbol IN ('A', 'R') GROUP BY d HAVING count(DISTINCT symbol) = 2))"""

HOURLY = """
t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, event_id,
  100*exp(sum(CAST(round(value*100) AS BIGINT)-5000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)*0.000002) AS px
  FROM events),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY h) AS i, count(*) OVER (PARTITION BY symbol) AS n,
  strftime(h, '%Y-%m-%d %H:%M:%S') AS ds FROM (
  SELECT symbol, h, round(min_by(px,event_id),6) AS open, round(max(px),6) AS high, round(min(px),6) AS low,
    round(max_by(px,event_id),6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t GROUP BY symbol, h))"""

#: Portfolios of two legs: every pair of adjacent symbols, and the outer ones.
PAIRS = {"ar": ("A", "R"), "an": ("A", "N"), "nr": ("N", "R")}

W = "(PARTITION BY symbol ORDER BY i)"


def rnd(expr: str, k: int = 6) -> str:
    return f"(round({expr}, {k}) + 0.0)"


def daily(body: str) -> str:
    """``body``: further CTEs and the final SELECT over ``b``; starts with SELECT or with ``name AS (``."""
    return f"WITH RECURSIVE {DAILY}{' ' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"


def aligned(body: str) -> str:
    return f"WITH RECURSIVE {ALIGNED}{' ' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"


def aligned_three(body: str) -> str:
    """``aligned`` on the bars that all three symbols have."""
    return aligned(body).replace("symbol IN ('A', 'R')", "symbol IN ('A', 'N', 'R')").replace("HAVING count(DISTINCT symbol) = 2", "HAVING count(DISTINCT symbol) = 3")


def portfolios(body: str) -> str:
    """The query of the pair A, R asked of every pair, with the portfolio's name in front."""
    parts = []
    for name, (one, two) in PAIRS.items():
        to = {"'A'": f"'{one}'", "'R'": f"'{two}'", "'ar'": f"'{name}'"}
        parts.append(f"SELECT '{name}' AS portfolio, * FROM ({re.sub('|'.join(to), lambda m: to[m[0]], aligned(body))})")  # noqa: B023
    return " UNION ALL ".join(parts)


def uniform(seed: str, i: str) -> str:
    return f"(CAST('0x' || substr(md5({seed} || ':' || {i}), 1, 8) AS BIGINT)/4294967296.0)"


def normal(seed: str, i: str) -> str:
    return f"(sqrt(-2*ln(1-{uniform(seed + chr(124)*2 + repr('/a'), i)}))*cos(2*pi()*{uniform(seed + chr(124)*2 + repr('/b'), i)}))"


def hourly(body: str) -> str:
    return f"WITH RECURSIVE {HOURLY}{' ' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"


def over(a: int, b: int = 0) -> str:
    def edge(k):
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    return f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {edge(a)} AND {edge(b)})"


def mean(col: str, width: int, shift: int = 0) -> str:
    return f"CASE WHEN i >= {width + shift} THEN avg({col}) OVER {over(1 - width - shift, -shift)} END"


TRUE_RANGE = f"""tr AS (SELECT *, greatest(high-low, abs(high-lag(close) OVER {W}), abs(low-lag(close) OVER {W})) AS tr FROM b)"""

ATR = TRUE_RANGE + """,
seed AS (SELECT symbol, avg(tr) AS a FROM tr WHERE i <= 14 GROUP BY symbol HAVING count(*) = 14),
atr(symbol, i, atr) AS (SELECT symbol, CAST(14 AS BIGINT), a FROM seed
  UNION ALL SELECT x.symbol, x.i, (r.atr*13 + x.tr)/14 FROM atr r JOIN tr x ON x.symbol = r.symbol AND x.i = r.i + 1)"""


def kalman(q: str, r: str, src: str = "b", scale: str = "1.0") -> str:
    """CTEs ending in ``k`` = src + kalman_price, kalman_velocity; q, r, scale are expressions over src."""
    return f"""kx AS (SELECT *, CAST({q} AS DOUBLE)*({scale}) AS q, CAST({r} AS DOUBLE)*({scale}) AS rr FROM {src}),
kr(symbol, i, m0, m1, p00, p01, p11) AS (SELECT symbol, i, close, CAST(0 AS DOUBLE), CAST(1000 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1000 AS DOUBLE) FROM kx WHERE i = 1
  UNION ALL SELECT symbol, i, a0 + a00/s*y, a1 + a01/s*y, a00/s*rr, rr/s*a01, a11 - a01/s*a01 FROM (
    SELECT x.symbol, x.i, x.rr, r.m0+r.m1 AS a0, r.m1 AS a1, r.p00+2*r.p01+r.p11+0.25*x.q AS a00, r.p01+r.p11+0.5*x.q AS a01,
      r.p11+x.q AS a11, r.p00+2*r.p01+r.p11+0.25*x.q + x.rr AS s, x.close-(r.m0+r.m1) AS y
    FROM kr r JOIN kx x ON x.symbol = r.symbol AND x.i = r.i + 1)),
k AS MATERIALIZED (SELECT kx.*, CASE WHEN kx.i <= 20 THEN kx.close ELSE m0 END AS kalman_price, CASE WHEN kx.i <= 20 THEN 0.0 ELSE m1 END AS kalman_velocity
  FROM kx JOIN kr ON kr.symbol = kx.symbol AND kr.i = kx.i)"""


ADAPTIVE = "CASE WHEN atr > 0 THEN least(10.0, greatest(0.1, atr/greatest({r}, 1e-8))) ELSE 1.0 END"


def adaptive_kalman(q: str = "0.5", r: str = "5.0") -> str:
    return ATR + f", ba AS (SELECT b.*, a.atr FROM b LEFT JOIN atr a USING (symbol, i)), " + kalman(q, r, "ba", ADAPTIVE.format(r=r))


REGIME = f"""rv AS (SELECT *, CASE WHEN i > 30 THEN stddev_samp(lr) OVER {over(-29)} END AS v FROM (SELECT *, ln(close/lag(close) OVER {W}) AS lr FROM b)),
rm AS (SELECT *, avg(v) OVER {over(-251)} AS m, CASE WHEN v IS NOT NULL THEN coalesce(stddev_samp(v) OVER {over(-251)}, 0) END AS s FROM rv),
rg AS (SELECT * EXCLUDE (v, m, s), coalesce(lag(v) OVER {W}, 0) AS vol, coalesce(lag(m) OVER {W}, 0) AS vol_mean, coalesce(lag(s) OVER {W}, 0) AS vol_std FROM rm),
raw AS MATERIALIZED (SELECT *, CASE WHEN vol <= 0 OR vol_mean <= 0 THEN 'NORMAL_VOLATILITY' WHEN vol > vol_mean+vol_std THEN 'EXTREME_VOLATILITY'
  WHEN vol > vol_mean THEN 'HIGH_VOLATILITY' WHEN vol > vol_mean-vol_std THEN 'NORMAL_VOLATILITY' ELSE 'LOW_VOLATILITY' END AS raw_regime FROM rg)"""

HYSTERESIS = REGIME + """,
hy(symbol, i, last, run, regime) AS (
  SELECT symbol, i, raw_regime, 1, CAST('NORMAL_VOLATILITY' AS VARCHAR) FROM raw WHERE i = 253
  UNION ALL SELECT x.symbol, x.i, x.raw_regime, CASE WHEN x.raw_regime = h.last THEN h.run+1 ELSE 1 END,
    CASE WHEN x.raw_regime = h.last AND h.run+1 >= 3 THEN x.raw_regime ELSE h.regime END
  FROM hy h JOIN raw x ON x.symbol = h.symbol AND x.i = h.i + 1),
reg AS MATERIALIZED (SELECT raw.*, hy.regime FROM raw JOIN hy ON hy.symbol = raw.symbol AND hy.i = raw.i)"""


def configs(rows) -> str:
    """A VALUES table of Config objects."""
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    cols = ["config_id", "fast", "slow", "leverage", "stop", "buy_bps", "sell_bps", "weight"]
    vals = ", ".join("(" + ", ".join(lit(getattr(c, k)) for k in cols) + ")" for c in rows)
    return f"cfg({', '.join(cols)}) AS (VALUES {vals})"


def crossover(rows, price: str = "close", src: str = "b", extra: str = "") -> str:
    """CTEs ``cfg`` and ``x``: position wanted per bar from the means of earlier bars."""
    widths = sorted({w for c in rows for w in (c.fast, c.slow)})
    cols = ", ".join(f"CASE WHEN i > {w} THEN avg({price}) OVER {over(-w, -1)} END AS s{w}" for w in widths)
    pick = lambda side: "CASE " + side + " " + " ".join(f"WHEN {w} THEN s{w}" for w in widths) + " END"
    return f"""{configs(rows)}, sm AS (SELECT *, {cols} FROM {src}),
x AS MATERIALIZED (SELECT sm.symbol, cfg.config_id, i, n, d, ds, close{extra}, leverage, stop, buy_bps/10000 AS bb, sell_bps/10000 AS ss, weight,
  CASE WHEN i > 252 AND {pick('fast')} > {pick('slow')} THEN 1.0 ELSE 0.0 END AS sig FROM sm CROSS JOIN cfg)"""


LEDGER = """
led(symbol, config_id, i, cash, sh, prev, peak, v, dead, traded, cost, before) AS (
  SELECT symbol, config_id, i, CAST(100000 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(100000 AS DOUBLE), false, 0, CAST(0 AS DOUBLE), CAST(100000 AS DOUBLE) FROM x WHERE i = 252
  UNION ALL SELECT symbol, config_id, i,
    CASE WHEN gone THEN 0 ELSE cash - (tgt-sh)*px - abs(tgt-sh)*px*fee END, CASE WHEN gone THEN 0 ELSE tgt END, eff,
    CASE WHEN eff <> prev THEN CASE WHEN eff > 0 THEN px END WHEN peak IS NOT NULL THEN pk END,
    CASE WHEN gone THEN 0 ELSE greatest(0, cash + sh*px - abs(tgt-sh)*px*fee) END, gone,
    CASE WHEN eff <> prev AND NOT gone THEN 1 ELSE 0 END, abs(tgt-sh)*px*fee, pv
  FROM (SELECT *, CASE WHEN tgt > sh THEN bb ELSE ss END AS fee FROM (SELECT *, CASE WHEN eff <> prev THEN eff*pv*leverage/px ELSE sh END AS tgt FROM (
    SELECT x.symbol, x.config_id, x.i, x.close AS px, x.bb, x.ss, x.leverage, r.cash, r.sh, r.prev, r.peak, r.cash + r.sh*x.close AS pv, greatest(r.peak, x.close) AS pk,
      (r.dead OR r.cash + r.sh*x.close <= 0) AS gone,
      CASE WHEN r.peak IS NOT NULL AND (greatest(r.peak, x.close) - x.close)/greatest(r.peak, x.close) > x.stop THEN 0.0 ELSE x.sig END AS eff
    FROM led r JOIN x ON x.symbol = r.symbol AND x.config_id = r.config_id AND x.i = r.i + 1)))),
eq AS MATERIALIZED (SELECT led.*, x.d, x.ds, x.close, x.n FROM led JOIN x ON x.symbol = led.symbol AND x.config_id = led.config_id AND x.i = led.i)"""


def perf(src: str = "eq", keys: str = "symbol, config_id", day: str = "d") -> str:
    """CTE ``p``: metrics per key from (keys, i, day, v)."""
    return f"""pr AS (SELECT *, coalesce(v/nullif(lag(v) OVER w, 0)-1, 0) AS r, coalesce(1 - v/nullif(max(v) OVER (w ROWS UNBOUNDED PRECEDING), 0), 0) AS dd
  FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
pg AS (SELECT {keys}, count(*) AS bars, product(1+r)-1 AS cum_return, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS dsd,
  max(dd) AS mdd, greatest(date_diff('day', min({day}), max({day}))/365.25, 1.0/252) AS yrs, pow(1.05, 1.0/252)-1 AS rf FROM pr GROUP BY {keys}),
pa AS (SELECT *, CASE WHEN cum_return <= -1 THEN -1.0 ELSE pow(1+cum_return, 1/yrs)-1 END AS ann_return FROM pg),
p AS (SELECT {keys}, bars, cum_return, ann_return, coalesce(sd*sqrt(252), 0) AS ann_vol, coalesce((m-rf)*sqrt(252)/nullif(sd, 0), 0) AS sharpe,
  coalesce((m-rf)*sqrt(252)/nullif(dsd, 0), 0) AS sortino, -mdd AS max_drawdown, coalesce(ann_return/nullif(mdd, 0), 0) AS calmar FROM pa)"""


def joint(legs: int, moved: str = "(e{k} <> p{k} OR t{k})") -> str:
    """CTE ``eq`` for a shared-cash portfolio from ``j``: config_id, i, d, bb, ss and per leg k: c{k} price, s{k} signal,
    w{k} size (weight x leverage), st{k} stop, t{k} forced trade (boolean)."""
    ks = range(1, legs + 1)
    cols = lambda f: ", ".join(f.format(k=k) for k in ks)
    val = " + ".join(f"r.h{k}*x.c{k}" for k in ks)
    return f"""
led(config_id, i, cash, {cols('h{k}')}, {cols('p{k}')}, {cols('k{k}')}, v, dead, trades) AS (
  SELECT config_id, i, CAST(100000 AS DOUBLE), {cols('CAST(0 AS DOUBLE)')}, {cols('CAST(0 AS DOUBLE)')}, {cols('CAST(NULL AS DOUBLE)')}, CAST(100000 AS DOUBLE), false, CAST(0 AS BIGINT) FROM j WHERE i = 252
  UNION ALL SELECT config_id, i, cash - {' - '.join(f'((g{k}-h{k})*c{k} + fee{k})' for k in ks)}, {cols('g{k}')}, {cols('CASE WHEN m{k} THEN e{k} ELSE p{k} END')},
    {cols('CASE WHEN m{k} THEN CASE WHEN e{k} > 0 THEN c{k} END WHEN k{k} IS NOT NULL THEN greatest(k{k}, c{k}) END')},
    CASE WHEN gone THEN 0 ELSE pv - {' - '.join(f'fee{k}' for k in ks)} END, gone, CASE WHEN gone THEN 0 ELSE {' + '.join(f'm{k}::INT' for k in ks)} END
  FROM (SELECT *, {cols('abs(g{k}-h{k})*c{k}*CASE WHEN g{k} > h{k} THEN bb ELSE ss END AS fee{k}')} FROM (
    SELECT *, {cols('CASE WHEN m{k} THEN e{k}*pv*w{k}/c{k} ELSE h{k} END AS g{k}')} FROM (
    SELECT *, {cols(moved + ' AS m{k}')} FROM (
    SELECT x.*, r.cash, {cols('r.h{k}')}, {cols('r.p{k}')}, {cols('r.k{k}')}, r.cash + {val} AS pv, (r.dead OR r.cash + {val} <= 0) AS gone,
      {cols('CASE WHEN r.k{k} IS NOT NULL AND (greatest(r.k{k}, x.c{k})-x.c{k})/greatest(r.k{k}, x.c{k}) > x.st{k} THEN 0.0 ELSE x.s{k} END AS e{k}')}
    FROM led r JOIN j x ON x.config_id = r.config_id AND x.i = r.i + 1))))),
eq AS MATERIALIZED (SELECT led.config_id, led.i, led.v, led.trades, j.d FROM led JOIN j ON j.config_id = led.config_id AND j.i = led.i)"""
