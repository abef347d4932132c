"""Ledgers against plain loops written for these tests."""

import numpy as np
import pandas as pd
import pytest
from market_helpers import walk
from pyspark.sql import functions as F

from tidebars.operators import ledger as lg
from tidebars.operators import metrics as mt
from tidebars.operators import reports as rp
from tidebars.operators import resample as rs
from tidebars.session import KEYS

CK = [*KEYS, "config_id"]


def sig_frame(prices, sig, lev=1.0, stop=None, b=5.0, s=15.0, symbol="X"):
    n = len(prices)
    return pd.DataFrame({
        "symbol": symbol, "timeframe": "1d", "config_id": "c", "ts": pd.date_range("2020-01-01", periods=n), "i": np.arange(1, n + 1), "n": n,
        "close": np.asarray(prices, float), "prev_close": np.r_[np.nan, prices[:-1]], "sig": np.asarray(sig, float), "prev_sig": np.r_[0.0, sig[:-1]],
        "leverage": lev, "stop": np.nan if stop is None else stop, "buy_bps": b, "sell_bps": s, "weight": 1.0,
    })


def loop(prices, sig, lev, stop, b, s):
    cash, sh, prev, peak, out, trades = 1e5, 0.0, 0.0, None, [], 0
    for p, want in zip(prices, sig):
        v = cash + sh * p
        if v <= 0:
            out += [0.0] * (len(prices) - len(out))
            break
        if peak is not None:
            peak = max(peak, p)
            if stop is not None and (peak - p) / peak > stop:
                want = 0.0
        if want != prev:
            d = want * v * lev / p - sh
            cash -= d * p + abs(d) * p * (b if d > 0 else s) / 1e4
            sh, prev, trades = sh + d, want, trades + 1
            peak = p if want > 0 else None
        out.append(max(cash + sh * p, 0.0))
    return out, trades


def spark_frame(spark, pdf):
    d = spark.createDataFrame(pdf)
    return d.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in ("stop", "prev_close")})


@pytest.mark.parametrize("lev,stop", [(1.0, None), (2.0, 0.03), (3.0, 0.01), (12.0, None)])
def test_single_equals_the_loop(spark, lev, stop):
    rng = np.random.default_rng(int(lev * 10))
    p = walk(400, 3, 0.02)["close"].to_numpy()
    sig = np.r_[0.0, np.repeat(rng.integers(0, 2, 400), rng.integers(1, 14, 400))[:399]].astype(float)
    want, trades = loop(p, sig, lev, stop, 5, 15)
    d = lg.with_stops(spark_frame(spark, sig_frame(p, sig, lev, stop)), CK, 64)
    got = lg.single(d, start=1, block=64).orderBy("i").toPandas()
    np.testing.assert_allclose(got["v"], want, rtol=1e-9, atol=1e-6)
    if min(want) > 0:
        log = lg.trade_log(lg.single(d, start=1, block=64), block=64)
        assert log.count() == trades
        open_pnl = log.groupBy().agg(F.sum("realized_net_pnl")).first()[0]
        assert open_pnl is not None


def test_stop_exits_and_next_bar_entries(spark):
    p = [100, 100, 110, 98, 99, 100, 80, 81, 82, 82]
    sig = [0, 1, 1, 1, 1, 1, 1, 1, 1, 0]
    d = lg.with_stops(spark_frame(spark, sig_frame(p, sig, 1.0, 0.10)), CK).orderBy("i").toPandas()
    assert list(d["sig"]) == [0, 1, 1, 0, 1, 1, 0, 1, 1, 0]
    assert list(d["prev_sig"]) == [0, 0, 1, 1, 0, 1, 1, 0, 1, 1]


def test_ruin_is_final(spark):
    p, sig = [100, 100, 40, 200, 300, 300], [0, 1, 1, 1, 0, 1]
    got = lg.single(spark_frame(spark, sig_frame(p, sig, 2.0)), start=1).orderBy("i").toPandas()
    assert list(got["v"][2:]) == [0, 0, 0, 0] and got["v"][1] > 0
    m = mt.performance(lg.single(spark_frame(spark, sig_frame(p, sig, 2.0)), start=1), CK).first()
    assert m["cum_return"] == -1 and m["ann_return"] == -1 and m["max_drawdown"] == -1


def test_labels_after_ruin(spark):
    eq = lg.single(spark_frame(spark, sig_frame([100, 100, 40, 200], [0, 1, 1, 1], 2.0)), start=1)
    d = lg.liquidation_labels(eq.withColumns({"active_agent": F.lit("PPO"), "regime": F.lit("LOW_VOLATILITY")})).orderBy("i").toPandas()
    assert list(d["active_agent"]) == ["PPO", "PPO", "LIQUIDATED", "LIQUIDATED"] and d["regime"][3] == "EXTREME_VOLATILITY"


def joint_loop(prices, sigs, sizes, b, s, lot=0):
    cash, sh, prev, out = 1e5, [0.0] * len(prices), [0.0] * len(prices), []
    for t in range(len(prices[0])):
        v = cash + sum(h * p[t] for h, p in zip(sh, prices))
        if v <= 0:
            return out + [0.0] * (len(prices[0]) - t)
        for k, p in enumerate(prices):
            if sigs[k][t] != prev[k]:
                tgt = sigs[k][t] * v * sizes[k] / p[t]
                tgt = float(int(tgt / lot)) * lot if lot else tgt
                d = tgt - sh[k]
                cash -= d * p[t] + abs(d) * p[t] * (b if d > 0 else s) / 1e4
                sh[k], prev[k] = tgt, sigs[k][t]
        out.append(cash + sum(h * p[t] for h, p in zip(sh, prices)))
    return out


@pytest.mark.parametrize("lot", [0, 7])
def test_three_leg_portfolio(spark, lot):
    rng = np.random.default_rng(11)
    n, legs = 150, []
    prices = [walk(n, 20 + k)["close"].to_numpy() for k in range(3)]
    sigs = [np.r_[0.0, np.repeat(rng.integers(0, 2, 40), 5)[: n - 1]] for _ in range(3)]
    for k in range(3):
        f = sig_frame(prices[k], sigs[k], 2.0)
        f["portfolio"], f["leg"], f["weight"] = "p", k + 1, [0.5, 0.3, 0.2][k]
        legs.append(f)
    d = spark_frame(spark, pd.concat(legs))
    keys = ["portfolio", "config_id"]
    got = lg.joint(lg.wide(d, keys), keys, start=1, lot=lot, block=32).orderBy("i").toPandas()
    np.testing.assert_allclose(got["v"], joint_loop(prices, sigs, [1.0, 0.6, 0.4], 5, 15, lot), rtol=1e-10)


def test_month_gap_and_year_start(spark):
    ts = list(pd.date_range("2020-01-30", periods=4)) + list(pd.date_range("2020-04-01", periods=2)) + list(pd.date_range("2022-01-01", periods=2))
    v = [100, 110, 120, 121, 130, 143, 150, 165.0]
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": ts, "i": range(1, 9), "n": 8, "v": v}))
    m = rp.monthly_returns(d, ["k"]).orderBy("month").toPandas()
    np.testing.assert_allclose(m["ret"], [0.10, 0.10, 143 / 121 - 1, 165 / 143 - 1])
    y = rp.annual_returns(d, ["k"]).orderBy("year").toPandas()
    np.testing.assert_allclose(y["annual"], [0.43, 0.10])  # after a gap year the year's own first value counts
    wide = rp.month_matrix(d, ["k"]).orderBy("year").toPandas()
    assert wide["m3"].isna().all() and abs(wide["m4"][0] - (143 / 121 - 1)) < 1e-12


def test_metrics_by_hand(spark):
    v = np.array([100, 101, 99, 102, 104.0])
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.date_range("2020-01-01", periods=5), "i": range(1, 6), "n": 5, "v": v}))
    m = mt.performance(d, ["k"]).first()
    r = np.r_[0, v[1:] / v[:-1] - 1]
    rf = 1.05 ** (1 / 252) - 1
    years = 4 / 365.25
    assert abs(m["cum_return"] - 0.04) < 1e-12
    assert abs(m["ann_return"] - (1.04 ** (1 / years) - 1)) < 1e-6
    assert abs(m["sharpe"] - (r.mean() - rf) / r.std(ddof=1) * 252**0.5) < 1e-9
    assert abs(m["max_drawdown"] + (1 - 99 / 101)) < 1e-12
    assert m["sortino"] == 0  # a single negative return has no deviation


def test_flat_series_has_zero_ratios(spark):
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.date_range("2020-01-01", periods=5), "i": range(1, 6), "n": 5, "v": 100.0}))
    m = mt.performance(d, ["k"]).first()
    assert (m["sharpe"], m["sortino"], m["calmar"], m["max_drawdown"]) == (0, 0, 0, 0)


# ── resampling ───────────────────────────────────────────────────────────────────────────────────────


def test_runs_cover_every_replicate(spark):
    lengths = spark.createDataFrame([("a", 57), ("b", 1)], "k string, n int")
    runs = rs.draws(lengths, ["k"], 25)
    per = runs.groupBy("k", "rep").agg(F.sum("len").alias("s"), F.max("n").alias("n")).toPandas()
    assert len(per) == 50 and (per["s"] == per["n"]).all()
    idx = rs.indices(runs, ["k"]).toPandas()
    assert ((idx["idx"] >= 0) & (idx["idx"] < 57)).all() and len(idx) == 25 * 58


def test_run_sums_equal_gathering(spark):
    pdf = walk(83, 6).assign(k="a", r=lambda d: d["close"].pct_change().fillna(0))
    d = spark.createDataFrame(pdf[["k", "i", "n", "r"]])
    runs = rs.draws(d.groupBy("k").agg(F.max("n").alias("n")), ["k"], 30, 6.0)
    got = rs.run_sums(runs, rs.prefix_sums(d, ["k"], {"x": F.col("r")}, 16), ["k"], ["k"], ["x"]).orderBy("rep").toPandas()
    idx = rs.indices(runs, ["k"]).toPandas()
    want = idx.assign(r=pdf["r"].to_numpy()[idx["idx"]]).groupby("rep")["r"].sum()
    np.testing.assert_allclose(got["sum_x"], want, rtol=1e-9, atol=1e-12)


def test_first_fit_against_a_whole_shuffled_list(spark):
    """Lists of all slots in order of first appearance, and a mask of all bars; crowded and full series included."""
    from tidebars.functions.hashing import uniform, uniform_of

    rng = np.random.default_rng(6)
    left_out = 0
    for case in range(120):
        n, head, tail = int(rng.integers(1, 120)), int(rng.integers(0, 15)), int(rng.integers(0, 30))
        lengths = [int(x) for x in rng.integers(1, 25, rng.integers(0, 12))]
        draw = lambda k: uniform_of(f"t{case}", k)  # noqa: B023, E731
        width, order, k = max(n - tail - head, 0), [], 0
        while len(order) < width:
            slot = head + int(draw(k) * width)
            order += [slot] * (slot not in order)
            k += 1
        used, want = np.zeros(n + 1, bool), []
        for m in lengths:
            free = [x for x in order if x + m < n and not used[x : x + m].any()]
            left_out += not free
            if free:
                used[free[0] : free[0] + m] = True
                want.append((free[0], free[0] + m))
        assert rs.first_fit(lengths, n, head, tail, draw) == sorted(want)
    assert left_out > 20
    same = spark.range(50).select("id", uniform("s", F.col("id")).alias("u")).collect()
    assert all(r.u == uniform_of("s", r.id) for r in same)


def test_shuffled_returns_equal_the_loop(spark):
    p = walk(260, 13)["close"].to_numpy()
    rng = np.random.default_rng(5)
    sig = np.repeat(rng.integers(0, 2, 60), 5)[:260].astype(float)
    d = spark_frame(spark, sig_frame(p, sig))
    trades = rs.durations(d, CK)
    lengths = d.groupBy(*CK).agg(F.max("n").alias("n"))
    periods = rs.shuffled_trades(trades, lengths, CK, 12).cache()
    got = rs.shuffled_returns(periods, d, CK, 12, leverage=3.0).orderBy("rep").toPandas()
    per = periods.toPandas()
    total = int(trades.groupBy().agg(F.sum("bars")).first()[0])
    for rep, ret in zip(got["rep"], got["ret"]):
        s = np.zeros(260)
        for a, z in per.loc[per["rep"] == rep, ["a", "z"]].to_numpy():
            assert s[a:z].sum() == 0 and a >= 20
            s[a:z] = 1
        assert s.sum() <= total
        want, _ = loop(p, np.r_[0.0, s[:-1]], 3.0, None, 5, 15)
        np.testing.assert_allclose(ret, want[-1] / 1e5 - 1, rtol=1e-9, atol=1e-9)


def test_spa_prefers_a_better_benchmark(spark):
    rng = np.random.default_rng(0)
    n = 300
    base = rng.normal(0, 0.01, n)
    rows = [("g", "alt%d" % k, i + 1, n, float(x)) for k in range(4) for i, x in enumerate(rng.normal(-0.002, 0.01, n))]
    alts = spark.createDataFrame(rows, "g string, config_id string, i int, n int, r double")
    good = spark.createDataFrame([("g", i + 1, float(x + 0.004)) for i, x in enumerate(base)], "g string, i int, r double")
    bad = spark.createDataFrame([("g", i + 1, float(x - 0.004)) for i, x in enumerate(base)], "g string, i int, r double")
    assert rs.spa(good, alts, ["g"], "config_id", reps=60).first()["p_value"] < 0.05
    assert rs.spa(bad, alts, ["g"], "config_id", reps=60).first()["p_value"] > 0.05


def test_t_distribution():
    from tidebars.functions.stats import t_two_sided

    # table values of the t distribution
    for t, df, p in [(12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (1.959963985, 10**8, 0.05), (0.0, 5, 1.0), (4.032142984, 5, 0.01)]:
        assert abs(t_two_sided(t, df) - p) < 1e-8
        assert abs(t_two_sided(-t, df) - p) < 1e-8


def test_threshold_path(spark):
    p = np.full(8, 100.0)
    sig = [0.0, 0.02, 0.06, 0.08, 0.99, 1.0, 0.01, 0.0]
    d = lg.with_threshold(spark_frame(spark, sig_frame(p, sig)), CK).orderBy("i").toPandas()
    assert list(d["moved"]) == [False, False, True, False, True, False, True, False]


def test_action_ledger_limits(spark):
    n = 6
    pdf = pd.DataFrame({
        "symbol": "X", "timeframe": "1d", "ts": pd.date_range("2020-01-01", periods=n), "i": range(1, n + 1), "n": n, "close": [100.0, 100, 50, 50, 50, 50],
        "action": [1.0, 1.0, 0.0, -0.5, -1.0, 0.001],
    })
    d = lg.from_actions(spark.createDataFrame(pdf)).orderBy("i").toPandas()
    assert abs(d["shares"][0] - 950) < 1e-9 and abs(d["cash"][0] - (1e5 - 95000 * 1.0005)) < 1e-6
    assert d["shares"][1] == d["shares"][0]  # a change below the minimum is held
    assert abs(d["shares"][3] - 475) < 1e-9 and d["shares"][4] == 0
    assert d["shares"][5] == 0
