"""Every block operator must give the same answer however a series is cut."""

import numpy as np
import pandas as pd
import pytest
from market_helpers import walk
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebars.operators import blocks as bl
from tidebars.operators import denoise as dn
from tidebars.operators import features as ft
from tidebars.operators import ledger as lg
from tidebars.operators import metrics as mt
from tidebars.operators import regime as rg
from tidebars.operators import signals as sg
from tidebars.session import KEYS

CK = [*KEYS, "config_id"]


def frame(df, *order):
    return df.orderBy(*order).toPandas()


def same(a, b, cols, rtol=1e-9, atol=1e-9):
    assert len(a) == len(b) > 0
    for c in cols:
        if a[c].dtype == object:
            assert list(a[c]) == list(b[c]), c
        else:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=rtol, atol=atol, err_msg=c)


def test_index_numbers_each_series(spark, walks):
    got = frame(bl.index_series(walks.drop("i", "n"), chunk="month"), "symbol", "i")
    want = frame(walks, "symbol", "i")
    same(got, want, ["i", "n", "close"])


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_halo_gives_every_frame_its_rows(walks, block):
    d = bl.owned(bl.halo(walks, 40, block).withColumn("m", F.avg("close").over(bl.rows(-40))))
    plain = Window.partitionBy("symbol").orderBy("i").rowsBetween(-40, 0)
    want = walks.withColumn("m", F.avg("close").over(plain))
    same(frame(d, "symbol", "i"), frame(want, "symbol", "i"), ["m"])


@pytest.mark.parametrize("block", [5, 50, 10_000])
def test_block_scan_equals_plain_windows(walks, block):
    x = F.when(F.col("i") % 9 == 0, F.col("close"))
    specs = {"s": ("sum", F.col("close")), "p": ("product", F.col("close") / 100), "hi": ("max", F.col("close")), "lo": ("min", F.col("close")), "last": ("last", x)}
    got = frame(bl.block_scan(walks, specs, block=block), "symbol", "i")
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = walks.withColumns({
        "s": F.sum("close").over(w), "p": F.product(F.col("close") / 100).over(w), "hi": F.max("close").over(w), "lo": F.min("close").over(w),
        "last": F.last(x, ignorenulls=True).over(w),
    })
    same(got, frame(want, "symbol", "i"), list(specs))


def test_decayed_sums_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(bl, "SUB", 16)
    pdf = walk(400, 5)
    for block in (64, 50, 4096):
        check(frame(bl.decayed_sums(spark.createDataFrame(pdf), {"y": (F.col("close"), 0.9)}, block=block), "i"), pdf)


def check(got, pdf):
    y, want = 0.0, []
    for c in pdf["close"]:
        y = 0.9 * y + c
        want.append(y)
    np.testing.assert_allclose(got["y"], want, rtol=1e-12)


def plain_features(pdf):
    """The exponential and Wilder averages as loops over the rows."""
    h, l, c = (pdf[k].to_numpy() for k in ("high", "low", "close"))
    n = len(c)
    out = {k: np.full(n, np.nan) for k in ("rsi_14", "macd", "macd_signal", "dx_30", "atr_14", "vol_ewma")}
    g = ls = sig = atr = ax = s0 = s1 = s2 = ss = 0.0
    f = s = c[0]
    tr = np.r_[h[0] - l[0], np.maximum(h[1:] - l[1:], np.maximum(abs(h[1:] - c[:-1]), abs(l[1:] - c[:-1])))]
    up, dn = np.diff(h), -np.diff(l)
    moves = [np.r_[0.0, np.where((up > dn) & (up > 0), up, 0.0)], np.r_[0.0, np.where((dn > up) & (dn > 0), dn, 0.0)], tr]
    m, dx = [0.0] * 3, np.zeros(n)
    for k in range(n):
        d = c[k] - c[k - 1] if k else 0.0
        g, ls = (g * 13 + max(d, 0)) / 14, (ls * 13 + max(-d, 0)) / 14
        if k >= 13:
            out["rsi_14"][k] = 100 - 100 / (1 + g / ls) if ls else 100.0
            atr = tr[:14].mean() if k == 13 else (atr * 13 + tr[k]) / 14
            out["atr_14"][k] = atr
        if k:
            f, s = f * 11 / 13 + c[k] * 2 / 13, s * 25 / 27 + c[k] * 2 / 27
            x, a = np.log(c[k] / c[k - 1]), 29 / 31
            s0, s1, s2, ss = s0 * a + 1, s1 * a + x, s2 * a + x * x, ss * a * a + 1
            if k > 1:
                out["vol_ewma"][k] = np.sqrt(max(s2 / s0 - (s1 / s0) ** 2, 0) * s0 * s0 / (s0 * s0 - ss))
        if k >= 25:
            out["macd"][k] = f - s
            sig = f - s if k == 25 else sig * 0.8 + (f - s) * 0.2
            if k >= 33:
                out["macd_signal"][k] = sig
        if k >= 30:
            m = [v[1:31].mean() if k == 30 else (y * 29 + v[k]) / 30 for y, v in zip(m, moves)]
            p, q = (m[0] / m[2], m[1] / m[2]) if m[2] else (0.0, 0.0)
            dx[k] = 100 * abs(p - q) / (p + q) if p + q else 0.0
            if k >= 59:
                ax = dx[30:60].mean() if k == 59 else (ax * 29 + dx[k]) / 30
                out["dx_30"][k] = ax
    return pd.DataFrame(out)


def test_long_series_with_a_flat_stretch(spark):
    """50,000 bars, 5,000 of them without a move, at the default block and at others, against a loop over the rows."""
    pdf = walk(50_000, 11, vol=0.002)
    for c in ("open", "high", "low", "close"):
        pdf.loc[14_000:18_999, c] = pdf.loc[13_999, "close"]
    pdf["ts"] = pd.date_range("2020-01-01", periods=len(pdf), freq="min")
    series, want = spark.createDataFrame(pdf).repartition(8), plain_features(pdf)
    for block in (None, 4096, 3000):
        got = frame(ft.with_features(series, block=block), "i")
        assert len(got) == len(pdf)
        for c in want:
            np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-6, atol=1e-9, err_msg=f"{c} {block}")


def test_features_do_not_depend_on_blocks(walks):
    a = frame(ft.with_features(walks), "symbol", "i")
    for block in (128, 33):
        b = frame(ft.with_features(walks, block=block), "symbol", "i")
        same(a, b, ft.FEATURES, rtol=1e-8, atol=1e-8)


def test_zscores_and_tensor_do_not_depend_on_blocks(walks):
    d = bl.owned(bl.halo(walks, 1).withColumn("return_simple", ft.simple_return()))
    a, b = (frame(ft.with_zscores(d, ["return_simple"], block=k), "symbol", "i") for k in (10_000, 37))
    same(a, b, ["return_simple_z"])
    a, b = (frame(ft.state_tensor(d, ["return_simple", "close"], block=k), "symbol", "i") for k in (10_000, 37))
    assert [len(t) for t in a["tensor"]] == [60] * len(a) and list(a["tensor"]) == list(b["tensor"])
    assert set(a["symbol"]) == {"X", "Y"}  # 31 bars fill no window


@pytest.mark.parametrize("preset", list(dn.PRESETS))
def test_filter_blocks_are_chained_exactly(walks, preset):
    a, b = (frame(dn.denoise(walks, preset, block=k), "symbol", "i") for k in (10_000, 50))
    same(a, b, ["kalman_price", "kalman_velocity", "kalman_residual"], rtol=1e-9, atol=1e-8)


def test_filter_equals_the_matrix_form(spark):
    pdf = walk(200, 8)
    got = frame(dn.denoise(spark.createDataFrame(pdf), "price"), "i")
    q, r = 0.3, 3.0
    f, h, eye = np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]]), np.eye(2)
    qm = q * np.array([[0.25, 0.5], [0.5, 1]])
    x, p, out = np.array([pdf.close[0], 0.0]), 1000 * eye, []
    for k, z in enumerate(pdf["close"]):
        if k:
            x, p = f @ x, f @ p @ f.T + qm
            s = (h @ p @ h.T)[0, 0] + r
            g = (p @ h.T / s)[:, 0]
            x = x + g * (z - x[0])
            j = eye - np.outer(g, h)
            p = j @ p @ j.T + r * np.outer(g, g)
        out.append(z if k < 20 else x[0])
    np.testing.assert_allclose(got["kalman_price"], out, rtol=1e-10)


def test_regimes_do_not_depend_on_blocks(walks):
    a, b = (frame(rg.with_regime(walks, start=100, block=k), "symbol", "i") for k in (10_000, 45))
    same(a, b, ["vol", "vol_mean", "vol_std", "raw_regime", "regime"])


@pytest.mark.parametrize("block", [33, 10_000])
def test_ledger_does_not_depend_on_blocks(walks, block):
    cfg = [sg.Config("a", 5, 20, 2.0, 0.04), sg.Config("b", 3, 30, 1.0)]
    run = lambda k: lg.single(lg.with_stops(sg.crossover(walks, cfg, start=60, block=k), CK, k), start=60, block=k)
    a, b = frame(run(None), "symbol", "config_id", "i"), frame(run(block), "symbol", "config_id", "i")
    same(a, b, ["sig", "v"])
    m = lambda k: frame(mt.performance(run(k), CK, block=k), "symbol", "config_id")
    same(m(None), m(block), mt.METRICS)


def test_order_of_input_rows_does_not_matter(walks):
    cfg = [sg.Config("a", 5, 20, 2.0)]
    m = lambda d: frame(mt.performance(lg.single(sg.crossover(d, cfg, start=60), start=60), CK), "symbol")
    same(m(walks.repartition(1)), m(walks.repartition(7, "close")), mt.METRICS)


def test_plans_do_not_depend_on_length_or_multiply(walks):
    """Filter, crossover, ledger and metrics: as many exchanges and scans for one block as for many, and no more for a longer chain."""
    def size(df):
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Scan ExistingRDD"), plan.count("Exchange")

    cfg = [sg.Config("a", 5, 20, 2.0)]
    single = lambda k: lg.single(sg.crossover(dn.denoise(walks, block=k), cfg, "kalman_price", start=60, block=k), start=60, block=k)
    assert size(single(None)) == size(single(40))
    one, two = size(mt.with_drawdown(single(40), CK, block=40)), size(mt.with_drawdown(mt.with_drawdown(single(40), CK, block=40).drop("peak", "dd"), CK, block=40))
    assert one == two


def test_a_position_that_never_closes(spark):
    """One holding period of 100,000 bars with stops, in batches of 1,000 rows."""
    pdf = walk(100_000, 8, vol=0.004, freq="min")
    d = spark.createDataFrame(pdf).withColumns({"config_id": F.lit("c"), "sig": F.lit(1.0), "prev_sig": F.when(F.col("i") == 1, 0.0).otherwise(1.0), "stop": F.lit(0.02)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = sorted(r.i for r in lg.stop_exits(d, CK).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    peak, want = None, []
    for i, p in zip(pdf["i"], pdf["close"]):
        if peak is None:
            peak = p
            continue
        peak = max(peak, p)
        if (peak - p) / peak > 0.02:
            want.append(i)
            peak = None
    assert got == want and len(want) > 50


def test_hysteresis_is_the_state_machine(spark):
    rng = np.random.default_rng(4)
    names = list(rg.ORDINALS)
    rows = []
    for s in range(40):
        raw = [names[k] for k in np.repeat(rng.integers(0, 4, 60), rng.integers(1, 5, 60))[:80]]
        rows += [(f"s{s}", "1d", i + 1, len(raw), x) for i, x in enumerate(raw)]
    d = spark.createDataFrame(rows, "symbol string, timeframe string, i int, n int, raw_regime string")
    for h in (1, 2, 3, 4):
        need = max(h, 2)
        x = bl.halo(d, need, 16)
        ok = F.col("i") >= need
        for k in range(1, need):
            ok = ok & (F.col("raw_regime") == F.lag("raw_regime", k).over(bl.in_block()))
        x = bl.owned(x.withColumn("sure", F.when(ok, F.col("raw_regime"))))
        got = bl.block_scan(x, {"r": ("last", F.col("sure"))}, block=16).orderBy("symbol", "i").toPandas()
        for _, g in got.groupby("symbol"):
            cur, last, run, want = rg.NORMAL, None, 0, []
            for raw in g["raw_regime"]:
                run = run + 1 if raw == last else 1
                last = raw
                if run >= need:
                    cur = raw
                want.append(cur)
            assert list(g["r"].fillna(rg.NORMAL)) == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": ["a"] * 501 + ["b"] * 2 + ["c"] * 40, "x": np.r_[rng.normal(size=501), [1.0, 4.0], np.repeat(7.0, 40)]})
    got = ft.quantiles(spark.createDataFrame(pdf), ["k"], "x", [0.0, 0.25, 0.5, 0.975, 1.0]).toPandas()
    for _, row in got.iterrows():
        np.testing.assert_allclose(row["value"], np.quantile(pdf.x[pdf.k == row["k"]], row["prob"]), rtol=1e-12)


def test_a_hot_series_is_split(spark):
    """One symbol holds most rows; no window partition is larger than a block with its halo."""
    pdf = pd.concat([walk(5000, 1, symbol="hot"), *[walk(40, k, symbol=f"s{k}") for k in range(2, 20)]])
    d = bl.halo(spark.createDataFrame(pdf), 60, 256)
    sizes = d.groupBy("symbol", "blk").count().toPandas()
    assert sizes["count"].max() <= 256 + 60 and (sizes["symbol"] == "hot").sum() == 20
    assert bl.owned(d).count() == len(pdf)


def test_ticks_of_a_hot_day_are_split(spark):
    """Many ticks of one symbol on one day: parts are numbered separately and the bar is the same."""
    from tidebars.sources import ticks as tk

    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "symbol": np.where(rng.uniform(size=n) < 0.8, "hot", "cold"), "timeframe": "1d", "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 2, n), "D"),
        "k": np.arange(n), "inc": rng.integers(-5, 6, n), "qty": 1.0,
    })
    d = spark.createDataFrame(pdf).repartition(6)
    bars = {}
    for size in (50, 10**6):
        t = d.withColumn("part", F.expr(f"k div {size}"))
        bars[size] = tk.to_bars(tk.priced(t, 1 / 400, ["k"])).orderBy("symbol", "ts").toPandas()
        most = t.groupBy("symbol", "ts", "part").count().agg(F.max("count")).first()[0]
        assert size > 50 or most <= 50
    same(bars[50], bars[10**6], ["open", "high", "low", "close", "volume"], rtol=0, atol=0)
    for sym, g in pdf.sort_values(["ts", "k"]).groupby("symbol"):
        px = 100 * np.exp(g["inc"].cumsum() / 400)
        want = px.groupby(g["ts"]).agg(["first", "max", "min", "last"]).round(6)
        got = bars[50][bars[50].symbol == sym][["open", "high", "low", "close"]].to_numpy()
        np.testing.assert_allclose(got, want.to_numpy(), atol=2e-6)
