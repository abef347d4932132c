"""Series whose prices fall below the sixth digit, so that bars close at 0, and rise again: every ledger against its SQL, whose divisions by 0 give
infinities and NaN."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from check_oracle import compare
from market_helpers import walk
from pyspark.sql import functions as F

from tidebars.operators import ledger as lg
from tidebars.operators import resample as rs
from tidebars.operators.stops import Block
from tidebars.plans.catalog import catalog
from tidebars.sources.ticks import daily

DAYS, TICKS = 420, 40
PLAIN = """d1_cumulative_return d2_annualised_return d2_annualised_by_bars d3_annualised_volatility d4_sharpe d5_sortino d6_max_drawdown d7_calmar
  d8_empty_is_zero d12_month_end d13_monthly_return d14_annual_return d15_month_matrix d16_versus_benchmark e26_equity_returns a12_json_report""".split()


def lineitem(seed):
    """Three symbols: falls to 0 and comes back slowly; is at 0 in its last third but for single days, which makes it bought at 0; never near 0."""
    rng, out, day = np.random.default_rng(seed), [], np.arange(DAYS)
    paths = {"A": -12 * (1 - np.cos(day / 9)), "N": np.where(day < 300, 0.3 * np.sin(day / 13), np.where(day % 17 == 0, 0.1, -24)), "R": 0.4 * np.sin(day / 17)}
    for symbol, path in paths.items():
        goal = np.round(400 * path + rng.normal(0, 20, DAYS)).astype(int)
        step = np.diff(goal, prepend=0)
        for k in range(DAYS):
            inc = np.full(max(TICKS, abs(step[k]) // 5 + 1), step[k] // max(TICKS, abs(step[k]) // 5 + 1))
            inc[: step[k] - inc.sum()] += 1
            out.append(pd.DataFrame({"l_returnflag": symbol, "l_shipdate": pd.Timestamp("1998-01-01") + pd.Timedelta(days=k), "inc": inc}))
    d = pd.concat(out, ignore_index=True)
    assert d["inc"].abs().max() <= 5
    n = np.arange(len(d))
    return d.assign(l_orderkey=n, l_partkey=n, l_suppkey=n, l_linenumber=1, l_extendedprice=1.0, l_quantity=1.0, l_discount=(d["inc"] + 5) / 100).drop(columns="inc")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("zero-prices")
    lineitem(5).to_parquet(path / "lineitem.parquet", coerce_timestamps="us")
    return str(path)


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return con


def same(spark, con, folder, name):
    ok, note, _, _ = compare(spark, con, name, *catalog()[name], folder)
    assert ok, note


def test_bars_close_at_zero_and_come_back(spark, folder):
    d = daily(spark, folder).where("i > 252").groupBy("symbol").agg(F.min("close").alias("lo"), F.max_by("close", "i").alias("last")).toPandas().set_index("symbol")
    assert d["lo"].to_dict()["A"] == d["lo"].to_dict()["N"] == 0 < d["lo"].to_dict()["R"]


@pytest.mark.parametrize("name", ["f1_equity", *PLAIN])
def test_plain_ledger(spark, con, folder, name):
    same(spark, con, folder, name)


def test_some_equity_is_not_a_number(spark, folder):
    v = catalog()["f1_equity"][0](spark, folder).toPandas().sort_values("d").groupby(["symbol", "config_id"])["v"].apply(lambda x: x.iloc[-1])
    assert v["N"].isna().all() and (v["R"] > 0).all()


def test_ruin(spark, con, folder):
    """Values go to 1e17 here, of which two engines do not share the last digit."""
    fn, sql = catalog()["f16_ruin"]
    got, want = (d.sort_values(["symbol", "config_id"], ignore_index=True).drop(columns="best") for d in (fn(spark, folder).toPandas(), con.sql(sql).df()))
    assert got.astype(object).where(got.notna(), None).values.tolist() == want[got.columns].astype(object).where(want.notna(), None).values.tolist()
    got, want = (d.sort_values(["symbol", "config_id"])["best"].astype(float).to_numpy() for d in (fn(spark, folder).toPandas(), con.sql(sql).df()))
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("name", ["f2_stopped_equity", "f17_trade_log", "b9_trade_search", "d11_trade_totals"])
def test_stops_and_trade_log(spark, con, folder, name):
    same(spark, con, folder, name)


@pytest.mark.parametrize("name", ["d19_bootstrap_interval", "d20_empirical_p"])
def test_bootstrap(spark, con, folder, name):
    same(spark, con, folder, name)


def test_seeds(spark, con, folder):
    same(spark, con, folder, "d21_seed_spread")


def test_lots_at_zero_are_null(spark, folder):
    got = catalog()["f15_lot_rounding"][0](spark, folder).toPandas()
    at = daily(spark, folder).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("d"), "close").toPandas()
    d = got.merge(at, on=["symbol", "d"])
    some = d["close"] > 0
    assert len(d) == 3 * DAYS and 0 < (~some).sum()
    assert d.loc[~some, ["units", "short_units"]].isna().all().all()
    assert (d.loc[some, "units"] == np.trunc(100_000 / (d.loc[some, "close"] * 10)) * 10).all()
    assert (d.loc[some, "short_units"] == np.trunc(-50_000 / (d.loc[some, "close"] * 25)) * 25).all()


def test_ruin_before_a_purchase_at_zero_stays_ruin(spark):
    """Ruined in one holding period, a later purchase at 0 changes nothing; bought at 0 first, a later fall changes nothing."""
    n = 12
    sig = [0, 1, 1, 1, 0, 0, 1, 1, 0, 1, 1, 0]
    close = {"ruin first": [9, 9, 1, 9, 9, 0, 0, 1, 2, 3, 1, 1], "nothing first": [9, 0, 1, 9, 9, 9, 9, 1, 2, 3, 1, 1]}
    rows = [("s", "1d", c, i + 1, n, float(x[i]), float(x[i - 1]) if i else None, float(sig[i]), float(sig[i - 1]) if i else 0.0, 2.0, 5.0, 15.0) for c, x in close.items() for i in range(n)]
    d = spark.createDataFrame(rows, "symbol string, timeframe string, config_id string, i long, n long, close double, prev_close double, sig double, prev_sig double, leverage double, buy_bps double, sell_bps double")
    for block in (None, 4):
        got = lg.single(d, start=1, block=block).toPandas().sort_values("i").groupby("config_id")["v"].apply(list)
        assert got["ruin first"][0] == 100_000 and got["ruin first"][1] > 0 and got["ruin first"][2:] == [0.0] * 10
        assert got["nothing first"][0] == 100_000 and np.isnan(got["nothing first"][1:]).all()


def test_replicates_without_nan_keep_their_numbers(spark):
    """A NaN return is in the replicates that draw it and in no other."""
    n, reps = 60, 80
    r = np.random.default_rng(1).normal(0, 0.01, n)
    r[[7, 31]] = np.nan
    d = spark.createDataFrame([("s", i + 1, n, float(x)) for i, x in enumerate(r)], "symbol string, i long, n long, r double")
    runs = rs.draws(d.groupBy("symbol").agg(F.max("n").alias("n")), ["symbol"], reps, block=16)
    drawn = rs.indices(runs, ["symbol"]).toPandas().groupby("rep")["idx"].apply(lambda x: r[x.to_numpy()])
    got = rs.bootstrap_sharpe(d, ["symbol"], reps=reps, block=16).toPandas().set_index("rep")["sharpe"]
    want = drawn.apply(lambda x: (x.mean() - (1.05 ** (1 / 252) - 1)) / x.std() * np.sqrt(252))
    assert 0 < want.isna().sum() < reps
    np.testing.assert_allclose(got.sort_index(), want.sort_index(), rtol=1e-9)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_stop_at_a_peak_of_zero(spark, block):
    """Stops at closes of 0 against a plain loop, over blocks."""
    n, rng = 200, np.random.default_rng(4)
    d = walk(n, 4, vol=0.2).assign(config_id="c", stop=0.1)
    d["close"] = np.where(rng.random(n) < 0.3, 0.0, d["close"])
    d["sig"] = np.repeat(rng.integers(0, 2, n // 5), 5).astype(float)
    d["prev_sig"] = d["sig"].shift(fill_value=0.0)
    want, peak = [], None
    for i, p, s in zip(d["i"], d["close"], d["sig"]):
        if not s:
            peak = None
            continue
        if peak is None:
            peak = p
            continue
        peak = max(peak, p)
        if peak == 0 or (peak - p) / peak > 0.1:
            want.append(i)
            peak = None
    from tidebars.operators.stops import stop_exits

    got = stop_exits(spark.createDataFrame(d), ["symbol", "timeframe", "config_id"], block)
    assert sorted(x["i"] for x in got.collect()) == want and len(want) > 20
    assert Block(np.zeros(2), np.full(2, 0.1), np.array([True, False])).exits(float("nan")).tolist() == [1]


def test_shuffled_trades_bought_at_zero(spark):
    """Bought at 0 makes a replicate NaN, a ruin before it keeps it at -1, and the rest is as it was; against the loop over the bars."""
    n, keys = 160, ["symbol", "config_id"]
    p = walk(n, 8, vol=0.12)["close"].to_numpy()
    p[60:64] = p[100:103] = 0.0
    prices = spark.createDataFrame([("s", "c", i + 1, n, float(x)) for i, x in enumerate(p)], "symbol string, config_id string, i long, n long, close double")
    trades = spark.createDataFrame([("s", "c", 5 * k, 6 + k) for k in range(5)], "symbol string, config_id string, start long, bars long")
    periods = rs.shuffled_trades(trades, prices.groupBy(*keys).agg(F.max("n").alias("n")), keys, 150, tail=20).cache()
    got = rs.shuffled_returns(periods, prices, keys, 150, leverage=2.0).toPandas().set_index("rep")["ret"].sort_index()
    want = {}
    for rep, g in periods.toPandas().groupby("rep"):
        sig = np.zeros(n)
        for a, z in zip(g["a"], g["z"]):
            sig[a:z] = 1
        cash, shares, before, value = 1e5, 0.0, 0.0, 1e5
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(1, n):
                value = np.float64(cash + shares * p[k])
                if value <= 0:
                    value = 0.0
                    break
                if sig[k - 1] != before:
                    target = sig[k - 1] * value * 2 / p[k]
                    cash -= (target - shares) * p[k] + abs(target - shares) * p[k] * (0.0005 if target > shares else 0.0015)
                    shares, before = target, sig[k - 1]
                value = cash + shares * p[k]
        want[rep] = max(value, 0.0) / 1e5 - 1 if value == value else value
    want = pd.Series(want).sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
    assert want.isna().sum() > 10 and (want == -1).sum() > 10 and (want > -1).sum() > 10


def test_shuffled_queries_at_zero(spark, folder):
    d = catalog()["g2_trade_shuffle"][0](spark, folder).toPandas()
    assert len(d) == 6000 and d.loc[d["symbol"] == "R", "ret"].notna().all() and d.loc[d["symbol"] == "N", "ret"].isna().any()
    study = catalog()["g5_study"][0](spark, folder).toPandas()
    mean = study[(study["test"] == "shuffle") & (study["statistic"] == "mean")].set_index("series")["value"]
    assert len(mean) == 6 and set(study["test"]) == {"bootstrap", "shuffle", "spa", "paired_t"}
    want = d.groupby(["symbol", "config_id"])["ret"].apply(lambda x: x.mean(skipna=False))
    np.testing.assert_allclose(mean.sort_index(), want.sort_index(), atol=1e-5)
