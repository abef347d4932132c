import datetime as dt
import tempfile

import numpy as np
import pandas as pd
import pytest
from market_helpers import walk
from pyspark.sql import functions as F

from tidebars.functions import scalars as sc
from tidebars.functions.hashing import normal, uniform
from tidebars.operators import alignment as al
from tidebars.operators import features as ft
from tidebars.operators import folds as fo
from tidebars.operators import orders as od
from tidebars.operators import regime as rg
from tidebars.operators.blocks import halo, owned
from tidebars.sources import bars as br
from tidebars.sources import configs as cf


def test_bars_round_trip_with_pruning(spark, walks):
    path = tempfile.mkdtemp(prefix="run-") + "/bars"
    br.write_bars(walks, path)
    assert br.read_bars(spark, path).count() == 1031
    d = br.read_bars(spark, path, ["Y", "nowhere"], "1d", "2015-02-01", "2015-03-01")
    assert d.count() == 28
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_first_chunk_wins(spark):
    a = spark.createDataFrame([("X", 1, 10.0), ("X", 2, 20.0)], "symbol string, ts int, close double")
    b = spark.createDataFrame([("X", 2, 99.0), ("X", 3, 30.0)], "symbol string, ts int, close double")
    got = br.first_of_duplicates([a, b]).orderBy("ts").toPandas()
    assert list(got["close"]) == [10, 20, 30]


def test_vendor_junk_becomes_null(spark):
    d = spark.createDataFrame([("X", "2020-01-01 00:00:00", "1", "2", "oops", "1.5", "7", 3)], "Symbol string, Timestamp string, Open string, High string, Low string, Close string, VOLUME string, Trade_Count int")
    row = br.canonical(d, "1d").first()
    assert row["low"] is None and row["high"] == 2.0 and "trade_count" not in row.asDict()


@pytest.mark.parametrize("days", [0, 1, 365, 366, 367, 900])
def test_request_ranges(spark, days):
    s = dt.date(2020, 1, 1)
    d = spark.createDataFrame([(s, s + dt.timedelta(days=days))], "start date, end date")
    got = [(r["from_date"], r["to_date"]) for r in br.request_ranges(d).orderBy("from_date").collect()]
    want, cur, end = [], s, s + dt.timedelta(days=days)
    while cur < end:
        to = min(cur + dt.timedelta(days=365), end)
        want.append((cur, to))
        cur = to + dt.timedelta(days=1)
    assert got == want


def test_contract_roll(spark):
    days = ["2025-06-24", "2025-06-25", "2025-12-31", "2005-01-01"]
    d = spark.createDataFrame([(x,) for x in days], "d string").select(F.col("d").cast("date").alias("d"))
    got = [r[0] for r in d.orderBy(F.desc("d")).select(sc.contract_key(F.lit("gold"), sc.contract_month(F.col("d")))).collect()]
    assert got == ["MCX_FO|GOLD26JANFUT", "MCX_FO|GOLD25JULFUT", "MCX_FO|GOLD25JUNFUT", "MCX_FO|GOLD5JANFUT"]


def test_nearest_expiry(spark):
    rows = [(1, "a", None, "g"), (2, "b", "junk", "g"), (3, "c", "2026-05-01", "g"), (4, "d", "2026-04-01", "g"), (5, "e", None, "h"), (6, "f", "bad", "h")]
    d = spark.createDataFrame(rows, "instrument_key int, trading_symbol string, expiry string, base string")
    got = {r["base"]: r["instrument_key"] for r in od.nearest_expiry(d, "base").collect()}
    assert got == {"g": 4, "h": 5}


def test_unknown_names_are_refused(spark):
    d = spark.createDataFrame([("1d",), ("2d",)], "tf string")
    assert [r[0] for r in d.select(br.interval_of(F.col("tf"))).collect()] == ["day", None]
    with pytest.raises(Exception, match="unknown timeframe"):
        d.select(br.interval_of(F.col("tf"), strict=True)).collect()
    with pytest.raises(Exception, match="invalid action"):
        spark.range(7).select(od.action_fraction(F.col("id").cast("int"))).collect()
    assert [r[0] for r in spark.range(3, 7).select(od.action_fraction(F.col("id").cast("int"), strict=False)).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_config_documents(spark):
    body = '{"swing": {"A": {"fast_window": 3}, "joint": {"name": "x"}}}'
    got = cf.flatten_configs(spark.createDataFrame([(body,)], "body string")).orderBy("asset").toPandas()
    assert list(got["asset"]) == ["A", "joint"] and list(got["fast_window"]) == [3, 15]


def test_asset_parameters_fall_back(spark, walks):
    rows = [("n", "X", 1, 1e5, 5.0, 15.0, 10.0, 30, 50, 0.06, False, {"1h": (5.0, 4, 5, 0.1, True)})]
    dim = cf.asset_dimension(spark, rows)
    assert cf.with_asset(walks, dim).select("cfg_leverage").distinct().first()[0] == 10.0
    hourly = walks.withColumn("timeframe", F.lit("1h"))
    assert cf.with_asset(hourly, dim).select("cfg_leverage", "cfg_dqn_exit").distinct().first()[:] == (5.0, True)
    assert {r[0] for r in cf.unknown_symbols(walks, dim).collect()} == {"Y", "Z"}


def test_alignment_keeps_common_times_only(spark):
    a, b = walk(50, 1, symbol="A"), walk(50, 2, symbol="B", start="2015-01-11")
    legs = al.portfolios(spark, [("p", 1, "A", 0.5, 0.3, 3.0), ("p", 2, "B", 0.5, 0.8, 8.0)])
    got = al.aligned(spark.createDataFrame(pd.concat([a, b])), legs).toPandas()
    assert len(got) == 80 and set(got["n"]) == {40} and got.groupby("ts")["leg"].nunique().eq(2).all()


@pytest.mark.parametrize("n", [100, 252, 261, 262, 314, 315, 400, 700])
def test_folds(spark, n):
    got = [tuple(r)[2:] for r in fo.splits(spark.createDataFrame(walk(n)).select("symbol", "timeframe", "n")).select("symbol", "fold", "train_start", "train_end", "test_start", "test_end").orderBy("fold").collect()]
    want, s = [], 0
    while True:
        e = s + 252
        if e + 63 > n:
            if n - e >= 10:
                want.append((s, e, e, n))
            break
        want.append((s, e, e, e + 63))
        s += 63
    assert got == want
    bars = fo.with_test_fold(spark.createDataFrame(walk(n))).groupBy("fold").count().count()
    assert bars == len(want)


@pytest.mark.parametrize("n", [1, 2, 29, 30, 31, 59, 60, 251, 252])
def test_short_series(spark, n):
    d = spark.createDataFrame(walk(n))
    f = ft.with_features(d).orderBy("i").toPandas()
    assert len(f) == n and f["rsi_14"].notna().sum() == max(n - 13, 0) and f["bb_width"].notna().sum() == max(n - 19, 0)
    assert f["cci_30"].notna().sum() == max(n - 29, 0) and f["dx_30"].notna().sum() == max(n - 59, 0) and f["macd_signal"].notna().sum() == max(n - 33, 0)
    v = owned(rg.with_volatility(d)).orderBy("i").toPandas()
    assert (v["vol"] > 0).sum() == max(n - 31, 0)
    if n == 252:
        assert v["vol_std"][31] == 0 and v["vol_mean"][31] == v["vol"][31] and v["raw_regime"][31] == rg.LOW


def test_flat_prices(spark):
    pdf = walk(80)
    for c in ("open", "high", "low", "close"):
        pdf[c] = 100.0
    f = ft.with_features(spark.createDataFrame(pdf)).orderBy("i").toPandas()
    assert (f["rsi_14"][13:] == 100).all() and (f["bb_width"][19:] == 0).all() and f["cci_30"].isna().all() and (f["dx_30"][59:] == 0).all()


def test_regime_path(spark):
    """Calm, wild, calm: the regime leaves normal during the wild stretch and comes back."""
    rng = np.random.default_rng(2)
    r = np.r_[rng.normal(0, 0.005, 100), rng.normal(0, 0.08, 50), rng.normal(0, 0.005, 50)]
    pdf = walk(200)
    pdf["close"] = 100 * np.exp(np.cumsum(r))
    got = rg.with_regime(spark.createDataFrame(pdf), 10, 50, 2, start=20).orderBy("i").toPandas().set_index("i")["regime"]
    assert rg.EXTREME in set(got[103:115]) and rg.LOW in set(got[160:200]) and got[21] == rg.NORMAL


def test_ewma_matches_pandas(spark):
    pdf = walk(300, 7)
    got = ft.add_ewma_vol(spark.createDataFrame(pdf)).orderBy("i").toPandas()["vol_ewma"]
    want = np.log(pdf["close"] / pdf["close"].shift()).ewm(span=30, min_periods=1).std()
    np.testing.assert_allclose(got[2:].astype(float), want[2:], rtol=1e-9)


def test_uniforms_are_fixed(spark):
    assert abs(spark.range(1).select(uniform(42, F.lit(7))).first()[0] - 0.328162) < 1e-6
    z = spark.range(4000).select(normal("s", F.col("id")).alias("z")).toPandas()["z"]
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05


def test_fill_and_finite(spark):
    d = spark.createDataFrame(walk(9)).withColumn("close", F.when(F.col("i").isin(3, 4, 9), F.col("close")))
    got = ft.fill_forward(d, ["close"]).orderBy("i").toPandas()["close"]
    assert got[:2].isna().all() and got[2] != got[3] and (got[4:8] == got[3]).all()
    x = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (None,), (2.5,)], "x double")
    assert sorted(r[0] for r in x.select(ft.finite_or_zero(F.col("x"))).collect()) == [0, 0, 0, 0, 2.5]


def test_margin_scaling(spark):
    d = spark.createDataFrame([("A", 1.0, 5.0), ("B", 1.0, 3.0), ("C", 0.0, 3.0)], "symbol string, sig double, leverage double").withColumn("c", F.lit(1))
    got = {r["symbol"]: r["scaled"] for r in od.margin_scaled(d, ["c"], 100_000.0, 200_000.0).collect()}
    assert abs(sum(got.values()) - 190_000) < 1e-6 and got["C"] == 0 and abs(got["A"] / got["B"] - 5 / 3) < 1e-12
    free = {r["symbol"]: r["scaled"] for r in od.margin_scaled(d, ["c"], 100_000.0, 1e9).collect()}
    assert free == {"A": 250_000.0, "B": 150_000.0, "C": 0.0}


def test_inverse_vol_of_two_is_the_pair_formula(spark):
    from tidebars.operators.routing import inverse_vol_weight

    d = spark.createDataFrame([("p", 1, "A", 0.02), ("p", 1, "B", 0.01), ("p", 2, "A", 0.0), ("p", 2, "B", 0.01)], "portfolio string, ts int, symbol string, vol double")
    got = {(r["ts"], r["symbol"]): r["w"] for r in d.withColumn("w", inverse_vol_weight()).collect()}
    assert abs(got[1, "A"] - 0.01 / 0.03) < 1e-12 and abs(got[1, "B"] - 0.02 / 0.03) < 1e-12 and got[2, "A"] == got[2, "B"] == 0.5


def test_kept_copies_follow_their_files(spark, tmp_path):
    from tidebars.sources.ticks import kept

    folder = str(tmp_path / "t")
    read = lambda: kept(spark, (folder, "rows"), lambda: spark.read.parquet(folder)).count()
    spark.range(5).write.parquet(folder)
    assert read() == 5
    spark.range(3).write.mode("append").parquet(folder)
    assert read() == 8


def test_unreadable_files_fail_unless_asked(spark, tmp_path):
    from tidebars.sources import bars as br

    path = str(tmp_path / "bars")
    br.write_bars(spark.createDataFrame(walk(30)), path)
    folder = next((tmp_path / "bars").glob("timeframe=*/symbol=*"))
    (folder / "part-broken.parquet").write_bytes(b"no parquet here")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|read"):
        br.read_bars(spark, path).count()
    assert br.read_bars(spark, path, skip_unreadable=True).count() == 30


def test_queries_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q) and SparkSession.getActiveSession() is None"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
