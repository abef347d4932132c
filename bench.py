"""Headline timings as one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidebars.operators import denoise as dn  # noqa: E402
from tidebars.operators import features as ft  # noqa: E402
from tidebars.operators import ledger as lg  # noqa: E402
from tidebars.operators import metrics as mt  # noqa: E402
from tidebars.operators import regime as rg  # noqa: E402
from tidebars.operators import resample as rs  # noqa: E402
from tidebars.operators import signals as sg  # noqa: E402
from tidebars.plans import ledgers, resampling, streams  # noqa: E402
from tidebars.session import KEYS, cut, local_session  # noqa: E402
from tidebars.sources.bars import gbm_bars  # noqa: E402
from tidebars.sources.ticks import daily, lineitem_bars  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
CK = [*KEYS, "config_id"]
GRID = [sg.Config(f"g{f}_{s}", f, s, 1.5) for f in (5, 8, 10, 15) for s in (20, 30, 40, 50, 60, 80)]


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}

    def run(name, fn):
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)

    def grid():
        return sg.crossover(daily(spark, SF, "l_suppkey"), GRID, start=60)

    # all daily bars of one symbol per supplier: 1,000 series at sf0.1
    run("bars_build", lambda: noop(lineitem_bars(spark, SF, "l_suppkey")))
    run("bars_index_and_store", lambda: daily(spark, SF, "l_suppkey"))
    series = daily(spark, SF, "l_suppkey")
    run("features_12", lambda: noop(ft.with_features(series)))
    run("zscores", lambda: noop(ft.with_zscores(series, ["close", "volume"])))
    run("kalman_filter", lambda: noop(dn.denoise(series, "adaptive")))
    run("regimes", lambda: noop(rg.with_regime(series)))
    run("grid_ledger_24", lambda: noop(mt.performance(lg.single(grid(), start=60), CK)))
    run("grid_ledger_24_stops", lambda: noop(lg.single(lg.with_stops(grid().withColumn("stop", ft.F.lit(0.05)), CK), start=60)))
    # five series of 100,000 bars each: several blocks
    long = cut(gbm_bars(spark.createDataFrame([(f"long{k}",) for k in range(5)], "symbol string"), 100_000))
    run("features_12_long", lambda: noop(ft.with_features(long)))
    run("kalman_filter_long", lambda: noop(dn.denoise(long, "adaptive")))
    run("ledger_metrics_long", lambda: noop(mt.performance(lg.single(sg.crossover(long, GRID[:2], start=60), start=60), CK)))
    # the joint study of the three-symbol daily bars
    run("flagship", lambda: noop(mt.performance(ledgers.plain_equity(spark, SF), CK)))
    run("fee_sweep", lambda: noop(ledgers.fee_equity(spark, SF)))
    run("routing_24", lambda: noop(ledgers.routing_equity(spark, SF)))
    run("bootstrap_1000", lambda: noop(rs.bootstrap_sharpe(resampling.strategy_returns(spark, SF), CK, reps=1000)))
    run("stream_bars_drain", lambda: noop(streams.bars(spark, SF)))
    run("stream_signals_drain", lambda: noop(streams.signals(spark, SF)))
    print(json.dumps({"metric": "total headline time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
