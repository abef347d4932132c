"""Drawn rows are joined where they are, not sent to every task."""

import numpy as np
from market_helpers import walk
from pyspark.sql import functions as F

from tidebars.operators import resample as rs


def test_written_out_draws_are_not_broadcast(spark):
    n, reps = 300, 40
    d = spark.createDataFrame(walk(n, 2).assign(r=np.random.default_rng(2).normal(0, 0.01, n)))
    runs = rs.draws(d.groupBy("symbol").agg(F.max("n").alias("n")), ["symbol"], reps)
    got = rs.gathered(runs, d, ["symbol"], ["r"])
    rows = got.toPandas()
    want = rs.indices(runs, ["symbol"]).toPandas().merge(d.select((F.col("i") - 1).alias("idx"), "r").toPandas(), on="idx")
    key = ["rep", "i"]
    assert len(rows) == n * reps and rows.sort_values(key)[[*key, "idx", "r"]].to_numpy().tolist() == want.sort_values(key)[[*key, "idx", "r"]].to_numpy().tolist()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_runs_and_held_bars_are_not_broadcast(spark):
    """Runs and held bars are many more than the rows they come from; neither they nor the work on them are gathered in one place."""
    n, reps, keys = 300, 40, ["symbol", "config_id"]
    d = spark.createDataFrame(walk(n, 2).assign(config_id="c", x=np.random.default_rng(3).normal(0, 0.01, n)))
    lengths = d.groupBy(*keys).agg(F.max("n").alias("n"))
    runs = rs.draws(lengths, keys, reps)
    assert runs.select(F.spark_partition_id()).distinct().count() > 1
    prefix = spark.createDataFrame(rs.prefix_sums(d, keys, {"x": F.col("x")}).toPandas())
    sums = rs.run_sums(runs, prefix, keys, keys, ["x"])
    assert len(sums.toPandas()) == reps
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    trades = spark.createDataFrame([(d.first()["symbol"], "c", 9 * k, 4 + k) for k in range(8)], "symbol string, config_id string, start long, bars long")
    periods = rs.shuffled_trades(trades, lengths, keys, reps)
    assert periods.select(F.spark_partition_id()).distinct().count() > 1
    returns = rs.shuffled_returns(periods, d, keys, reps)
    assert len(returns.toPandas()) == reps
    plan = returns._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and [x for x in plan.split("\n") if "SortMergeJoin" in x and "at#" in x] and not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and " at#" in x]
