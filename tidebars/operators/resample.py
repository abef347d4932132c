"""Stationary bootstrap, superior-predictive-ability test and trade shuffling.

A bootstrap replicate of a series is a chain of circular runs of rows. Work is dealt by (series, replicate, block of rows): a block draws the uniforms
of its own rows, keeps those that start a run (one in ``block_length``), and looks a little past its end for the next start, which is a function of
the row's number and needs no other task. A run enters every sum as a difference of two prefix sums, so a replicate of N rows costs about
N/block_length joined rows, and no task holds more than a block of it.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.hashing import below, uniform, uniform_of
from tidebars.operators.blocks import BLOCK, block_scan
from tidebars.operators.features import ratio
from tidebars.operators.ledger import holding_start


def _tasks(df: DataFrame) -> int:
    """A number that Spark keeps: a few small rows that grow to many in the same stage would otherwise be gathered in one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def draws(lengths: DataFrame, keys, reps: int, block_length: float = 10.0, seed: str = "boot", block: int | None = None) -> DataFrame:
    """Runs of each replicate: (keys, rep, n, i0, len, pos), positions 0-based; run lengths add up to n.

    Row i starts a run with probability ``1/block_length`` (row 0 always) at a uniform position. The last run of a block ends at the first start past
    the block, which may lie in any later one.
    """
    keys, b = list(keys), block or BLOCK
    n, end = F.col("n"), F.col("_end")
    s = F.concat(F.lit(seed + "/"), F.col("rep").cast("string"))
    starts = lambda i: below(F.concat(F.lit("restart/"), s), i, 1 / block_length)
    d = lengths.select(*keys, n.cast("bigint").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).where("n > 0")
    d = d.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {b}")))).repartition(_tasks(lengths), *keys, "rep", "_blk")
    d = d.withColumn("_end", F.least(n, (F.col("_blk") + 1) * b))

    def found(lo: int, hi: int | None):
        """The first start among the rows ``lo .. hi - 1`` past the block; rows are numbers here, nothing is read."""
        upto = n if hi is None else F.least(n, end + hi)
        return F.when(end + lo < upto, F.get(F.filter(F.sequence(end + lo, upto - 1), starts), F.lit(0)))

    # steps of growing size; a later one is evaluated only where the earlier ones have no start
    steps = [0]
    while steps[-1] < b:
        steps.append(max(int(4 * block_length), 16) if not steps[-1] else steps[-1] * 8)
    d = d.withColumn("_next", F.coalesce(*[found(x, y) for x, y in zip(steps, [*steps[1:], None])], n))
    d = d.withColumn("i0", F.explode(F.sequence(F.col("_blk") * b, end - 1)))
    d = d.where((F.col("i0") == 0) | starts(F.col("i0")))
    d = d.withColumn("pos", F.floor(uniform(F.concat(F.lit("place/"), s), F.col("i0")) * n).cast("bigint"))
    w = Window.partitionBy(*keys, "rep", "_blk").orderBy("i0")
    return d.withColumn("len", F.coalesce(F.lead("i0").over(w), F.col("_next")) - F.col("i0")).drop("_blk", "_end", "_next")


def indices(runs: DataFrame, keys) -> DataFrame:
    """Runs written out: (keys, rep, i, idx)."""
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1))
    d = runs.select(*keys, "rep", "n", "i0", "pos", k.alias("_k"))
    return d.select(*keys, "rep", (F.col("i0") + F.col("_k")).alias("i"), F.pmod(F.col("pos") + F.col("_k"), F.col("n")).alias("idx"))


def gathered(runs: DataFrame, series: DataFrame, keys, cols) -> DataFrame:
    """The rows each replicate draws: (keys, rep, i, idx, cols). ``series`` has 1-based i.

    Runs look small to the planner, which counts bytes before they are written out; the join is told to sort, lest it sends every drawn row to
    every task by way of the driver.
    """
    rows = series.select(*keys, (F.col("i") - 1).cast("bigint").alias("idx"), *cols)
    return indices(runs, keys).join(rows.hint("merge"), [*keys, "idx"])


def prefix_sums(series: DataFrame, keys, cols: dict, block: int | None = None) -> DataFrame:
    """Sums of the first ``at`` values for at = 0..n-1 (exclusive) and the whole (``tot_``), per key. ``series`` has 1-based i, n."""
    keys = list(keys)
    own = series.select(*keys, "i", "n", *[F.coalesce(x, F.lit(0.0)).alias(f"x_{c}") for c, x in cols.items()])
    d = block_scan(own, {f"s_{c}": ("sum", F.col(f"x_{c}")) for c in cols}, keys, block)
    tot = own.groupBy(*keys).agg(*[F.sum(f"x_{c}").alias(f"tot_{c}") for c in cols])
    d = d.join(tot, keys)
    return d.select(*keys, (F.col("i") - 1).cast("bigint").alias("at"), *[(F.col(f"s_{c}") - F.col(f"x_{c}")).alias(f"p_{c}") for c in cols], *[f"tot_{c}" for c in cols])


def run_sums(runs: DataFrame, prefix: DataFrame, run_keys, keys, cols) -> DataFrame:
    """Sum of each column over every replicate: (keys, rep, n, sum_...). Runs wrap around at most once.

    The joins are told to sort, as in ``gathered``: runs are many, and the planner counts the few rows they are drawn from.
    """
    keys, cols = list(keys), list(cols)
    end = F.col("pos") + F.col("len")
    d = runs.withColumn("to", F.when(end >= F.col("n"), end - F.col("n")).otherwise(end)).withColumn("wrap", (end >= F.col("n")).cast("double"))
    a = prefix.select(*keys, F.col("at").alias("pos"), *[F.col(f"p_{c}").alias(f"a_{c}") for c in cols])
    b = prefix.select(*keys, F.col("at").alias("to"), *[F.col(f"p_{c}").alias(f"b_{c}") for c in cols], *[f"tot_{c}" for c in cols])
    d = d.join(a.hint("merge"), [*run_keys, "pos"]).join(b.hint("merge"), list(dict.fromkeys([*keys, "to"])))
    part = {c: F.col(f"b_{c}") - F.col(f"a_{c}") + F.col("wrap") * F.col(f"tot_{c}") for c in cols}
    return d.groupBy(*keys, "rep").agg(F.max("n").alias("n"), *[F.sum(x).alias(f"sum_{c}") for c, x in part.items()])


def bootstrap_sharpe(series: DataFrame, keys, ret: str = "r", reps: int = 1000, block_length: float = 10.0, rf: float = 0.05, year: int = 252, seed: str = "boot", block: int | None = None) -> DataFrame:
    """Annualised Sharpe ratio (population deviation) of every replicate: (keys, rep, sharpe); 0 without variance, NaN for one that holds a NaN.

    NaN returns are counted apart, as a difference of prefix sums would hand them to every later run.
    """
    keys = list(keys)
    lengths = series.groupBy(*keys).agg(F.max("n").alias("n"))
    runs = draws(lengths, keys, reps, block_length, seed, block)
    x = F.nanvl(F.col(ret), F.lit(0.0))
    cols = {"x": x, "xx": x * x, "nan": F.isnan(ret).cast("double")}
    sums = run_sums(runs, prefix_sums(series, keys, cols, block), keys, keys, cols)
    m = F.when(F.col("sum_nan") > 0, float("nan")).otherwise(F.col("sum_x") / F.col("n"))
    sd = F.sqrt(F.greatest(F.col("sum_xx") / F.col("n") - m * m, F.lit(0.0)))
    rf_d = math.pow(1 + rf, 1 / year) - 1
    return sums.select(*keys, "rep", F.when(sd > 1e-12, (m - rf_d) / sd * math.sqrt(year)).otherwise(0.0).alias("sharpe"))


def interval(values: DataFrame, keys, x: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Mean and two exact percentiles over replicates (their number is the caller's ``reps``, not the data's)."""
    return values.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.percentile(x, F.lit(lo)).alias("low"), F.percentile(x, F.lit(hi)).alias("high")
    )


def spa(bench: DataFrame, alternatives: DataFrame, group, alt_key: str, ret: str = "r", reps: int = 100, block_length: float = 10.0, seed: str = "spa", block: int | None = None) -> DataFrame:
    """Superior-predictive-ability test per group: statistic and p-value.

    ``bench`` has group, i, ret; ``alternatives`` group, alt_key, i, n, ret on the same bars. Differences are
    benchmark minus alternative; all alternatives share the draws. The deviation of a mean is its spread over
    replicates (at least 1e-8); under the null a difference is centred unless it is far below zero.
    """
    group = list(group)
    ak = [*group, alt_key]
    b = bench.select(*group, "i", F.col(ret).alias("_b"))
    d = alternatives.join(b, [*group, "i"]).withColumn("d", F.col("_b") - F.col(ret))
    lengths = alternatives.groupBy(*group).agg(F.max("n").alias("n"))
    runs = draws(lengths, group, reps, block_length, seed, block)
    means = run_sums(runs, prefix_sums(d, ak, {"d": F.col("d")}, block), group, ak, ["d"]).withColumn("bm", F.col("sum_d") / F.col("n"))
    base = d.groupBy(*ak).agg(F.avg("d").alias("dbar"), F.count("*").alias("bars"))
    spread = means.groupBy(*ak).agg(F.var_pop("bm").alias("var"))
    s = base.join(spread, ak).withColumn("sigma", F.greatest(F.sqrt("var"), F.lit(1e-8)))
    far = -F.sqrt(F.col("var") / F.col("bars") * 2 * F.log(F.log("bars")))
    s = s.withColumn("shift", F.when(F.col("dbar") > far, F.col("dbar")).otherwise(0.0))
    t = s.groupBy(*group).agg(F.max(F.sqrt("bars") * F.col("dbar") / F.col("sigma")).alias("t_spa"))
    null = means.join(s.select(*ak, "sigma", "shift", "bars"), ak).groupBy(*group, "rep").agg(
        F.max(F.sqrt("bars") * (F.col("bm") - F.col("shift")) / F.col("sigma")).alias("t_b")
    )
    return null.join(t, group).groupBy(*group).agg(
        F.max("t_spa").alias("t_spa"), F.avg((F.col("t_b") >= F.col("t_spa")).cast("double")).alias("p_value")
    )


def exceedance(values: DataFrame, actual: DataFrame, keys, x: str, a: str) -> DataFrame:
    """Share of null values at or above the actual one."""
    return values.join(actual, list(keys)).groupBy(*keys).agg(F.avg((F.col(x) >= F.col(a)).cast("double")).alias("p_value"))


def spread(values: DataFrame, keys, x: str) -> DataFrame:
    """Mean and population deviation."""
    return values.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


# ── trade shuffling ──────────────────────────────────────────────────────────────────────────────────


def durations(sig: DataFrame, keys, block: int | None = None) -> DataFrame:
    """Holding periods in order: (keys, start, bars)."""
    d = holding_start(sig, keys, block).where("sig > 0")
    return d.groupBy(*keys, F.col("held_from").cast("bigint").alias("start")).agg(F.count("*").cast("bigint").alias("bars"))


def first_fit(bars, n: int, head: int, tail: int, draw) -> list[tuple[int, int]]:
    """Places of holding periods of lengths ``bars``, taken in order, as disjoint (start, end), sorted.

    ``draw(k)`` in [0, 1) is the k-th entry of an endless list of slots. Slots in order of their first appearance in it are a shuffled list,
    so a period takes the first entry that is free for its whole length and ends before row ``n``. What is held are the periods placed and
    the entries looked at (the slots over the free ones, on average); a period for which no slot is left is found from the gaps.
    """
    starts, ends, slots = [], [], []
    width = max(n - tail - head, 0)
    for length in bars:
        last = min(head + width, n - length)  # starts lie below it
        k = 0
        while last > head:
            if k == 64:  # rarely: is there any room?
                edges = zip([head, *ends], [*starts, n])
                if not any(max(x, head) < last and y - max(x, head) >= length for x, y in edges):
                    break
            if k == len(slots):
                slots.append(head + int(draw(k) * width))
            slot = slots[k]
            k += 1
            at = bisect.bisect_right(starts, slot)
            if slot < last and (not at or ends[at - 1] <= slot) and (at == len(starts) or slot + length <= starts[at]):
                starts.insert(at, slot)
                ends.insert(at, slot + length)
                break
    return list(zip(starts, ends))


def shuffled_trades(trades: DataFrame, lengths: DataFrame, keys, reps: int, head: int = 20, tail: int = 80, seed: str = "shuffle") -> DataFrame:
    """Every replicate puts each holding period, in order, at the first free slot of a shuffled list of bars.

    Slots are ``head .. n - tail - 1`` (0-based); a period must end before the series does and must not overlap
    an earlier one; one without a slot is left out. Adjacent periods merge, because no trade happens between
    them. Returns (keys, rep, a, z): signal bars ``a .. z - 1``. Placement is sequential by nature, over one replicate's
    periods, a few numbers each; nothing in it is as long as the series.
    """
    keys = list(keys)
    per_key = trades.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "bars"))).alias("t"))
    d = per_key.join(lengths, keys).select(
        *keys, F.col("n").cast("bigint").alias("n"), F.col("t.bars").alias("bars"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    ).repartition(_tasks(trades), *keys, "rep")
    names = [f.name for f in d.schema if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keys)

    def place(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ident = [getattr(row, k) for k in names]
                key = ":".join([seed, *[str(x) for x in ident], str(row.rep)])
                merged = []
                for start, end in first_fit([int(x) for x in row.bars], int(row.n), head, tail, lambda k: uniform_of(key, k)):  # noqa: B023
                    if merged and merged[-1][1] == start:
                        start = merged.pop()[0]
                    merged.append((start, end))
                out += [(*ident, row.rep, *m) for m in merged]
            yield pd.DataFrame(out, columns=[*names, "rep", "a", "z"])

    return d.mapInPandas(place, f"{schema}, rep int, a bigint, z bigint")


def shuffled_returns(periods: DataFrame, prices: DataFrame, keys, reps: int, leverage: float = 5.0, buy_bps: float = 5.0, sell_bps: float = 15.0) -> DataFrame:
    """Cumulative return of each replicate's ledger: (keys, rep, ret).

    A period with signal bars ``a .. z-1`` is bought at bar ``a+1`` and sold at bar ``z+1`` (0-based), so its
    factor needs the entry, exit and lowest close: one equi-join of held bars with prices and one aggregation.
    A period whose value before trading is not positive anywhere ruins the replicate. A purchase at a price of 0 is of no number of
    shares: the return is NaN, unless there was a ruin in an earlier period.
    """
    keys = list(keys)
    px = prices.select(*keys, (F.col("i") - 1).cast("bigint").alias("at"), "close", F.col("n").cast("bigint").alias("n"))
    # one row per held bar, from entry a+1 to exit z+1 (dropped by the join when past the end); sorted, as in ``run_sums``
    held = periods.withColumn("at", F.explode(F.sequence(F.col("a") + 1, F.col("z") + 1)))
    d = held.join(px.hint("merge"), [*keys, "at"])
    g = d.groupBy(*keys, "rep", "a", "z").agg(
        F.min_by("close", "at").alias("p0"), F.max_by("close", "at").alias("p1"), F.min("close").alias("lo"), F.max("at").alias("last")
    )
    b, s = buy_bps / 10000, sell_bps / 10000
    h = lambda p: 1 + leverage * (ratio(F.col(p), F.col("p0")) - 1) - leverage * b
    fee = F.when(F.col("last") == F.col("z") + 1, ratio(leverage * s * F.col("p1"), F.col("p0"))).otherwise(0.0)
    unknown = F.col("p0") == 0
    g = g.withColumn("factor", F.when(unknown, None).when(h("lo") <= 0, 0.0).otherwise(F.greatest(h("p1") - fee, F.lit(0.0))))
    never = F.lit(2**62)
    got = g.groupBy(*keys, "rep").agg(
        F.product("factor").alias("_base"),
        F.coalesce(F.min(F.when(F.col("factor") == 0, F.col("a"))), never).alias("_dead"), F.coalesce(F.min(F.when(unknown, F.col("a"))), never).alias("_unknown"),
    )
    ret = F.when(F.col("_unknown") < F.col("_dead"), float("nan")).when(F.col("_dead") < never, -1.0).otherwise(F.col("_base") - 1)
    got = got.select(*keys, "rep", ret.alias("ret"))
    # replicates in which nothing could be placed return 0
    every = prices.select(*keys).distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return every.join(got, [*keys, "rep"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
