"""Row blocks: how one long series is spread over many tasks.

A series is a key (symbol, timeframe, perhaps a config) whose rows carry ``i`` (1-based position) and
``n`` (length). Rows ``1..BLOCK`` form block 0, the next ``BLOCK`` rows block 1, and so on; the shuffle
key of every operator is (series, block), so the longest series never decides the size of a task.

* Operators with a bounded reach (rolling frames, lags) copy the last ``lookback``
  rows of a block into the following one (``halo``), run plain window expressions, and keep the rows a
  block owns (``owned``): one exchange, no join.
* Operators with an unbounded reach (running sum, product, maximum, last value, exponential averages) run the same
  window inside each block, write the rows, scan the blocks' last values, and add the carry back (``block_scan``,
  ``decayed_sums``). Nothing depends on how long a series is.

``more`` says that a later block exists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.session import KEYS, cut

BLOCK = 16384
SUB = 2048  # rows over which decay weights are rescaled; 0.72**-2048 is still a double


def index_series(df: DataFrame, keys=KEYS, ts: str = "ts", chunk: str = "year", tie: str | None = None) -> DataFrame:
    """Add ``i`` and ``n``: rows are numbered inside (series, calendar chunk) and shifted by the counts of
    earlier chunks, so no task sees more than one chunk of a series. (series, ts) must be unique, or (series, ts, tie)."""
    keys = list(keys)
    df = df.withColumn("_c", F.date_trunc(chunk, F.col(ts).cast("timestamp")))
    per_key = Window.partitionBy(*keys)
    counts = (
        df.groupBy(*keys, "_c").agg(F.count("*").alias("_m"))
        .select(
            *keys, "_c",
            F.coalesce(
                F.sum("_m").over(per_key.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_off"),
            F.sum("_m").over(per_key).alias("n"),
        )
    )
    rn = F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(ts, *([tie] if tie else [])))
    return (
        df.join(counts, [*keys, "_c"])
        .withColumn("i", rn + F.col("_off"))
        .drop("_c", "_off")
    )


def _div(expr: str, block: int) -> Column:
    return F.expr(f"({expr}) div {int(block)}")


def with_blocks(df: DataFrame, block: int | None = None) -> DataFrame:
    b = block or BLOCK
    if "blk" not in df.columns:
        df = df.withColumn("blk", _div("i - 1", b)).withColumn("more", F.col("blk") < _div("n - 1", b))
    return df if "_run" in df.columns else df.withColumn("_run", _div("i - 1", SUB))


def halo(df: DataFrame, lookback: int, block: int | None = None) -> DataFrame:
    """Send every row to its own block and to each later block that looks back on it."""
    b = block or BLOCK
    df = df.drop("blk", "more", "_run").withColumn("_own", _div("i - 1", b)).withColumn("_run", _div("i - 1", SUB))
    last = _div("n - 1", b)
    reach = F.least(_div(f"i - 1 + {int(lookback)}", b), last)
    return (
        df.withColumn("blk", F.explode(F.sequence("_own", reach)))
        .withColumn("more", F.col("blk") < last)
    )


def owned(df: DataFrame) -> DataFrame:
    return df.where("blk = _own").drop("_own")


def in_block(keys=KEYS):
    """Rows of a block in order. ``_run`` (the number of a run of ``SUB`` rows) never decreases with ``i``, so it does
    not change the order; naming it lets windows per block and windows per run share one sort."""
    return Window.partitionBy(*keys, "blk", "more").orderBy("_run", "i")


def rows(a: int, b: int = 0, keys=KEYS):
    return in_block(keys).rowsBetween(a, b)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product}


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if kind == "product":
        return F.coalesce(local * carry, local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def block_scan(df: DataFrame, specs: dict[str, tuple[str, Column]], keys=KEYS, block: int | None = None) -> DataFrame:
    """Running ``sum``/``product``/``max``/``min``/``last`` (last non-null) over whole series.

    Rows are written once with their running values; a block's last row holds its totals, which are scanned for each
    series and joined back. The plan is the same for any length, and a chain of scans does not multiply its input.
    """
    keys, b = list(keys), block or BLOCK
    df = with_blocks(df, b)
    local_w = in_block(keys).rowsBetween(Window.unboundedPreceding, 0)

    def running(x, kind, w):
        return F.last(x, ignorenulls=True).over(w) if kind == "last" else _AGG[kind](x).over(w)

    ins = df.select("*", *[c.alias(f"_x_{o}") for o, (_, c) in specs.items()])
    local = cut(ins.select(*df.columns, *[running(F.col(f"_x_{o}"), kind, local_w).alias(f"_l_{o}") for o, (kind, _) in specs.items()]))
    # the last row a block has, which need not be its last possible one where rows were filtered
    at = Window.partitionBy(*keys, "blk", "more").orderBy(F.col("_run").desc(), F.col("i").desc())
    totals = local.where("more").withColumn("_rn", F.row_number().over(at)).where("_rn = 1")
    carry_w = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy("blk")
    # a block without rows passes the carry on: it reaches up to the next block that has some
    carry = totals.select(
        *keys, F.col("n").alias("_n"), (F.col("blk") + 1).alias("_from"), F.coalesce(F.lead("blk").over(later), _div("n - 1", b)).alias("_to"),
        *[running(F.col(f"_l_{o}"), kind, carry_w).alias(f"_c_{o}") for o, (kind, _) in specs.items()],
    )
    carry = carry.withColumn("blk", F.explode(F.sequence("_from", "_to"))).withColumn("more", F.col("blk") < _div("_n - 1", b)).drop("_n", "_from", "_to")
    joined = local.join(carry, [*keys, "blk", "more"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(kind, F.col(f"_l_{o}"), F.col(f"_c_{o}")).alias(o) for o, (kind, _) in specs.items()],
    )


def _carry_step(field: str, a: float):
    return lambda acc, e: acc * F.lit(a**SUB) + e[field]


def _block_sums(df: DataFrame, specs: dict[str, tuple[Column, float]], keys) -> DataFrame:
    """``decayed_sums`` as if every block began a series. Inside runs of ``SUB`` rows it is a rescaled prefix sum;
    earlier runs of the block enter through their last value."""
    cols = df.columns
    p = F.col("_p")
    run_w = Window.partitionBy(*keys, "blk", "more", "_run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = in_block(keys).rowsBetween(Window.unboundedPreceding, -1)
    # a run begins where its block does, so blocks need not be multiples of a run
    first = F.greatest(F.col("_run") * SUB, F.col("blk") * F.col("_b"))
    d = df.withColumn("_p", (F.col("i") - 1 - first).cast("double")).withColumn("_len", F.when(F.col("_run") * SUB >= F.col("blk") * F.col("_b"), SUB).otherwise(SUB - (F.col("blk") * F.col("_b") - F.col("_run") * SUB)).cast("double"))
    d = d.select(
        "*",
        *[
            (F.coalesce(F.sum(u * F.exp(p * -math.log(a))).over(run_w), F.lit(0.0)) * F.exp(p * math.log(a))).alias(f"_s_{o}")
            for o, (u, a) in specs.items()
        ],
    )
    ends = F.collect_list(F.when(p == F.col("_len") - 1, F.struct(*[F.col(f"_s_{o}") for o in specs]))).over(before)
    d = d.withColumn("_ends", ends)
    out = []
    for o, (_, a) in specs.items():
        carry = F.aggregate("_ends", F.lit(0.0), _carry_step(f"_s_{o}", a))
        out.append((F.col(f"_s_{o}") + F.exp((p + 1) * math.log(a)) * carry).alias(o))
    return d.select(*cols, *out)


def decayed_sums(df: DataFrame, specs: dict[str, tuple[Column, float]], keys=KEYS, block: int | None = None) -> DataFrame:
    """``y[i] = sum over j <= i of u[j] * a**(i-j)`` over whole series for each ``out: (u, a)``; NULL ``u`` counts as 0.

    Every first-order recurrence ``y = a*y + u`` (exponential and Wilder averages) is such a sum. Each block sums its
    own rows; its last sum is its total, and what earlier blocks add to a row is one number for each block. The
    carry takes in as many blocks as have a weight that is not 0 in double precision. Rows are written once, since
    sums and totals are both read from them. The plan is the same for any length.
    """
    for _, a in specs.values():
        if not 0.72 <= a < 1:
            raise ValueError("decay factor must lie in [0.72, 1)")
    keys, b = list(keys), block or BLOCK
    cols = [c for c in df.columns if c not in ("blk", "more", "_run", "_own")]
    d = with_blocks(df.select(*cols), b).withColumn("_b", F.lit(b))
    local = cut(_block_sums(d, {f"_l_{o}": spec for o, spec in specs.items()}, keys).drop("_b"))
    ends = local.where((F.col("more")) & (F.col("i") == (F.col("blk") + 1) * b))
    deep = 1 + max(math.ceil(745 / (-math.log(a) * b)) for _, a in specs.values())
    w = Window.partitionBy(*keys).orderBy("blk").rowsBetween(-deep, 0)
    totals = ends.select(*keys, "blk", F.collect_list(F.struct(*[F.col(f"_l_{o}").alias(o) for o in specs])).over(w).alias("_t"), (F.col("blk") + 1 < _div("n - 1", b)).alias("more"))
    step = lambda o, a: lambda acc, e: acc * F.lit(a**b) + e[o]
    carry = totals.select(*keys, (F.col("blk") + 1).alias("blk"), "more", *[F.aggregate("_t", F.lit(0.0), step(o, a)).alias(f"_c_{o}") for o, (_, a) in specs.items()])
    since = (F.col("i") - F.col("blk") * b).cast("double")
    out = [(F.col(f"_l_{o}") + F.coalesce(F.exp(since * math.log(a)) * F.col(f"_c_{o}"), F.lit(0.0))).alias(o) for o, (_, a) in specs.items()]
    return local.join(carry, [*keys, "blk", "more"], "left").select(*cols, "blk", "more", *out)


def fold_in_order(df: DataFrame, keys, order: str, fold, schema: str) -> DataFrame:
    """Rules that decide each row from the row before: every series is read in order, one Arrow batch at a time.

    ``fold(state, chunk)`` gets the next rows of one series (a pandas frame) and what it returned for the rows before
    (None at first), and returns its state and the rows to emit. Spark sorts and spills; Python holds a batch and a state, never a series.
    """
    keys = list(keys)

    def run(batches):
        last, state = None, None
        for pdf in batches:
            names = pdf[keys]
            starts = np.flatnonzero((names != names.shift()).any(axis=1).to_numpy())
            done = []
            for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
                key = tuple(names.iloc[a])
                if key != last:
                    last, state = key, None
                state, out = fold(state, pdf.iloc[a:b])
                if len(out):
                    done.append(out)
            if done:  # one frame for each batch read, however many short series it holds
                yield pd.concat(done)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
