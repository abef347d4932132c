"""Walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN, TEST, STEP, MIN_TAIL = 252, 63, 63, 10  # fixed values, in bars


def folds_of(n, train: int = TRAIN, test: int = TEST, step: int = STEP, tail: int = MIN_TAIL):
    """Array of (fold, train_start, train_end, test_start, test_end), 0-based half-open, for a series of ``n``
    bars: full test windows, then one partial window if it has at least ``tail`` bars."""
    # Number of full windows, and the candidate after them.
    full = F.greatest(F.floor((n - train - test) / step) + 1, F.lit(0))
    ks = F.sequence(F.lit(0).cast("bigint"), full.cast("bigint"))
    made = F.transform(ks, lambda k: F.struct(
        k.alias("fold"), (k * step).alias("train_start"), (k * step + train).alias("train_end"),
        (k * step + train).alias("test_start"), F.least(k * step + train + test, n).alias("test_end"),
    ))
    return F.filter(made, lambda f: (f["train_start"] + train + test <= n) | (n - f["test_start"] >= tail))


def splits(series: DataFrame, keys=("symbol", "timeframe"), **kw) -> DataFrame:
    """One row per fold of each series; a series too short for any fold has none."""
    n = series.groupBy(*keys).agg(F.max("n").cast("bigint").alias("n"))
    return n.withColumn("f", F.explode(folds_of(F.col("n"), **kw))).select(*keys, "n", "f.*")


def with_test_fold(series: DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP, tail: int = MIN_TAIL) -> DataFrame:
    """Bars with the folds that test on them. The folds of a bar follow from its position, so no range join
    is planned: at most ``ceil(test/step)`` candidates per bar, checked against the fold rule."""
    pos, n = F.col("i") - 1, F.col("n").cast("bigint")
    hi = F.floor((pos - train) / step).cast("bigint")
    lo = F.greatest(F.floor((pos - train - test) / step).cast("bigint") + 1, F.lit(0).cast("bigint"))
    d = series.where(F.col("i") > train).withColumn("fold", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))
    start = F.col("fold") * step
    d = d.withColumns({
        "train_start": start, "train_end": start + train, "test_start": start + train, "test_end": F.least(start + train + test, n),
    })
    ok = (start + train + test <= n) | ((n - F.col("test_start") >= tail) & (F.col("fold") == F.greatest(F.floor((n - train - test) / step) + 1, F.lit(0))))
    return d.where(ok & (pos < F.col("test_end")))
