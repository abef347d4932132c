"""Return, volatility and technical features as window columns over one exchange.

Rolling frames see the rows each block looks back on (one exchange); exponential averages carry exact sums from block to block. Warm-up rules: rolling frames that need a full window are NULL until it
is filled; exponential averages start from the first value; Wilder averages start from the plain mean of the
first ``period`` values; RSI averages start from 0 on the first bar and are shown from bar 14 on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.operators.blocks import decayed_sums, halo, in_block, owned, rows
from tidebars.session import KEYS

# The two feature registries.
TECHNICAL = ["rsi_14", "macd", "macd_signal", "macd_diff", "bb_width", "cci_30", "dx_30", "atr_14"]
RETURNS = ["return_simple", "return_log", "vol_rolling_30", "vol_ewma"]
FEATURES = TECHNICAL + RETURNS

EMA12, EMA26, EMA9 = 1 - 2 / 13, 1 - 2 / 27, 1 - 2 / 10
WILDER14, WILDER30 = 13 / 14, 29 / 30
EWM30 = 1 - 2 / 31
#: Rows that rolling frames and lags look back on.
LOOKBACK = 32


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return num / F.nullif(den, F.lit(0.0))


def lag(col: str, n: int = 1, keys=KEYS) -> Column:
    return F.lag(col, n).over(in_block(keys))


def full(col: Column, width: int) -> Column:
    return F.when(F.col("i") >= width, col)


def simple_return(col: str = "close", keys=KEYS) -> Column:
    return ratio(F.col(col), lag(col, keys=keys)) - 1


def log_return(col: str = "close", keys=KEYS) -> Column:
    return F.log(ratio(F.col(col), lag(col, keys=keys)))


def true_range(keys=KEYS) -> Column:
    """High minus low on the first bar, afterwards the widest of the three ranges."""
    prev = lag("close", keys=keys)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def rolling_vol(col: str, width: int, keys=KEYS) -> Column:
    """Sample deviation over up to ``width`` rows; NULL for one value."""
    return F.stddev_samp(col).over(rows(1 - width, keys=keys))


def bollinger_width(width: int = 20, k: float = 2.0, keys=KEYS) -> Column:
    w = rows(1 - width, keys=keys)
    return full(ratio(2 * k * F.stddev_pop("close").over(w), F.avg("close").over(w)), width)


def cci(df: DataFrame, width: int = 30, keys=KEYS, out: str = "cci_30") -> DataFrame:
    w = rows(1 - width, keys=keys)
    d = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    d = d.withColumn("_m", F.avg("_tp").over(w)).withColumn("_tps", F.collect_list("_tp").over(w))
    mad = F.aggregate("_tps", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / width
    return d.withColumn(out, full(ratio(F.col("_tp") - F.col("_m"), 0.015 * mad), width)).drop("_tp", "_m", "_tps")


def ema_drive(x: Column, a: float, first: Column | int = 1) -> Column:
    """Input of ``decayed_sums`` for an exponential average that starts as its first value at row ``first``."""
    i = F.col("i")
    return F.when(i > first, (1 - a) * x).when(i == first, x)


def wilder_drive(x: Column, period: int, start: int = 1) -> Column:
    """Input for Wilder's average of rows ``start..``: the mean of the first ``period`` values is the seed, which is reached
    by giving each of those values the weight that the decay up to the seed takes away again."""
    i, a, seed_at = F.col("i"), 1 - 1 / period, start + period - 1
    return F.when(i > seed_at, x / period).when(i >= start, x / period * F.exp((i - seed_at) * math.log(a)))


# Each average below is a part: columns made from a haloed frame, what is summed, and the columns that come out of the sums.


def _atr_part(d: DataFrame, keys, period: int = 14, out: str = "atr_14"):
    d = d.withColumn("_tr", true_range(keys))
    return d, {"_atr": (wilder_drive(F.col("_tr"), period), 1 - 1 / period)}, lambda x: x.withColumn(out, full(F.col("_atr"), period))


def _rsi_part(d: DataFrame, keys, period: int = 14, out: str = "rsi_14"):
    a = 1 - 1 / period
    d = d.withColumn("_d", F.coalesce(F.col("close") - lag("close", keys=keys), F.lit(0.0)))
    sums = {"_g": (F.greatest(F.col("_d"), F.lit(0.0)) / period, a), "_ls": (F.greatest(-F.col("_d"), F.lit(0.0)) / period, a)}
    rsi = F.when(F.col("_ls") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("_g"), F.col("_ls"))))
    return d, sums, lambda x: x.withColumn(out, full(rsi, period))


def _macd_part(d: DataFrame, keys):
    c = F.col("close")
    sums = {"_f": (ema_drive(c, EMA12), EMA12), "_s": (ema_drive(c, EMA26), EMA26)}
    return d, sums, lambda x: x.withColumn("macd", full(F.col("_f") - F.col("_s"), 26))


def _adx_part(d: DataFrame, keys, period: int = 30):
    a = 1 - 1 / period
    d = d.withColumn("_up", F.col("high") - lag("high", keys=keys)).withColumn("_dn", lag("low", keys=keys) - F.col("low")).withColumn("_rng", true_range(keys))
    plus = F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    minus = F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0)
    sums = {o: (wilder_drive(u, period, 2), a) for o, u in (("_pd", plus), ("_md", minus), ("_rd", F.col("_rng")))}
    p, m = ratio(F.col("_pd"), F.col("_rd")), ratio(F.col("_md"), F.col("_rd"))
    return d, sums, lambda x: x.withColumn("_dx", full(F.coalesce(100 * ratio(F.abs(p - m), p + m), F.lit(0.0)), period + 1))


def _ewma_part(d: DataFrame, keys, span: int = 30, out: str = "vol_ewma"):
    a = 1 - 2 / (span + 1)
    d = d.withColumn("_lr", log_return(keys=keys))
    x = F.col("_lr")
    one = F.when(x.isNotNull(), 1.0)
    sums = {"_s0": (one, a), "_s1": (x, a), "_s2": (x * x, a), "_ss": (one, a * a)}
    s0, s1, s2, ss = (F.col(c) for c in sums)
    mean = ratio(s1, s0)
    var = ratio(F.greatest(ratio(s2, s0) - mean * mean, F.lit(0.0)) * s0 * s0, s0 * s0 - ss)
    # the value's own weight is 1, so more than that means a second value; with one, the bias term is rounding noise
    return d, sums, lambda y: y.withColumn(out, F.when(x.isNotNull() & (s0 > 1 + 1e-12), F.sqrt(var)))


def _second_macd():
    sums = {"_sig": (ema_drive(F.col("macd"), EMA9, 26), EMA9)}
    return sums, lambda x: x.withColumn("macd_signal", full(F.col("_sig"), 34)).withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))


def _second_adx(period: int = 30, out: str = "dx_30"):
    sums = {"_adx": (wilder_drive(F.col("_dx"), period, period + 1), 1 - 1 / period)}
    return sums, lambda x: x.withColumn(out, full(F.col("_adx"), 2 * period))


def _summed(series: DataFrame, first, second, keys, block, also=lambda d: d) -> DataFrame:
    """``series`` with the parts ``first``, and the parts ``second`` over what they give. One exchange for frames, one pass for each level."""
    d, sums, ends = also(halo(series, LOOKBACK, block)), {}, []
    have = [*series.columns, *[c for c in d.columns if c not in series.columns and c[0] != "_" and c not in ("blk", "more")]]
    made = set(have)
    for part in first:
        d, s, end = part(d, keys)
        sums |= s
        ends.append(end)
    d = decayed_sums(owned(d), sums, keys, block)
    for end in ends:
        d = end(d)
    levels = [part() for part in second]
    if levels:
        d = decayed_sums(d, {o: s for sums, _ in levels for o, s in sums.items()}, keys, block)
        for _, end in levels:
            d = end(d)
    new = [c for c in d.columns if c not in made and c[0] != "_" and c not in ("blk", "more")]
    return d.select(*have, *new)


def add_atr(series: DataFrame, period: int = 14, keys=KEYS, out: str = "atr_14", block: int | None = None) -> DataFrame:
    return _summed(series, [lambda d, k: _atr_part(d, k, period, out)], [], keys, block)


def add_rsi(series: DataFrame, period: int = 14, keys=KEYS, out: str = "rsi_14", block: int | None = None) -> DataFrame:
    return _summed(series, [lambda d, k: _rsi_part(d, k, period, out)], [], keys, block)


def add_macd(series: DataFrame, keys=KEYS, block: int | None = None) -> DataFrame:
    """Line from bar 26, signal and difference from bar 34; the signal average starts at bar 26."""
    return _summed(series, [_macd_part], [_second_macd], keys, block)


def add_adx(series: DataFrame, period: int = 30, keys=KEYS, out: str = "dx_30", block: int | None = None) -> DataFrame:
    """Wilder's index: directional moves and range from bar 2, averages from bar ``period+1``, the index
    itself from bar ``2*period``."""
    return _summed(series, [lambda d, k: _adx_part(d, k, period)], [lambda: _second_adx(period, out)], keys, block)


def add_ewma_vol(series: DataFrame, span: int = 30, keys=KEYS, out: str = "vol_ewma", block: int | None = None) -> DataFrame:
    """Bias-corrected deviation of log returns under weights that decay with ``1 - 2/(span+1)``; NULL for a single value."""
    return _summed(series, [lambda d, k: _ewma_part(d, k, span, out)], [], keys, block)


def with_features(series: DataFrame, keys=KEYS, block: int | None = None) -> DataFrame:
    """All twelve features on indexed bars. One exchange for rolling frames, and two passes of block sums: the signal line and the
    index of directional movement are averages of averages."""

    def frames(d):
        d = d.withColumn("return_simple", simple_return(keys=keys)).withColumn("return_log", log_return(keys=keys))
        d = d.withColumn("vol_rolling_30", rolling_vol("return_log", 30, keys))
        return cci(d.withColumn("bb_width", bollinger_width(keys=keys)), keys=keys)

    return _summed(series, [_ewma_part, _rsi_part, _macd_part, _adx_part, _atr_part], [_second_macd, _second_adx], keys, block, frames)


def with_zscores(df: DataFrame, cols=FEATURES, width: int = 252, keys=KEYS, block: int | None = None) -> DataFrame:
    """Rolling z-score of each column, shorter windows at the start, NULL where the deviation is 0.

    A frame this wide is re-read for every row by a window expression, column by column; here one vectorised
    two-pass computation per block does all columns. Blocks are as bounded as ever, with ``width`` rows of halo.
    """
    d = halo(df, width, block)
    extra = [T.StructField(f"{c}_z", T.DoubleType()) for c in cols]
    schema = T.StructType([*d.schema.fields, *extra])

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        for c in cols:
            x = table.column(c).to_numpy(zero_copy_only=False).astype(float)
            z = _zscore(x, width)
            table = table.append_column(f"{c}_z", pa.array(z, mask=np.isnan(z)))
        # times come in under the session's zone name and must go back under UTC
        utc = [f.with_type(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f for f in table.schema]
        return table.cast(pa.schema(utc))

    return owned(d.groupBy(*keys, "blk", "more").applyInArrow(score, schema))


def _zscore(x: np.ndarray, width: int, step: int = 2048) -> np.ndarray:
    """z of each value in the window ending at it; missing values are left out of the window."""
    padded = np.r_[np.full(width - 1, np.nan), x]
    frames = np.lib.stride_tricks.sliding_window_view(padded, width)
    z = np.full(len(x), np.nan)
    for a in range(0, len(x), step):  # keeps the temporary matrix small
        f = frames[a : a + step]
        ok = ~np.isnan(f)
        n = ok.sum(axis=1)
        m = np.where(ok, f, 0.0).sum(axis=1) / np.maximum(n, 1)
        dev = np.where(ok, f - m[:, None], 0.0)
        sd = np.sqrt((dev * dev).sum(axis=1) / np.maximum(n - 1, 1))
        flat = np.where(ok, f, -np.inf).max(axis=1) == np.where(ok, f, np.inf).min(axis=1)
        good = (n > 1) & (sd > 0) & ~flat
        z[a : a + step] = np.where(good, (x[a : a + step] - m) / np.where(good, sd, 1.0), np.nan)
    return z


def sma(col: str, width: int, keys=KEYS, shift: int = 0) -> Column:
    """Mean of ``width`` rows ending ``shift`` rows ago, NULL until they exist."""
    mean = F.avg(col).over(rows(1 - width - shift, -shift, keys))
    return F.when(F.col("i") >= width + shift, mean)


def state_tensor(df: DataFrame, cols, lookback: int = 60, keys=KEYS, block: int | None = None) -> DataFrame:
    """``tensor``: the last ``lookback`` float vectors per bar, full windows only; NULL and non-finite become 0."""
    d = halo(df, lookback, block)
    vec = F.array(*[finite_or_zero(F.col(c)).cast("float") for c in cols])
    d = d.withColumn("_v", vec).withColumn("tensor", F.collect_list("_v").over(rows(1 - lookback, keys=keys)))
    return owned(d).where(F.col("i") >= lookback).drop("_v")


def finite_or_zero(c: Column) -> Column:
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))


def existing(df: DataFrame, cols) -> list[str]:
    """Registry names the frame has, in registry order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column, one row each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.explode(pairs).alias("p")).select("p.feature", "p.x").where("x is not null")
    return summarise(long, "feature", "x")


def summarise(long: DataFrame, key: str, x: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    stats = long.groupBy(key).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    q = quantiles(long, [key], x, probs)
    wide = q.groupBy(key).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{round(p * 1000)}") for p in probs])
    return stats.join(wide, key)


def quantiles(long: DataFrame, keys: list[str], x: str, probs, side: int = 16) -> DataFrame:
    """Exact linear quantiles without putting a key's rows in one task.

    Distinct values are counted and cut into ``side**2`` ranges at approximate quantiles of the key (a bounded
    sketch that only balances the ranges), numbered inside each range, and shifted by the counts of lower
    ranges; the two order statistics around each quantile are then picked by rank.
    """
    counts = long.groupBy(*keys, F.col(x).alias("v")).agg(F.count("*").alias("m"))
    cuts = [k / side**2 for k in range(1, side**2)]
    about = counts.groupBy(*keys).agg(F.sum("m").alias("N"), F.percentile_approx("v", cuts, 10 * side**2).alias("cut"))
    c = counts.join(about, keys)
    # range of a value: first among every side-th cut, then among the cuts that follow it
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda k: F.element_at("cut", k * side)), lambda e: e < F.col("v")))
    c = c.withColumn("g", coarse)
    c = c.withColumn("g", F.col("g") * side + F.size(F.filter(F.slice("cut", F.col("g") * side + 1, F.lit(side - 1)), lambda e: e < F.col("v")))).drop("cut")
    per_g = c.groupBy(*keys, "g").agg(F.sum("m").alias("gm"))
    below = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # at most side**2 rows
    off = per_g.select(*keys, "g", F.coalesce(F.sum("gm").over(below), F.lit(0)).alias("off"))
    w = Window.partitionBy(*keys, "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = c.join(off, [*keys, "g"]).withColumn("upto", F.sum("m").over(w) + F.col("off"))
    at = F.col("prob") * (F.col("N") - 1)
    hit = (
        ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("k0", F.floor(at)).withColumn("frac", at - F.floor(at))
        .withColumn("k1", F.least(F.col("k0") + 1, F.col("N") - 1))
        .withColumn("from", F.col("upto") - F.col("m"))
    )
    has = lambda k: (F.col(k) >= F.col("from")) & (F.col(k) < F.col("upto"))
    pick = lambda k: F.max(F.when(has(k), F.col("v")))
    return (
        hit.where(has("k0") | has("k1")).groupBy(*keys, "prob", "frac").agg(pick("k0").alias("a"), pick("k1").alias("b"))
        .select(*keys, "prob", (F.col("a") + F.col("frac") * (F.col("b") - F.col("a"))).alias("value"))
    )


def fill_forward(df: DataFrame, cols, keys=KEYS) -> DataFrame:
    """Last known value per series; the carry crosses blocks."""
    from tidebars.operators.blocks import block_scan

    filled = block_scan(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, keys)
    return filled.drop(*cols).withColumnsRenamed({f"_f_{c}": c for c in cols})
