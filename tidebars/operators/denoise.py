"""Price and velocity from a two-state filter (constant-velocity model, price observed).

Within a block the filter is the usual predict/update recursion on five numbers. Blocks of one series are
chained exactly: a block's effect on (mean, covariance) has a closed form with 14 numbers
(the associative element of Särkkä and García-Fernández, "Temporal Parallelization of Bayesian Smoothers",
2021), so blocks are reduced in parallel, one row per block is relayed along the series, and every block then
runs from its exact starting state. The first bar seeds price with the observation, velocity 0 and
covariance 1000*I; the first ``warmup`` outputs show the raw price and velocity 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import _div, BLOCK, halo, owned, with_blocks
from tidebars.operators.features import add_atr, rows
from tidebars.session import KEYS

# The three presets (process noise, measurement noise, adaptive) and the warm-up.
PRESETS = {"price": (0.3, 3.0, False), "trend": (0.1, 10.0, False), "adaptive": (0.5, 5.0, True)}
WARMUP = 20
P0 = 1000.0

_STATE = ["x0", "x1", "p00", "p01", "p11"]
_ELEM = [f"e{k}" for k in range(14)]


def noise_scale(series: DataFrame, period: int = 14, keys=KEYS, backfill: bool = False, block: int | None = None, atr: str = "atr") -> DataFrame:
    """Add ``atr`` for the adaptive noise. With ``backfill`` the first ``period - 1`` rows take the first
    value (this looks ahead); without it they keep the base noise."""
    d = add_atr(series, period, keys, atr, block)
    if backfill:
        d = halo(d, 0, block)
        # rows before the seed are all in block 0, so a frame of period rows reaches the seed
        ahead = F.first(atr, ignorenulls=True).over(rows(0, period, keys))
        d = owned(d.withColumn(atr, F.coalesce(F.col(atr), ahead)))
    return d


def scale_of(atr, r):
    """Factor on both noises: ATR over base measurement noise, kept in [0.1, 10]; 1 while there is no ATR."""
    s = F.greatest(F.lit(0.1), F.least(F.lit(10.0), atr / F.greatest(r, F.lit(1e-8))))
    return F.coalesce(F.when(atr > 0, s), F.lit(1.0))


def _step(m0, m1, p00, p01, p11, z, q, r):
    m0 += m1
    p00, p01, p11 = p00 + 2 * p01 + p11 + 0.25 * q, p01 + p11 + 0.5 * q, p11 + q
    s = p00 + r
    k0, k1, y = p00 / s, p01 / s, z - m0
    return m0 + k0 * y, m1 + k1 * y, k0 * r, r / s * p01, p11 - k1 * p01


def _run(z, q, r, first: bool, state):
    out = np.empty((len(z), 2))
    start = 0
    if first:
        state = (z[0], 0.0, P0, 0.0, P0)
        out[0] = state[:2]
        start = 1
    m0, m1, p00, p01, p11 = state
    for k in range(start, len(z)):
        m0, m1, p00, p01, p11 = _step(m0, m1, p00, p01, p11, z[k], q[k], r[k])
        out[k] = m0, m1
    return out, (m0, m1, p00, p01, p11)


_F = np.array([[1.0, 1.0], [0.0, 1.0]])
_H = np.array([1.0, 0.0])
_I2 = np.eye(2)


def _elements(z, q, r):
    """The filter steps of rows ``z`` as 2x2 elements, all rows at once."""
    qm = q[:, None, None] * np.array([[0.25, 0.5], [0.5, 1.0]])
    s = qm[:, 0, 0] + r
    k = qm[:, :, 0] / s[:, None]
    ikh = _I2 - k[:, :, None] * _H
    fh = _F.T @ _H
    return ikh @ _F, k * z[:, None], ikh @ qm, z[:, None] * fh / s[:, None], np.outer(fh, fh) / s[:, None, None]


def _inverse(m):
    """Of 2x2 matrices with positive determinant."""
    det = m[..., 0, 0] * m[..., 1, 1] - m[..., 0, 1] * m[..., 1, 0]
    turned = np.stack([np.stack([m[..., 1, 1], -m[..., 0, 1]], -1), np.stack([-m[..., 1, 0], m[..., 0, 0]], -1)], -2)
    return turned / det[..., None, None]


def _compose(a, b):
    """One element for element ``a`` followed by ``b``, over arrays of them."""
    a1, b1, c1, h1, j1 = a
    a2, b2, c2, h2, j2 = b
    on = lambda m, v: (m @ v[..., None])[..., 0]
    t = lambda m: np.swapaxes(m, -1, -2)
    d = _inverse(_I2 + c1 @ j2)
    fwd, back = a2 @ d, t(a1) @ t(d)
    return fwd @ a1, on(fwd, b1 + on(c1, h2)) + b2, fwd @ c1 @ t(a2) + c2, on(back, h2 - on(j2, b1)) + h1, back @ j2 @ a1 + j1


def _total(elems):
    """The element of all rows together, composed in pairs: one vector step for each doubling."""
    while len(elems[0]) > 1:
        n = len(elems[0]) // 2 * 2
        pairs = _compose(tuple(x[0:n:2] for x in elems), tuple(x[1:n:2] for x in elems))
        elems = tuple(np.concatenate([x, y[n:]]) for x, y in zip(pairs, elems))
    return tuple(x[0] for x in elems)


def _flat(elem):
    a, b, c, h, j = elem
    return [*a.ravel(), *b, c[0, 0], c[0, 1], c[1, 1], *h, j[0, 0], j[0, 1], j[1, 1]]


def _unflat(v):
    return (
        np.array(v[0:4]).reshape(2, 2), np.array(v[4:6]),
        np.array([[v[6], v[7]], [v[7], v[8]]]), np.array(v[9:11]), np.array([[v[11], v[12]], [v[12], v[13]]]),
    )


def _apply(elem, state):
    a, b, c, h, j = elem
    m, p = np.array(state[:2]), np.array([[state[2], state[3]], [state[3], state[4]]])
    d = np.linalg.inv(_I2 + p @ j)
    m2, p2 = a @ d @ (m + p @ h) + b, a @ d @ p @ a.T + c
    return m2[0], m2[1], p2[0, 0], (p2[0, 1] + p2[1, 0]) / 2, p2[1, 1]


def filtered(df: DataFrame, keys=KEYS, col: str = "close", q: str = "q", r: str = "r", warmup: int = WARMUP, block: int | None = None) -> DataFrame:
    """Add ``kalman_price``, ``kalman_velocity``, ``kalman_residual``; noises are columns ``q`` and ``r``."""
    keys, b = list(keys), block or BLOCK
    df = with_blocks(df, b)
    part = [*keys, "blk", "more"]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in [*keys, "blk"])
    names = [f.name for f in df.schema if f.name in [*keys, "blk"]]

    def reduce_block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        z, qs, rs = (pdf[c].to_numpy(float) for c in (col, q, r))
        n, first = int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0]) == 1
        row = {c: pdf[c].iloc[0] for c in names}
        if first:
            _, state = _run(z, qs, rs, True, None)
            row |= dict(zip(_ELEM, [0.0] * 14)) | dict(zip(_STATE, state))
        else:
            elem = _total(_elements(z, qs, rs))
            row |= dict(zip(_ELEM, _flat(elem))) | dict(zip(_STATE, [0.0] * 5))
        return pd.DataFrame([row | {"n": n}])

    sum_schema = f"{key_schema}, n bigint, " + ", ".join(f"{c} double" for c in _ELEM + _STATE)
    df = df.withColumn("i", F.col("i").cast("bigint"))
    slim = df.select(*names, "more", F.col("n").cast("bigint").alias("n"), "i", col, q, r)
    sums = slim.where("more").groupBy(*part).applyInPandas(
        lambda key, pdf: reduce_block(key, pdf)[[*names, "n", *_ELEM, *_STATE]], sum_schema
    )

    def relay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        states = []
        for v in pdf[_ELEM + _STATE].to_numpy(float):
            state = tuple(v[14:]) if not states else _apply(_unflat(v[:14]), states[-1])
            states.append(state)
        out = pdf[[*names, "n"]].copy()
        out["blk"] += 1
        out[_STATE] = states
        return out

    start_schema = f"{key_schema}, n bigint, " + ", ".join(f"{c} double" for c in _STATE)
    starts = sums.groupBy(*keys).applyInPandas(relay, start_schema)
    starts = starts.withColumn("more", F.col("blk") < _div("n - 1", b)).drop("n")

    out_schema = f"{key_schema}, i bigint, kalman_price double, kalman_velocity double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        z, qs, rs = (pdf[c].to_numpy(float) for c in (col, q, r))
        state = tuple(pdf[_STATE].iloc[0])
        est, _ = _run(z, qs, rs, int(pdf["i"].iloc[0]) == 1, state)
        out = pdf[[*names, "i"]].copy()
        warm = pdf["i"].to_numpy() <= warmup
        out["kalman_price"] = np.where(warm, z, est[:, 0])
        out["kalman_velocity"] = np.where(warm, 0.0, est[:, 1])
        return out

    ready = slim.join(starts, part, "left")
    est = ready.groupBy(*part).applyInPandas(run, out_schema)
    return df.join(est, [*keys, "blk", "i"]).withColumn("kalman_residual", F.col(col) - F.col("kalman_price"))


def denoise(series: DataFrame, preset: str = "adaptive", keys=KEYS, q: float | str | None = None, r: float | str | None = None, backfill: bool = False, block: int | None = None) -> DataFrame:
    """Filter every series with a preset; ``q``/``r`` replace its noises by numbers or by columns of the frame."""
    pq, pr, adaptive = PRESETS[preset]
    base_q, base_r = (F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (q or pq, r or pr))
    if adaptive:
        d = noise_scale(series, keys=keys, backfill=backfill, block=block)
        d = d.withColumn("_scale", scale_of(F.col("atr"), base_r))
    else:
        d = with_blocks(series, block).withColumn("_scale", F.lit(1.0))
    d = d.withColumns({"_q": base_q * F.col("_scale"), "_r": base_r * F.col("_scale")})
    return filtered(d, keys, q="_q", r="_r", block=block).drop("_scale", "_q", "_r")
