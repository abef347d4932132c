"""Filter, regime, signal and trailing stop as one keyed stream operator.

Per symbol the state is five filter numbers, the noise scale's average range, three short rings (filtered prices, returns,
volatilities), the regime run and the position: a few hundred numbers, whatever the length of the stream. Each step equals the
batch operators on the same bars.

Bars may arrive in any order within the delay. They wait in a map state, one entry for each span of time, until the watermark has
passed them; a timer for each span then works through it in order, so a backlog is never in memory as a whole. A bar that is no later than
the last one worked through changes nothing; of bars with one time the first in order of (high, low, close) counts; bars without a price are
passed over. A row without a symbol only moves the watermark.

A run goes on elsewhere from ``saved_state`` (the state a checkpoint holds) over the same source: bars that the state has seen are refused,
all others are worked through, also those that were still waiting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebars.operators.denoise import P0, WARMUP, _step
from tidebars.operators.regime import EXTREME, HIGH, LOW, NORMAL
from tidebars.operators.signals import START

OUTPUT = "symbol string, at bigint, i bigint, close double, kalman_price double, kalman_velocity double, regime string, sig double"
STATE = (
    "at bigint, i bigint, filter array<double>, atr double, tr_sum double, last_close double, smooth array<double>, returns array<double>, vols array<double>, "
    "raw string, run int, regime string, held double, peak double"
)
WAITING = "at array<bigint>, high array<double>, low array<double>, close array<double>"
LISTS = ("filter", "smooth", "returns", "vols")
LONG_AGO = -(2**62)
SPAN = 7 * 24 * 3600 * 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Settings:
    q: float = 0.5
    r: float = 5.0
    fast: int = 15
    slow: int = 80
    stop: float = 0.15
    atr_period: int = 14
    lookback: int = 30
    baseline: int = 252
    persist: int = 3
    start: int = START


def fresh() -> dict:
    return dict(at=LONG_AGO, i=0, filter=[0.0] * 5, atr=0.0, tr_sum=0.0, last_close=None, smooth=[], returns=[], vols=[], raw="", run=0, regime=NORMAL, held=0.0, peak=0.0)


def _deviation(xs) -> float:
    n, m = len(xs), sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / (n - 1)) if n > 1 else 0.0


def _raw_regime(vols) -> str:
    if not vols:
        return NORMAL
    v, m, s = vols[-1], sum(vols) / len(vols), _deviation(vols)
    if v <= 0 or m <= 0:
        return NORMAL
    return EXTREME if v > m + s else HIGH if v > m else NORMAL if v > m - s else LOW


def advance(st: dict, high: float, low: float, close: float, cfg: Settings) -> tuple:
    """One bar: changes ``st`` and returns (price, velocity, regime, position)."""
    st["i"] += 1
    i, last = st["i"], st["last_close"]
    # decisions use what was known before this bar
    if i > cfg.start:
        raw = _raw_regime(st["vols"])
        st["run"] = st["run"] + 1 if raw == st["raw"] else 1
        st["raw"] = raw
        if st["run"] >= max(cfg.persist, 2):
            st["regime"] = raw
    smooth = st["smooth"]
    sig = 0.0
    if i > cfg.start and len(smooth) >= cfg.slow and sum(smooth[-cfg.fast:]) / cfg.fast > sum(smooth[-cfg.slow:]) / cfg.slow:
        sig = 1.0
    if st["held"] > 0:
        st["peak"] = max(st["peak"], close)
        if (st["peak"] - close) / st["peak"] > cfg.stop:
            sig = 0.0
    if sig > 0 and st["held"] <= 0:
        st["peak"] = close
    st["held"] = sig
    # then the bar enters the running quantities
    tr = high - low if last is None else max(high - low, abs(high - last), abs(low - last))
    p = cfg.atr_period
    if i <= p:
        st["tr_sum"] += tr
        st["atr"] = st["tr_sum"] / p if i == p else 0.0
    else:
        st["atr"] = (st["atr"] * (p - 1) + tr) / p
    scale = min(10.0, max(0.1, st["atr"] / max(cfg.r, 1e-8))) if st["atr"] > 0 else 1.0
    st["filter"] = list(_step(*st["filter"], close, cfg.q * scale, cfg.r * scale)) if i > 1 else [close, 0.0, P0, 0.0, P0]
    price, velocity = (close, 0.0) if i <= WARMUP else st["filter"][:2]
    st["smooth"] = (smooth + [price])[-cfg.slow:]
    if last is not None:
        st["returns"] = (st["returns"] + [math.log(close / last)])[-cfg.lookback:]
        if len(st["returns"]) == cfg.lookback:
            st["vols"] = (st["vols"] + [_deviation(st["returns"])])[-cfg.baseline:]
    st["last_close"] = close
    return price, velocity, st["regime"], sig


class LiveProcessor(StatefulProcessor):
    def __init__(self, cfg: Settings, span: int) -> None:
        self.cfg, self.span = cfg, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("live", STATE)
        self.waiting = handle.getMapState("waiting", "span bigint", WAITING)
        self.names = [f.strip().split(" ")[0] for f in STATE.split(",")]

    def _load(self) -> dict:
        if not self.state.exists():
            return fresh()
        got = dict(zip(self.names, self.state.get()))
        return {k: list(v) if k in LISTS else v for k, v in got.items()}

    def _save(self, st: dict) -> None:
        self.state.update(tuple(st[k] for k in self.names))

    def _wait(self, span: int, bars: list[tuple]) -> None:
        """Keep bars of one span of time, and ask to be called when the watermark passes the first of them."""
        self.waiting.updateValue((span,), tuple(list(x) for x in zip(*bars)))
        self.handle.registerTimer(-(-min(b[0] for b in bars) // 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A run that goes on: the columns of ``saved_state`` that are there, and a position held now (``qty``), whose peak starts at ``last_price``.

        Without ``smooth`` the signal is flat until the stream has brought enough bars, which closes the position.
        """
        st, row = fresh(), initialState.iloc[0]
        for c in self.names:
            if c in initialState.columns and not (c not in LISTS and pd.isna(row[c])):
                st[c] = [float(x) for x in row[c]] if c in LISTS else type(st[c])(row[c]) if st[c] is not None else float(row[c])
        if "qty" in initialState.columns and not pd.isna(row["qty"]):
            px = float(row["last_price"])
            st["held"], st["peak"] = (1.0, px) if float(row["qty"]) > 0 else (0.0, 0.0)
            if "filter" not in initialState.columns and "smooth" in initialState.columns:
                st |= dict(last_close=px, filter=[px, 0.0, P0, 0.0, P0])
        self._save(st)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self._load()["at"] if key[0] is not None else None
        for pdf in rows:
            if seen is None:
                continue
            pdf = pdf.dropna(subset=["at", "high", "low", "close"])
            pdf = pdf[pdf["at"] > seen]
            for span, part in pdf.groupby(pdf["at"] // self.span):
                bars = [(int(a), float(h), float(lo), float(c)) for a, h, lo, c in part[["at", "high", "low", "close"]].itertuples(index=False)]
                old = self.waiting.getValue((int(span),)) if self.waiting.containsKey((int(span),)) else None
                self._wait(int(span), [*zip(*old), *bars] if old else bars)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        span, passed = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.span, timerValues.getCurrentWatermarkInMs() * 1000
        # a bar's timer is rounded up to the millisecond and may fall on the next span's beginning
        for at in (span - 1, span):
            if self.waiting.containsKey((at,)):
                out = self._release(key, at, passed)
                if out:
                    yield pd.DataFrame(out, columns=[f.strip().split(" ")[0] for f in OUTPUT.split(",")])

    def _release(self, key, span: int, passed: int) -> list[tuple]:
        bars = sorted(zip(*self.waiting.getValue((span,))))
        ready = [b for b in bars if b[0] <= passed]
        if not ready:
            return []
        self.waiting.removeKey((span,))
        if len(ready) < len(bars):
            self._wait(span, bars[len(ready):])
        st, out = self._load(), []
        for at, h, lo, c in ready:
            if at > st["at"]:
                st["at"] = at
                out.append((key[0], at, st["i"] + 1, c, *advance(st, h, lo, c, self.cfg)))
        self._save(st)
        return out

    def close(self) -> None:
        pass


def live_signals(bars: DataFrame, cfg: Settings = Settings(), held: DataFrame | None = None, delay: str = "1 hour", span: int = SPAN) -> DataFrame:
    """Signals of a bar stream (symbol, ts, high, low, close), each when the watermark, ``delay`` behind the latest bar, has passed it.

    ``held`` goes on from another run: symbol, the columns of ``saved_state`` or some of them (i, smooth, atr), and qty with last_price
    where positions are known from elsewhere. ``span``: microseconds of bars that wait together.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = bars.withWatermark("ts", delay).select("symbol", "ts", F.unix_micros("ts").alias("at"), "high", "low", "close")
    d = d.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=LiveProcessor(cfg, span), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
        initialState=held.groupBy("symbol") if held is not None else None,
    )
    return d.select("symbol", F.timestamp_micros("at").alias("ts"), *[f.strip().split(" ")[0] for f in OUTPUT.split(",")[2:]])


def saved_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row for each symbol: the state after the last batch of a run of ``live_signals``."""
    d = spark.read.format("statestore").option("stateVarName", "live").load(checkpoint)
    return d.select(F.col("key.symbol").alias("symbol"), "value.*")
