"""Made bars for the tests."""

import numpy as np
import pandas as pd


def walk(n, seed=0, vol=0.02, start="2015-01-01", symbol="X", freq="D"):
    """A bar frame of one symbol; numbers come from a fixed seed."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, vol, n)))
    op = np.r_[100.0, close[:-1]]
    hi, lo = np.maximum(op, close) * (1 + rng.uniform(0, 0.01, n)), np.minimum(op, close) * (1 - rng.uniform(0, 0.01, n))
    return pd.DataFrame({
        "symbol": symbol, "timeframe": "1d", "ts": pd.date_range(start, periods=n, freq=freq), "open": op, "high": hi, "low": lo, "close": close,
        "volume": rng.integers(100, 1000, n).astype(float), "i": np.arange(1, n + 1), "n": n,
    })
