"""A market regime for each bar of a stream, from exponentially weighted moments and bounded buffers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "market string, t long, ret double, fast_mean double, slow_vol double, vol_class string, trend_class string, regime string, changes long"
_STATE = "mean double, fast double, slow double, n long, changes long, last string, rets array<double>, vols array<double>"


@dataclass
class Detector:
    """Fast mean and slow deviation, and classes by the quantile of the deviation and a variance ratio over a buffer.

    Deterministic: there is no random smoothing. Bars come in order; a missing return changes nothing.
    """

    alpha_fast: float = 0.1
    alpha_slow: float = 0.02
    buffer: int = 200
    mean: float = 0.0
    fast: float = 0.0
    slow: float = 0.0
    n: int = 0
    changes: int = 0
    last: str = "SIDEWAYS"
    rets: deque = field(default_factory=deque)
    vols: deque = field(default_factory=deque)

    def update(self, r: float | None) -> tuple[float, float, str, str, str, int]:
        if r is not None and np.isfinite(r):
            self.mean = r if not self.n else (1 - self.alpha_fast) * self.mean + self.alpha_fast * r
            d = (r - self.mean) ** 2
            self.fast = d if not self.n else (1 - self.alpha_fast) * self.fast + self.alpha_fast * d
            self.slow = d if not self.n else (1 - self.alpha_slow) * self.slow + self.alpha_slow * d
            self.n += 1
            for q, v in ((self.rets, r), (self.vols, self.slow**0.5)):
                q.append(v)
                if len(q) > self.buffer:
                    q.popleft()
        vol, trend, regime = self._classes()
        self.changes += regime != self.last
        self.last = regime
        return self.mean, self.slow**0.5, vol, trend, regime, self.changes

    def _classes(self) -> tuple[str, str, str]:
        if self.n < 20:
            return "normal", "random", "SIDEWAYS"
        v = np.array(self.vols)
        place = float((v <= v[-1]).mean())
        vol = "high" if place > 0.8 else "low" if place < 0.2 else "normal"
        x = np.array(self.rets)
        one = x.var()
        five = np.convolve(x, np.ones(5), "valid").var() / 5 if len(x) >= 10 else one
        ratio = five / one if one > 1e-18 else 1.0
        trend = "trending" if ratio > 1.2 else "reverting" if ratio < 0.8 else "random"
        edge = 0.1 * self.slow**0.5
        regime = "BULL" if self.mean > edge and vol != "high" else "BEAR" if self.mean < -edge else "SIDEWAYS"
        return vol, trend, regime

    def state(self) -> tuple:
        return self.mean, self.fast, self.slow, self.n, self.changes, self.last, list(self.rets), list(self.vols)

    @classmethod
    def of(cls, s: tuple | None) -> Detector:
        return cls() if s is None else cls(mean=s[0], fast=s[1], slow=s[2], n=s[3], changes=s[4], last=s[5], rets=deque(s[6]), vols=deque(s[7]))


def _rows(market: str, d: Detector, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for t, r in pdf.sort_values("t")[["t", "ret"]].itertuples(index=False):
        got = d.update(None if pd.isna(r) else float(r))
        out.append((market, int(t), r, *got))
    return pd.DataFrame(out, columns=["market", "t", "ret", "fast_mean", "slow_vol", "vol_class", "trend_class", "regime", "changes"])


def batch(bars: DataFrame) -> DataFrame:
    """Regimes of a table (market, t, ret): the same rows as the stream gives for bars in order."""
    return bars.groupBy("market").applyInPandas(lambda key, pdf: _rows(key[0], Detector(), pdf), SCHEMA)


def stream(bars: DataFrame) -> DataFrame:
    """Regimes of a stream (market, t, ret); a market's state is a few numbers and two bounded buffers."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Detector.of(state.get if state.exists else None)
        for pdf in pdfs:
            yield _rows(key[0], d, pdf)
        state.update(d.state())

    return bars.groupBy("market").applyInPandasWithState(step, SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
