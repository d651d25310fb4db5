"""Every formula operator against NumPy on a small panel with ties, gaps, constant stretches and short histories."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.catalog.formulas import W, formula_of
from tessera.functions.specs import SPECS
from tessera.plans.compiler import evaluate

M, T = 8, 40
EPS = 1e-10


def _panel():
    rng = np.random.default_rng(5)
    out = {k: np.round(rng.normal(50, 20, (M, T)), 1) for k in ("open", "high", "low", "close", "volume")}
    hole = rng.random((M, T)) < 0.15
    for v in out.values():
        v[hole] = np.nan
        v[2, 10:25] = np.nan
        v[4, 12:22] = 7.0
    out["close"][5, 5] = out["open"][5, 5] = 3.0
    return out


PANEL = _panel()


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(f"a{i}", t, *[None if np.isnan(PANEL[k][i, t]) else float(PANEL[k][i, t]) for k in PANEL]) for i in range(M) for t in range(T)]
    return spark.createDataFrame(rows, "asset_id string, t_idx int, " + ", ".join(f"{k} double" for k in PANEL)).cache()


X = (PANEL["close"] - PANEL["open"]) * 0.001
Y = (PANEL["high"] - PANEL["low"]) * 0.001


def _roll(f, x=X, y=None):
    out = np.full((M, T), np.nan)
    for i in range(M):
        for t in range(W - 1, T):
            a = x[i, t - W + 1 : t + 1]
            out[i, t] = f(a) if y is None else f(a, y[i, t - W + 1 : t + 1])
    return out


def _known(f, empty=np.nan, least=1):
    return lambda a: f(a[~np.isnan(a)]) if (~np.isnan(a)).sum() >= least else empty


def _pair(a, b):
    return np.nanmean((a - np.nanmean(a)) * (b - np.nanmean(b))) if (~np.isnan(a + b)).any() else np.nan


def _sd(a):
    return np.std(a[~np.isnan(a)], ddof=1) if (~np.isnan(a)).sum() > 1 else np.nan


def _corr(a, b):
    d = _sd(a) * _sd(b)
    return _pair(a, b) / d if d > EPS else 0.0


def _beta(a, b):
    if np.isnan(b).all():
        return 0.0
    v = np.nansum((b - np.nanmean(b)) ** 2)
    c = np.nansum((a - np.nanmean(a)) * (b - np.nanmean(b))) if not np.isnan(a).all() else 0.0
    return c / v if v > EPS else 0.0


def _skew(a, p):
    a = a[~np.isnan(a)]
    s = a.std(ddof=1) if len(a) > 1 else 0
    z = (a - a.mean()) / (s if s > EPS else 1.0)
    return (z**3).mean() * W**2 / ((W - 1) * (W - 2)) if p == 3 else (z**4).mean() - 3


def _lin(a, what):
    if np.isnan(a).all():
        return np.nan
    u = np.arange(W) - (W - 1) / 2
    m = np.nanmean(a)
    s = np.nansum((a - m) * u) / (u @ u)
    if what == "slope":
        return s
    if what == "intercept":
        return m - s * (W - 1) / 2
    fit = m + s * (W - 1) / 2
    if what == "fit":
        return fit
    if what == "resid":
        return a[-1] - fit
    tot = np.nansum((a - m) ** 2)
    return 1 - np.nansum((a - m - s * u) ** 2) / tot if tot > EPS else np.nan


EXPECTED = {
    "Mean": _roll(_known(np.mean)), "Std": _roll(_known(lambda a: a.std(ddof=1), least=2)), "Var": _roll(_known(lambda a: a.var(ddof=1), least=2)), "Median": _roll(_known(np.median)),
    "Sum": _roll(_known(np.sum, 0.0)), "Prod": _roll(_known(np.prod, 1.0)), "TsMax": _roll(_known(np.max)), "TsMin": _roll(_known(np.min)), "Quantile": _roll(_known(lambda a: np.quantile(a, 0.3))),
    "TsArgMax": _roll(lambda a: np.nan if np.isnan(a).all() else float(np.nanargmax(a))), "TsArgMin": _roll(lambda a: np.nan if np.isnan(a).all() else float(np.nanargmin(a))),
    "TsRank": _roll(lambda a: (a <= a[-1]).sum() / W), "CountNaN": _roll(lambda a: float(np.isnan(a).sum())), "CountNotNaN": _roll(lambda a: float((~np.isnan(a)).sum())),
    "Skew": _roll(_known(lambda a: _skew(a, 3))), "Kurt": _roll(_known(lambda a: _skew(a, 4))), "Cov": _roll(_pair, X, Y), "Corr": _roll(_corr, X, Y), "Beta": _roll(_beta, X, Y),
    "Resid": _roll(lambda a, b: a[-1] - (np.nanmean(a) + _beta(a, b) * (b[-1] - np.nanmean(b))) if not np.isnan(a).all() and not np.isnan(b).all() else np.nan, X, Y),
    "WMA": _roll(lambda a: (a * np.arange(1, W + 1)).sum() / (W * (W + 1) / 2)), "Decay": _roll(lambda a: (a * [2 / (W + 1) * (1 - 2 / (W + 1)) ** (W - 1 - i) for i in range(W)]).sum()),
    **{n: _roll(lambda a, k=k: _lin(a, k)) for n, k in (("TsLinReg", "fit"), ("TsLinRegSlope", "slope"), ("TsLinRegIntercept", "intercept"), ("TsLinRegResid", "resid"), ("Rsquare", "r2"))},
    "CumSum": np.nancumsum(X, axis=1), "Div": np.where(np.abs(Y) > EPS, X / np.where(np.abs(Y) > EPS, Y, 1), 0.0), "Log": np.sign(X) * np.log1p(np.abs(X)), "Tanh": np.tanh(X),
    "Greater": np.where(X > Y, 1.0, 0.0), "Or": np.where((X > 0) | (Y > 0), 1.0, 0.0), "Not": np.where(X <= 0, 1.0, 0.0), "Max": np.maximum(X, Y), "IfElse": np.where(X > 0, Y, PANEL["volume"]),
    "CsDemean": X - np.nanmean(X, axis=0), "CsScale": X / np.where(np.nansum(np.abs(X), 0) > EPS, np.nansum(np.abs(X), 0), 1.0),
}


@pytest.fixture(scope="module")
def got(frame):
    names = sorted(EXPECTED)
    rows = evaluate(frame, {n: formula_of(n) for n in names}).collect()
    out = {n: np.full((M, T), np.nan) for n in names}
    for r in rows:
        for n in names:
            out[n][int(r.asset_id[1:]), r.t_idx] = np.nan if r[n] is None else r[n]
    return out


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_operator(name, got):
    np.testing.assert_allclose(got[name], EXPECTED[name], rtol=1e-7, atol=1e-9, equal_nan=True)


def test_recurrences(frame):
    from tessera.functions.recurrence import ema

    rows = evaluate(frame, {"e": "EMA($close, 5)", "d": "DEMA($close, 5)"}).collect()
    kernel = evaluate(frame, {"k": "KAMA($close, 5)"}, mode="kernel").collect()
    e = ema(PANEL["close"], 5)
    for r in rows:
        want = e[int(r.asset_id[1:]), r.t_idx]
        assert (r.e is None) == math.isnan(want) and (r.e is None or abs(r.e - want) < 1e-9)
    w, by_asset = 5, {}
    for r in kernel:
        by_asset.setdefault(int(r.asset_id[1:]), {})[r.t_idx] = r.k
    for a, got in by_asset.items():  # the definition, one value at a time
        x = [float(v) for v in PANEL["close"][a]]
        last = math.nan
        for t, now in enumerate(x):
            want = now
            if t >= w and not math.isnan(now) and not math.isnan(last):
                walked = sum(abs(x[i] - x[i - 1]) for i in range(t - w + 1, t + 1) if not math.isnan(x[i] - x[i - 1]))
                ratio = abs(now - x[t - w]) / walked if walked > 1e-10 else 0.0
                want = last + (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (now - last)
            assert (got[t] is None) == math.isnan(want) and (got[t] is None or got[t] == pytest.approx(want, rel=1e-9, abs=1e-9)), (a, t)
            last = want


def test_every_operator_plans(frame):
    for mode in ("tree", "kernel"):
        assert evaluate(frame, {n: formula_of(n) for n in SPECS}, mode).columns[-len(SPECS) :] == list(SPECS)


def test_rank_is_a_permutation(frame):
    rows = evaluate(frame, {"r": "CsRank($close)"}).where("r IS NOT NULL").groupBy("t_idx").agg({"r": "max", "*": "count"}).collect()
    assert all(abs(r["max(r)"] - 1) < 1e-12 for r in rows)
