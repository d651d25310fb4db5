"""Columns for the formula operators. Missing values are nulls; NaN never enters a plan.

Two semantics: mode "tree" is that of formula evaluation, mode "kernel" that of the array
kernels. Rolling windows are full-width frames on a dense grid: with fewer bars behind it
than the window asks for, a cell is missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-10
_INF = float("inf")


def clean(c: Column) -> Column:
    """NaN becomes null."""
    return F.nanvl(c, F.lit(None).cast("double"))


def flag(c: Column, kernel: bool, *operands: Column) -> Column:
    """A truth value as 1.0 or 0.0. Tree: unknown is 0.0. Kernel: missing operands give missing."""
    v = F.coalesce(c, F.lit(False)).cast("double")
    if not kernel:
        return v
    known = operands[0].isNotNull()
    for o in operands[1:]:
        known = known & o.isNotNull()
    return F.when(known, v)


@dataclass(frozen=True)
class Frame:
    """Key columns of a dense panel, and the windows over it."""

    asset: str = "asset_id"
    t: str = "t_idx"

    def rolling(self, w: int):
        return Window.partitionBy(self.asset).orderBy(self.t).rowsBetween(-(w - 1), 0)

    @property
    def ordered(self):
        return Window.partitionBy(self.asset).orderBy(self.t)

    @property
    def running(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        return Window.partitionBy(self.asset)

    @property
    def cross(self):
        return Window.partitionBy(self.t)

    def full(self, w: int, c: Column) -> Column:
        return F.when(F.col(self.t) >= w - 1, c)


def elementwise(op: str, a: list[Column], p: dict[str, float], kernel: bool) -> Column:
    x = a[0]
    y = a[1] if len(a) > 1 else None
    if op == "Add":
        return clean(x + y)
    if op == "Sub":
        return clean(x - y)
    if op == "Mul":
        return clean(x * y)
    if op in ("Div", "Inv"):
        num, den = (x, y) if op == "Div" else (F.lit(1.0), x)
        safe = F.when(F.abs(den) > EPS, clean(F.try_divide(num, den)))
        return safe if kernel else F.when(F.abs(den) > EPS, clean(F.try_divide(num, den))).otherwise(0.0)
    if op == "Neg":
        return -x
    if op == "Abs":
        return F.abs(x)
    if op == "Sign":
        return F.signum(x)
    if op == "Log":
        return F.signum(x) * F.log1p(F.abs(x))
    if op == "Sqrt":
        return F.signum(x) * F.sqrt(F.abs(x))
    if op == "Square":
        return x * x
    if op == "Pow":
        return clean(F.signum(x) * F.pow(F.abs(x), y))
    if op == "SignedPower":
        return clean(F.signum(x) * F.pow(F.abs(x), F.lit(p["exponent"])))
    if op == "Power":
        return clean(F.pow(x, F.lit(p["exponent"])))
    if op == "Exp":
        return F.when(x.isNotNull(), F.exp(F.greatest(F.lit(-50.0), F.least(x, F.lit(50.0)))))
    if op == "Tanh":
        return F.tanh(x)
    if op in ("Max", "Min"):
        best = (F.greatest if op == "Max" else F.least)(x, y)
        return best if kernel else F.when(x.isNotNull() & y.isNotNull(), best)
    if op == "Clip":
        return F.when(x.isNotNull(), F.greatest(F.lit(p["lower"]), F.least(x, F.lit(p["upper"]))))
    if op == "IfElse":
        out = F.when(x > 0, y).otherwise(a[2])
        return F.when(x.isNotNull(), out) if kernel else out
    if op == "_Nz":
        return F.coalesce(x, F.lit(0.0))
    if op == "Greater":
        return flag(x > y, kernel, x, y)
    if op == "GreaterEqual":
        return flag(x >= y, kernel, x, y)
    if op == "Less":
        return flag(x < y, kernel, x, y)
    if op == "LessEqual":
        return flag(x <= y, kernel, x, y)
    if op == "Equal":
        return flag(F.abs(x - y) < EPS, kernel, x, y)
    if op == "Ne":
        return flag(F.abs(x - y) >= EPS, kernel, x, y)
    if op == "And":
        return flag((x > 0) & (y > 0), kernel, x, y)
    if op == "Or":
        return flag(F.coalesce(x > 0, F.lit(False)) | F.coalesce(y > 0, F.lit(False)), kernel, x, y)
    if op == "Not":
        return flag(x <= 0, kernel, x)
    raise KeyError(op)


def _values(x: Column, over) -> Column:
    """The frame as an array that keeps nulls."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))).over(over), lambda s: s["v"])


def _moments(x: Column, y: Column, f: Frame, w: int) -> dict[str, Column]:
    """Means, deviations and the sum of products about each series' own mean, over pairs that both series have.

    Both are centred on a constant of the asset first, which no central moment depends on.
    """
    over = f.rolling(w)
    cx, cy = x - F.avg(x).over(f.whole), y - F.avg(y).over(f.whole)
    mx, my = F.avg(cx).over(over), F.avg(cy).over(over)
    n = F.count(cx * cy).over(over)
    sums = F.sum(cx * cy).over(over) - my * F.sum(F.when(cy.isNotNull(), cx)).over(over) - mx * F.sum(F.when(cx.isNotNull(), cy)).over(over) + n * mx * my
    return {"mx": F.avg(x).over(over), "my": F.avg(y).over(over), "n": n, "sums": F.when(n > 0, sums), "over": over}


def rolling(op: str, a: list[Column], p: dict[str, float], f: Frame, kernel: bool) -> Column:
    x = a[0]
    w = int(p.get("window", 1))
    over = f.rolling(w)
    full = lambda c: f.full(w, c)
    if op in ("Mean", "SMA"):
        return full(F.coalesce(F.sum(x).over(over), F.lit(0.0)) / w if kernel and op == "SMA" else F.avg(x).over(over))
    if op == "Std":
        return full(F.stddev_samp(x).over(over))
    if op == "Var":
        return full(F.var_samp(x).over(over))
    if op in ("Skew", "Kurt"):
        c = x - F.avg(x).over(f.whole)
        n, m = F.count(c).over(over), F.avg(c).over(over)
        s1, s2, s3 = (F.sum(F.pow(c, F.lit(float(k)))).over(over) for k in (1, 2, 3))
        cube = s3 - 3 * m * s2 + 3 * m * m * s1 - n * m * m * m
        s4 = F.sum(F.pow(c, F.lit(4.0))).over(over)
        fourth = s4 - 4 * m * s3 + 6 * m * m * s2 - 4 * m * m * m * s1 + n * m * m * m * m
        if kernel:
            spread = F.var_pop(x).over(over)
            if op == "Skew":
                return full(F.when((n >= 3) & (spread > 0), cube / n / F.pow(spread, F.lit(1.5))))
            return full(F.when((n >= 4) & (spread > 0), fourth / n / (spread * spread) - 3))
        s = F.stddev_samp(x).over(over)
        usual = s > EPS
        s = F.when(usual, s).otherwise(1.0)
        if op == "Skew":
            return full(F.when(n > 0, F.when(usual, cube / n / (s * s * s)).otherwise(0.0) * (w * w / max((w - 1) * (w - 2), 1))))
        return full(F.when(n > 0, F.when(usual, fourth / n / (s * s * s * s)).otherwise(0.0) - 3))
    if op == "Median":
        return full(F.percentile(x, 0.5).over(over))
    if op == "Quantile":
        return full(F.percentile(x, p["q"]).over(over))
    if op == "Sum":
        s = F.sum(x).over(over)
        return full(s if kernel else F.coalesce(s, F.lit(0.0)))
    if op == "Prod":
        s = F.product(x).over(over)
        return full(s if kernel else F.coalesce(s, F.lit(1.0)))
    if op == "TsMax":
        return full(F.max(x).over(over))
    if op == "TsMin":
        return full(F.min(x).over(over))
    if op in ("TsArgMax", "TsArgMin"):
        v = _values(x, over)
        best = (F.array_max if op == "TsArgMax" else F.array_min)(v)
        return full(F.when(best.isNotNull(), (F.array_position(v, best) - 1).cast("double")))
    if op == "TsRank":
        v = _values(x, over)
        if kernel:
            n = F.count(x).over(over)
            return full(F.when(n > 1, F.size(F.filter(v, lambda e: e < x)) / (n - 1)))
        return full(F.size(F.filter(v, lambda e: e <= x)) / w)
    if op == "CountNaN":
        return full(F.sum(x.isNull().cast("double")).over(over))
    if op == "CountNotNaN":
        return full(F.count(x).over(over).cast("double"))
    if op in ("Delta", "Delay", "Return", "LogReturn"):
        before = F.lag(x, w).over(f.ordered)
        late = F.col(f.t) >= w
        if op == "Delay":
            return before
        if op == "Delta":
            return clean(x - before)
        if op == "Return":
            usual = F.abs(before) > EPS
            got = clean(F.try_divide(x - before, before))
            return F.when(late & usual, got) if kernel else F.when(late, F.when(usual, got).otherwise(0.0))
        if kernel:
            ratio = F.when(F.abs(before) > EPS, F.try_divide(x, before))
            return F.when(late & (ratio > 0), F.log(ratio))
        return F.when(late, F.log(F.abs(F.try_divide(x, F.when(F.abs(before) > EPS, before).otherwise(1.0))) + EPS))
    if op in ("Corr", "Cov", "Beta", "Resid"):
        y = a[1]
        m = _moments(x, y, f, w)
        if op == "Cov":
            return full(m["sums"] / m["n"])
        if op == "Corr":
            if kernel:
                sx, sy = F.stddev_pop(x).over(over), F.stddev_pop(y).over(over)
                return full(F.when((sx > EPS) & (sy > EPS), m["sums"] / m["n"] / (sx * sy)))
            d = F.stddev_samp(x).over(over) * F.stddev_samp(y).over(over)
            return full(F.when(d > EPS, m["sums"] / m["n"] / d).otherwise(0.0))
        if kernel:  # means of squares and of products, not sums
            var = F.var_pop(y).over(over)
            beta = F.when(var > EPS, m["sums"] / m["n"] / var)
            beta = beta if op == "Beta" else F.when(var > EPS, m["sums"] / m["n"] / var).otherwise(0.0)
        else:
            var = F.var_pop(y).over(over) * F.count(y).over(over)
            beta = F.when(var > EPS, F.coalesce(m["sums"], F.lit(0.0)) / var).otherwise(0.0)
        return full(beta if op == "Beta" else x - (m["mx"] + beta * (y - m["my"])))
    if op == "WMA" or op == "Decay" and kernel:
        # weights 1..w by position: sums of t*x and x give them
        t = F.col(f.t)
        got = (F.sum(t * x).over(over) - (t - w) * F.sum(x).over(over)) / (w * (w + 1) / 2)
        return full(F.coalesce(got, F.lit(0.0)) if kernel else F.when(F.count(x).over(over) == w, got))
    if op == "Decay":
        alpha = 2.0 / (w + 1)
        weights = F.array(*[F.lit(alpha * (1 - alpha) ** (w - 1 - i)) for i in range(w)])
        total = F.aggregate(F.zip_with(_values(x, over), weights, lambda e, k: e * k), F.lit(0.0), lambda s, e: s + e)
        return full(total)
    if op in ("TsLinReg", "TsLinRegSlope", "TsLinRegIntercept", "TsLinRegResid", "Rsquare"):
        middle = F.col(f.t) - (w - 1) / 2.0
        spread = max(w * (w * w - 1) / 12.0, EPS)
        seen = F.when(x.isNotNull(), F.col(f.t).cast("double"))
        mean = F.avg(x).over(over)
        sx, n = F.sum(x).over(over), F.count(x).over(over)
        c = x - F.avg(x).over(f.whole)
        cmean = F.avg(c).over(over)
        cov = F.sum(F.col(f.t) * c).over(over) - middle * F.sum(c).over(over) - cmean * (F.sum(seen).over(over) - middle * n)
        slope = cov / spread
        if op == "TsLinRegSlope":
            return full(slope)
        if op == "TsLinRegIntercept":
            return full(mean - slope * ((w - 1) / 2.0))
        fitted = mean + slope * ((w - 1) / 2.0)
        if op == "TsLinReg":
            return full(fitted)
        if op == "TsLinRegResid":
            return full(x - fitted)
        del sx
        total = F.var_pop(x).over(over) * n
        ts2 = F.sum(seen * seen).over(over) - 2 * middle * F.sum(seen).over(over) + n * middle * middle
        return full(F.when(total > EPS, 1 - (total - 2 * slope * slope * spread + slope * slope * ts2) / total))
    raise KeyError(op)


def running(op: str, x: Column, f: Frame, kernel: bool) -> Column:
    over = f.running
    if op == "CumSum":
        return F.coalesce(F.sum(x).over(over), F.lit(0.0))
    if op == "CumProd":
        return F.coalesce(F.product(x).over(over), F.lit(1.0))
    if op == "CumMax":
        got = F.max(x).over(over)
        return got if kernel else F.coalesce(got, F.lit(-_INF))
    got = F.min(x).over(over)
    return got if kernel else F.coalesce(got, F.lit(_INF))


def cross(op: str, x: Column, p: dict[str, float], f: Frame, kernel: bool) -> Column:
    over = f.cross
    n = F.count(x).over(over)
    if op in ("CsRank", "CsQuantile"):
        # missing values rank among themselves; ties go by asset
        place = F.row_number().over(Window.partitionBy(f.t, x.isNull()).orderBy(x, f.asset))
        bins = p.get("n_bins", 0)
        if kernel:
            if op == "CsRank":
                return F.when(x.isNotNull() & (n >= 2), (place - 1) / (n - 1))
            return F.when(x.isNotNull() & (n >= 2), F.least(F.floor((place - 1) / n * int(bins)).cast("double"), F.lit(float(int(bins) - 1))))
        rank = place / n
        if op == "CsRank":
            return F.when(x.isNotNull(), rank)
        return F.when(x.isNotNull(), F.greatest(F.lit(1.0), F.least(F.ceil(rank * bins).cast("double"), F.lit(float(bins)))))
    mean = F.avg(x).over(over)
    if op == "CsDemean":
        return x - mean
    if op == "CsZScore":
        if kernel:
            s = F.stddev_pop(x).over(over)
            return F.when(s > EPS, (x - mean) / s)
        return F.when(n >= 2, (x - mean) / F.greatest(F.stddev_samp(x).over(over), F.lit(EPS)))
    if op == "CsScale":
        total = F.sum(F.abs(x)).over(over)
        return F.when(total > EPS, x / total) if kernel else x / F.when(total > EPS, total).otherwise(1.0)
    raise KeyError(op)


def hull_windows(w: int) -> tuple[int, int]:
    return max(w // 2, 1), max(int(math.sqrt(w)), 1)
