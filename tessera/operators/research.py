"""Scores for research decisions: dependence beyond rank correlation, what a factor adds to others, rolling models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.library import KEYS, long_form, pair_dependence
from tessera.operators.metrics import T, ic_series, ic_stats

_EDGE = 1e-12


def reward(predicted: Column, redundancy: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """|predicted|^a * (1 - redundancy)^b, both held within [0, 1]."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.pow(clip(F.abs(predicted)), F.lit(a)) * F.pow(1 - clip(redundancy), F.lit(b))


def dependence_profile(pairs: DataFrame) -> DataFrame:
    """(a, b, distance, pearson, spearman, information, score) of pairs (a, b, t_idx, x, y): information is that of a Gaussian copula, -ln(1 - rho^2) / 2."""
    out = pair_dependence(pairs, "distance", "pearson", "spearman", least=5)
    info = -F.log(1 - F.least(F.col("spearman") * F.col("spearman"), F.lit(1 - _EDGE))) / 2
    return out.withColumn("information", info).withColumn("score", F.greatest(F.col("distance"), 1 - F.exp(-F.col("information"))))


def normal_equations(rows: DataFrame, columns: list[str], label: str, *keys: str) -> DataFrame:
    """(keys, n, s): sums of products of (1, columns..., label), upper triangle; additive over any split of the rows."""
    cols = [F.lit(1.0), *[F.col(c) for c in columns], F.col(label)]
    sums = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"))


def _square(s: list[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = s
    return m + np.triu(m, 1).T


def solve(s: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Intercept and coefficients from a matrix of sums; the penalty is relative to the columns' squares and spares the intercept."""
    a = s[:-1, :-1].copy()
    a[np.arange(1, len(a)), np.arange(1, len(a))] *= 1 + ridge
    return np.linalg.lstsq(a, s[:-1, -1], rcond=None)[0]


def marginal_utility(wide: DataFrame, base: list[str], candidate: str, target: str = "target", share: float = 0.6) -> DataFrame:
    """One row (d_r2, d_ic): what a candidate adds to a fit on others, judged on the later bars. Complete rows only."""
    cut = wide.agg(F.percentile(T, share)).first()[0] or 0.0
    rows = wide.select(*KEYS, *base, candidate, target).na.drop().withColumn("late", F.col(T) > cut)
    out = {}
    for name, cols in (("base", base), ("full", [*base, candidate])):
        sums = {r.late: _square(r.s, len(cols) + 2) for r in normal_equations(rows, cols, target, "late").collect()}
        if len(sums) < 2:
            return wide.sparkSession.createDataFrame([(0.0, 0.0)], "d_r2 double, d_ic double")
        beta = solve(sums[False])
        s = sums[True]
        v = np.append(-beta, 1.0)
        total = s[-1, -1] - s[0, -1] ** 2 / s[0, 0]
        r2 = 1 - float(v @ s @ v) / total if total > _EDGE else 0.0
        fit = sum((F.col(c) * float(b) for c, b in zip(cols, beta[1:], strict=True)), F.lit(float(beta[0])))
        ic = ic_stats(ic_series(rows.where("late").withColumn("fit", fit), "fit", target)).first().ic_mean
        out[name] = r2, ic
    return wide.sparkSession.createDataFrame([tuple(float(f - b) for f, b in zip(out["full"], out["base"], strict=True))], "d_r2 double, d_ic double")


def rolling_ridge(wide: DataFrame, factors: list[str], target: str = "target", train: int = 36, step: int = 6, gap: int = 1, ridge: float = 1e-2) -> DataFrame:
    """(asset_id, t_idx, fit) of ridge fits on the ``train`` bars that end ``gap`` before each block of ``step`` bars.

    Sums by bar are additive, so every window's fit comes from one pass; they are small (a row a bar) and are summed here.
    """
    rows = wide.select(*KEYS, *factors, target)
    by_bar = {r[T]: _square(r.s, len(factors) + 2) for r in normal_equations(rows.na.drop(), factors, target, T).collect()}
    last = max(by_bar, default=-1) + 1
    fits = []
    for start in range(train + gap, last + 1, step):
        own = [by_bar[t] for t in range(start - gap - train, start - gap) if t in by_bar]
        if own:
            fits.append((start, [float(b) for b in solve(sum(own), ridge)]))
    if not fits:
        return rows.select(*KEYS, F.lit(None).cast("double").alias("fit")).limit(0)
    table = F.broadcast(wide.sparkSession.createDataFrame(fits, "start int, beta array<double>"))
    held = rows.withColumn("start", (F.floor((F.col(T) - train - gap) / step) * step + train + gap).cast("int")).join(table, "start")
    fit = sum((F.col(f) * F.col("beta")[i + 1] for i, f in enumerate(factors)), F.col("beta")[0])
    return held.select(*KEYS, fit.alias("fit"))


def research_score(ic_mean: float, ic_std: float, bars: int, redundancy: float, turnover: float, shrink: float = 20.0) -> float:
    """Shrunk IC less its standard error, lowered by redundancy and turnover."""
    if bars <= 0:
        return 0.0
    shrunk = abs(ic_mean) * bars / (bars + shrink)
    return max(shrunk - ic_std / math.sqrt(bars), 0.0) * (1 - min(max(redundancy, 0.0), 1.0)) * (1 - 0.5 * min(max(turnover, 0.0), 1.0))


def attribution(wide: DataFrame, factors: list[str], target: str = "target") -> DataFrame:
    """(factor, ic_mean, icir, ls): IC statistics and the mean long-short return of the top and bottom fifth of each factor."""
    values = long_form(wide, factors, target)
    ic = ic_stats(ic_series(values, "v", target, keys=("factor",)), "factor").select("factor", "ic_mean", "icir")
    from pyspark.sql import Window

    by = Window.partitionBy("factor", T)
    rows = values.where(F.col(target).isNotNull()).withColumns({"k": F.floor(F.count(F.lit(1)).over(by) / 5), "up": F.row_number().over(by.orderBy("v", "asset_id")), "down": F.row_number().over(by.orderBy(F.desc("v"), F.desc("asset_id")))})
    bars = rows.where("k > 0").groupBy("factor", T).agg((F.avg(F.when(F.col("down") <= F.col("k"), F.col(target))) - F.avg(F.when(F.col("up") <= F.col("k"), F.col(target)))).alias("ls"))
    return ic.join(bars.groupBy("factor").agg(F.avg("ls").alias("ls")), "factor", "left")
