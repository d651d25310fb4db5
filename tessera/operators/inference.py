"""Significance of series: on the driver for one number a bar, in Spark where rows are many."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import T

_N = NormalDist()
EULER = 0.5772156649015329
#: Coefficients of the rational form, from the highest power of t down.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def series(df: DataFrame, value: str) -> np.ndarray:
    """A per-bar series on the driver, in order, known values only: one number a bar."""
    return df.where(F.col(value).isNotNull()).orderBy(T).select(value).toPandas()[value].to_numpy(float)


def newey_west(df: DataFrame, value: str, lags: int | None = None) -> DataFrame:
    """One row (n, mean, se, t, p) of a mean with Bartlett weights; lag products come from one window."""
    base = df.where(F.col(value).isNotNull()).select(T, F.col(value).alias("v"))
    n, mean = base.agg(F.count("v"), F.avg("v")).first()
    lags = min(lags if lags is not None else int(4 * (max(n, 1) / 100) ** (2 / 9)), max(n - 1, 0))
    order = Window.orderBy(T)
    e = base.select(T, (F.col("v") - F.lit(mean)).alias("e"))
    cols = [F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.sum(F.col("e") * F.col(f"l{k}")).alias(f"g{k}") for k in range(1, lags + 1)]]
    g = e.withColumns({f"l{k}": F.lag("e", k).over(order) for k in range(1, lags + 1)}).agg(*cols) if lags else e.agg(*cols)
    var = F.col("g0") + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    se = F.sqrt(F.greatest(var, F.lit(0.0))) / n if n else F.lit(None).cast("double")
    out = g.select(F.lit(n).cast("long").alias("n"), F.lit(mean).cast("double").alias("mean"), se.alias("se"))
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.col("se")))
    return out.withColumn("p", two_sided(F.col("t")))


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value. The complement of the error function comes from a rational form (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[0])
    for c in ERFC[1:]:
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with step-up adjusted p-values: the running minimum, from the largest down, of p * m / rank."""
    m = df.where(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("m"))
    ranked = df.join(F.broadcast(m)).withColumn("__r", F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last())))
    down = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(F.min(F.col(p) * F.col("m") / F.col("__r")).over(down), F.lit(1.0)))).drop("m", "__r")


def block_bootstrap(x: np.ndarray, draws: int = 1000, block: int | None = None, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """Mean and its interval by circular blocks."""
    n = len(x)
    if n < 2:
        return (float(x.mean()) if n else 0.0,) * 3
    block = block or max(1, min(20, n // 10))
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, n, (draws, -(-n // block)))
    at = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n] % n
    means = x[at].mean(1)
    lo, hi = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(x.mean()), float(lo), float(hi)


def sign_flip(x: np.ndarray, draws: int = 1000, seed: int = 42) -> float:
    """Two-sided p-value of a zero mean by random signs."""
    if not len(x):
        return 1.0
    flips = np.random.default_rng(seed).choice([-1.0, 1.0], (draws, len(x)))
    return float((1 + (np.abs((flips * x).mean(1)) >= abs(x.mean()) - 1e-15).sum()) / (draws + 1))


def expected_best_sharpe(trials: int, variance: float) -> float:
    """What the best of independent worthless trials is expected to reach."""
    if trials < 2 or variance <= 0:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * _N.inv_cdf(1 - 1 / trials) + EULER * _N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(x: np.ndarray, trials: int, variance: float) -> float:
    """Probability that the series' Sharpe ratio beats the expected best of ``trials``, given its skew and (raw) kurtosis."""
    n = len(x)
    if n < 4 or x.std(ddof=1) < 1e-12:
        return 0.0
    sharpe = x.mean() / x.std(ddof=1)
    d = (x - x.mean()) / x.std()
    skew = float((d**3).mean()) * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = float((d**4).mean())
    low = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    if low <= 0:
        return 0.0
    return _N.cdf((sharpe - expected_best_sharpe(trials, variance)) * math.sqrt(n - 1) / math.sqrt(low))


def purged_paths(spark: SparkSession, bars: int, groups: int = 10, tests: int = 2, horizon: int = 1, embargo: float = 0.01) -> DataFrame:
    """(path, t_idx, role): combinatorial splits. Training bars within a label horizon before a test group or the embargo after it are purged."""
    edges = [round(i * bars / groups) for i in range(groups + 1)]
    combos = list(itertools.combinations(range(groups), tests))
    spans = [(p, edges[g], edges[g + 1]) for p, c in enumerate(combos) for g in c]
    table = spark.createDataFrame(spans, "path int, lo int, hi int")
    grid = spark.range(bars).select(F.col("id").cast("int").alias(T), F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1))).alias("path"))
    gap = int(bars * embargo)
    t = F.col(T)
    inside = F.max(((t >= F.col("lo")) & (t < F.col("hi"))).cast("int"))
    near = F.max(((t >= F.col("lo") - horizon) & (t < F.col("hi") + gap)).cast("int"))
    return grid.join(F.broadcast(table), "path").groupBy("path", T).agg(F.when(inside == 1, "test").when(near == 1, "purged").otherwise("train").alias("role"))


def overfit_probability(trials: np.ndarray, blocks: int = 10, most: int = 2000, seed: int = 42) -> float:
    """Share of splits in which the best trial in sample ranks below the median out of sample. Rows are bars, columns trials."""
    n = len(trials) // blocks * blocks
    if n < blocks or trials.shape[1] < 2:
        return 0.0
    parts = trials[:n].reshape(blocks, -1, trials.shape[1])
    sums, squares, size = parts.sum(1), (parts**2).sum(1), parts.shape[1]
    combos = list(itertools.combinations(range(blocks), blocks // 2))
    if len(combos) > most:
        combos = [combos[i] for i in np.random.default_rng(seed).choice(len(combos), most, replace=False)]
    bad = 0
    for c in combos:
        inside = np.zeros(blocks, bool)
        inside[list(c)] = True

        def sharpe(m: np.ndarray) -> np.ndarray:
            k = m.sum() * size
            mean = sums[m].sum(0) / k
            var = squares[m].sum(0) / k - mean**2
            return mean / np.sqrt(np.maximum(var, 1e-18))

        best = int(np.argmax(sharpe(inside)))
        outer = sharpe(~inside)
        rank = (outer < outer[best]).sum() + ((outer == outer[best]).sum() - 1) / 2 + 1
        share = rank / (len(outer) + 1)
        bad += math.log(share / (1 - share)) <= 0
    return bad / len(combos)


def diebold_mariano(a: np.ndarray, b: np.ndarray, lags: int = 1) -> tuple[float, float]:
    """Statistic and two-sided p-value of equal mean loss."""
    d = np.asarray(a) - np.asarray(b)
    e = d - d.mean()
    n = len(d)
    var = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    if n < 3 or var <= 1e-18:
        return 0.0, 1.0
    s = d.mean() / math.sqrt(var / n)
    return float(s), 2 * (1 - _N.cdf(abs(s)))


def wilcoxon(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Signed-rank statistic and its normal p-value; zero differences are dropped, ties share ranks."""
    d = np.asarray(a) - np.asarray(b)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    values, where, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[where]
    del values
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return float(w), 2 * _N.cdf((w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0


def granger(df: DataFrame, cause: str, effect: str, lags: int = 2) -> float:
    """F statistic of ``cause`` helping to predict ``effect``; cross-products are summed in one aggregate."""
    order = Window.orderBy(T)
    cols = {f"{s}{k}": F.lag(c, k).over(order) for s, c in (("e", effect), ("c", cause)) for k in range(1, lags + 1)}
    rows = df.withColumns(cols).select(F.col(effect).alias("y"), *cols).na.drop()
    names = ["one", *cols]
    rows = rows.withColumn("one", F.lit(1.0))
    both = [(a, b) for i, a in enumerate([*names, "y"]) for b in [*names, "y"][i:]]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in both], F.count(F.lit(1)).alias("n")).first()
    if sums.n <= 2 * lags + 2:
        return 0.0
    get = lambda a, b: sums[f"{a}|{b}"] if f"{a}|{b}" in sums.asDict() else sums[f"{b}|{a}"]

    def residual(use: list[str]) -> float:
        x = np.array([[get(a, b) for b in use] for a in use])
        xy = np.array([get(a, "y") for a in use])
        return float(get("y", "y") - xy @ np.linalg.lstsq(x, xy, rcond=None)[0])

    small, full = residual([n for n in names if not n.startswith("c")]), residual(names)
    return (small - full) / lags / max(full / (sums.n - len(names)), 1e-18)


def decay_curve(df: DataFrame, signal: str, targets: list[str]) -> DataFrame:
    """(horizon, ic_mean) of one signal against targets of growing horizons, in one job."""
    from tessera.operators.metrics import ic_series, ic_stats

    each = df.select("asset_id", T, signal, F.explode(F.array(*[F.struct(F.lit(i + 1).alias("horizon"), F.col(t).alias("y")) for i, t in enumerate(targets)])).alias("s")).select("asset_id", T, signal, "s.horizon", "s.y")
    return ic_stats(ic_series(each, signal, "y", keys=("horizon",)), "horizon").select("horizon", "ic_mean", "icir")
