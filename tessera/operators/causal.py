"""Whether a signal leads returns and stands shocks: Granger tests with controls, interventions, and a score of both."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import T, finite, ic_series

#: Lags tested, level, size of shocks, share of the IC to keep, weights of both parts of the score and what it must reach.
LAGS, LEVEL, SHOCK, KEEP, WEIGHTS, LEAST_SCORE = 5, 0.05, 2.0, 0.5, (0.4, 0.6), 0.4


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from a digest of columns: the same in any engine that has MD5."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def top_series(df: DataFrame, value: str, k: int = 20) -> DataFrame:
    """(t_idx, v): the mean of a value over the k assets of largest mean size, 0 where they have none."""
    x = finite(F.col(value))
    best = df.groupBy("asset_id").agg(F.avg(F.abs(x)).alias("m")).where("m IS NOT NULL").orderBy(F.desc("m"), "asset_id").limit(k)
    return df.join(F.broadcast(best), "asset_id", "left_semi").groupBy(T).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("v"))


def f_tail(f: float, p: int, q: int) -> float:
    """P(F > f) with p and q degrees of freedom: an incomplete beta function by its continued fraction."""
    if f <= 0 or q <= 0:
        return 1.0
    x, a, b = q / (q + p * f), q / 2, p / 2
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side only
    if turned:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log1p(-x)) / a

    def part(m: int) -> float:
        k = m // 2
        if m % 2:
            return -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))

    # convergents as a product of ratios, forward
    value = low = 1 / (1 + part(1))
    top = 1.0
    for m in range(2, 2000):
        low, top = 1 / (1 + part(m) * low), 1 + part(m) / top
        value *= low * top
        if abs(low * top - 1) < 1e-14:
            break
    tail = front * value
    return min(max(1 - tail if turned else tail, 0.0), 1.0)


def granger_lags(effect: np.ndarray, cause: np.ndarray, controls: np.ndarray | None = None, lags: int = LAGS) -> list[tuple[int, float, float]]:
    """(lag, F, p) for one lag to ``lags``: whether the cause's lags help to predict the effect beside its own and the controls' lags."""
    n = len(effect)
    own = np.zeros((n, 0)) if controls is None else np.asarray(controls, float).reshape(n, -1)
    out = []
    for k in range(1, min(lags, n // 3) + 1):
        y = effect[k:]
        lagged = lambda x, k=k: np.column_stack([x[k - i : n - i] for i in range(1, k + 1)])
        base = np.column_stack([np.ones(n - k), lagged(effect), *[lagged(own[:, j]) for j in range(own.shape[1])]])
        full = np.column_stack([base, lagged(cause)])
        free = len(y) - full.shape[1]
        if free < 1:
            break
        small, large = (float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()) for x in (base, full))
        f = (small - large) / k / max(large / free, 1e-300)
        out.append((k, f, f_tail(f, k, free)))
    return out


def granger_test(df: DataFrame, signal: str, returns: str = "target", controls: tuple[str, ...] = (), lags: int = LAGS) -> tuple[float, float]:
    """p and F of the best lag. Series are means over the largest assets, one number a bar; too short or constant ones give (1, 0).

    More than five controls are reduced to their five main directions.
    """
    table = None
    for i, c in enumerate((returns, signal, *controls)):
        s = top_series(df, c).withColumnRenamed("v", f"s{i}")
        table = s if table is None else table.join(s, T)
    m = table.orderBy(T).drop(T).toPandas().to_numpy(float)
    if len(m) < 2 * lags + 1 or m[:, 0].std() < 1e-12 or m[:, 1].std() < 1e-12:
        return 1.0, 0.0
    more = m[:, 2:]
    if more.shape[1] > 5:
        z = more - more.mean(0)
        more = z @ np.linalg.svd(z, full_matrices=False)[2][:5].T
    k, f, p = min(granger_lags(m[:, 0], m[:, 1], more if more.shape[1] else None, lags), key=lambda r: r[2], default=(0, 0.0, 1.0))
    return p, f


def shocked(df: DataFrame, signal: str, target: str, seed: int = 42) -> DataFrame:
    """``df``'s cells under each intervention (``scenario``, asset_id, t_idx, signal, target), and as they are ("none").

    Volume: signals of three bars in ten times SHOCK. Volatility: noise of SHOCK deviations on targets. Liquidity: one
    signal in ten is 0. Choices are digests of cells, so they don't depend on partitions.
    """
    x, y = finite(F.col(signal)), finite(F.col(target))
    spread = df.agg(F.stddev_pop(y).alias("spread"))
    rows = df.select("asset_id", T, x.alias("x"), y.alias("y")).join(F.broadcast(spread))
    a, t = F.col("asset_id"), F.col(T)
    normal = F.sqrt(-2 * F.log(uniform(seed, a, t))) * F.cos(6.283185307179586 * uniform(seed + 1, a, t))
    cases = [
        ("none", F.col("x"), F.col("y")), ("volume", F.when(uniform(seed + 2, t) < 0.3, F.col("x") * SHOCK).otherwise(F.col("x")), F.col("y")),
        ("volatility", F.col("x"), F.col("y") + normal * F.col("spread") * SHOCK), ("liquidity", F.when(F.col("x").isNotNull() & (uniform(seed + 3, a, t) < 0.1), 0.0).otherwise(F.col("x")), F.col("y")),
    ]
    return rows.select("asset_id", T, F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), p.alias("signal"), q.alias("target")) for n, p, q in cases])).alias("s")).select("s.scenario", "asset_id", T, "s.signal", "s.target")


def interventions(df: DataFrame, signal: str = "signal", target: str = "target", seed: int = 42) -> DataFrame:
    """(scenario, ic, ratio, passes): the mean absolute IC under each shock, and its share of the IC without one."""
    per = ic_series(shocked(df, signal, target, seed), keys=("scenario",)).groupBy("scenario").agg(F.count("ic").alias("n"), F.avg(F.abs("ic")).alias("ic"))
    base = per.where("scenario = 'none'").select(F.col("ic").alias("base"), F.col("n").alias("m"))
    got = per.where("scenario <> 'none'").join(F.broadcast(base))
    ratio = F.when((F.col("m") < 3) | (F.col("n") < 3) | (F.col("base") < 1e-10), 1.0).otherwise(F.col("ic") / F.col("base"))
    return got.select("scenario", "ic", ratio.alias("ratio"), (ratio >= KEEP).alias("passes"))


def robustness(df: DataFrame, signal: str = "signal", target: str = "target", controls: tuple[str, ...] = (), seed: int = 42) -> dict[str, float | bool]:
    """Granger p and F, mean ratio of the interventions, and their score in [0, 1] with whether it is enough.

    A factor passes with a score of LEAST_SCORE and two of three interventions.
    """
    p, f = granger_test(df, signal, target, controls)
    rows = interventions(df, signal, target, seed).collect()
    ratio = float(np.mean([r.ratio for r in rows])) if rows else 1.0
    score = WEIGHTS[0] * (1 - min(p / LEVEL, 1.0)) + WEIGHTS[1] * min(ratio, 1.0)
    stands = sum(r.passes for r in rows) >= 2 or not rows
    return {"p": p, "f": f, "leads": p < LEVEL, "ratio": ratio, "stands": stands, "score": score, "passes": score >= LEAST_SCORE and stands}
