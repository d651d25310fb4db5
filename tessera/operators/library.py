"""Factor libraries: dependence between factors, admission, screening, combination and selection.

Factors are long: (``factor``, ``asset_id``, ``t_idx``, ``v``). A cell's factors meet in
one shuffle by (asset, bar) and are paired there. Libraries have hundreds of factors;
tables of pairs are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import T, TINY, average_rank, correlation, ic_series, ic_stats

KEYS = ("asset_id", T)


def long_form(wide: DataFrame, factors: list[str], *more: str) -> DataFrame:
    """Columns of a wide frame as rows, with ``more`` columns beside each; missing values are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("v")) for f in factors]))
    return wide.select(*KEYS, *more, cells.alias("s")).select("s.factor", *KEYS, "s.v", *more).where("v IS NOT NULL")


def _pairs(values: DataFrame, new: list[str] | None = None) -> DataFrame:
    """(a, b, asset_id, t_idx, x, y) of each cell's pairs of factors: the factors are computed once, and a cell holds a library at most."""
    cells = values.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("factor", "v"))).alias("m"))

    def after(p, i):
        rest = F.slice("m", i + 2, F.size("m"))
        if new is not None:
            rest = F.filter(rest, lambda q: p["factor"].isin(new) | q["factor"].isin(new))
        return F.transform(rest, lambda q: F.struct(p["factor"].alias("a"), q["factor"].alias("b"), p["v"].alias("x"), q["v"].alias("y")))

    return cells.select(*KEYS, F.explode(F.flatten(F.transform("m", after))).alias("s")).select("s.a", "s.b", *KEYS, "s.x", "s.y")


def wide_pairs(wide: DataFrame, factors: list[str]) -> DataFrame:
    """(a, b, t_idx, x, y) of the pairs of a wide frame's columns: a cell is a row there, so nothing has to meet."""
    names = sorted(factors)
    made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    none = F.array().cast("array<struct<a:string,b:string,x:double,y:double>>")
    return wide.select(T, F.explode(F.array(*made) if made else none).alias("s")).select("s.a", "s.b", T, "s.x", "s.y").where("x IS NOT NULL AND y IS NOT NULL")


def dependence(values: DataFrame, method: str = "spearman", least: int = 3, new: list[str] | None = None) -> DataFrame:
    """(a, b, rho): the mean over bars of absolute correlations between pairs of factors.

    spearman and pearson take the bars with ``least`` common assets, ranks being those of the
    common assets. signed takes ranks within each factor first, needs five assets, and makes
    the mean absolute at the end. distance is the distance correlation. With ``new`` only pairs
    with one of these factors are made.
    """
    if method == "signed":
        ranked = values.select("factor", *KEYS, average_rank("v", "factor", T).alias("v"))
        per = _pairs(ranked, new).groupBy("a", "b", T).agg(F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("r")).where("n >= 5")
        return per.groupBy("a", "b").agg(F.abs(F.avg("r")).alias("rho"))
    return pair_dependence(_pairs(values, new), method, least=least).withColumnRenamed(method, "rho")


def pair_dependence(pairs: DataFrame, *methods: str, least: int = 3) -> DataFrame:
    """(a, b, and a column for each method): the mean over the bars with ``least`` common assets, in one pass over the pairs (a, b, t_idx, x, y).

    A pair and bar is one group of two numbers an asset; all three measures take n log n steps and no more memory than n.
    """
    measures = {"spearman": lambda x, y: _linear(_ranks(x), _ranks(y)), "pearson": _linear, "distance": distance_correlation}
    if not methods or set(methods) - set(measures):
        raise ValueError("method is spearman, pearson, signed or distance")

    def one(key: tuple, table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        got = {m: [measures[m](x, y) if len(x) >= least else None] for m in methods}
        return pa.table({"a": [key[0].as_py()], "b": [key[1].as_py()], **{m: pa.array(v, pa.float64()) for m, v in got.items()}})

    rows = pairs.select("a", "b", T, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    per = rows.groupBy("a", "b", T).applyInArrow(one, f"a string, b string, {', '.join(f'{m} double' for m in methods)}")
    return per.where(F.col(methods[0]).isNotNull()).groupBy("a", "b").agg(*[F.avg(m).alias(m) for m in methods])


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks with ties averaged."""
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[at]


def _linear(x: np.ndarray, y: np.ndarray) -> float:
    """Absolute Pearson correlation, 0 as in ``metrics.correlation``."""
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x @ x / len(x)) * (y @ y / len(y))) * len(x)
    r = abs(float(x @ y / d)) if d > TINY or np.isnan(d) else 0.0
    return 0.0 if r <= TINY else r


def _from_all(v: np.ndarray) -> np.ndarray:
    """The sum of each value's distances to all."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    k, below = np.arange(len(v)), np.cumsum(s) - s
    out = np.empty(len(v))
    out[order] = s * (2 * k - len(v)) + s.sum() - 2 * below
    return out


def _products(x: np.ndarray, y: np.ndarray) -> float:
    """The sum over pairs (i < j) of |xi - xj| |yi - yj|.

    Ranks of x are halved bit by bit, each half in the order of y: what a value of the upper half meets below its y are
    running sums of the lower half.
    """
    n = len(x)
    by = np.argsort(x, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    order = np.argsort(y, kind="stable")
    r, x, y = rank[order], x[order], y[order]
    total = 0.0
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        block = r >> (bit + 1)
        upper = (r >> bit & 1).astype(bool)
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sizes = np.diff(np.r_[first, n])

        def running(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c = np.cumsum(np.where(upper, 0.0, v))
            base = np.where(first > 0, c[first - 1], 0.0)
            return (c - np.repeat(base, sizes))[upper], np.repeat(c[first + sizes - 1] - base, sizes)[upper]

        u, v = x[upper], y[upper]
        (k, kk), (sx, sxx), (sy, syy), (sp, spp) = (running(w) for w in (np.ones(n), x, y, x * y))
        # those below in y count with one sign, those above with the other
        k, sx, sy, sp = 2 * k - kk, 2 * sx - sxx, 2 * sy - syy, 2 * sp - spp
        total += float((u * v * k - v * sx - u * sy + sp).sum())
        # stable halves of every block
        low = np.cumsum(~upper)
        base = np.repeat(np.where(first > 0, low[first - 1], 0), sizes)
        begin, lows = np.repeat(first, sizes), np.repeat(low[first + sizes - 1], sizes) - base
        here = np.arange(n) - begin
        to = begin + np.where(upper, lows + here - (low - base), low - base - 1)
        r[to], x[to], y[to] = r.copy(), x.copy(), y.copy()
    return total


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The sample distance correlation, from sums that don't need the matrices of distances."""
    n = len(x)
    x, y = x - x.mean(), y - y.mean()
    a, b = _from_all(x), _from_all(y)
    mean = lambda p, q, s: s / n**2 + p.sum() * q.sum() / n**4 - 2 * float(p @ q) / n**3
    low = np.sqrt(max(mean(a, a, 2 * n * float(x @ x)), 0.0) * max(mean(b, b, 2 * n * float(y @ y)), 0.0))
    return float(np.sqrt(max(mean(a, b, 2 * _products(x, y)), 0.0) / low)) if low > 1e-12 else 0.0


def extend(known: DataFrame, values: DataFrame, new: list[str], method: str = "spearman") -> DataFrame:
    """The pair table with the pairs of new factors added; of each cell only the pairs with a new factor are made."""
    fresh = dependence(values, method, new=new)
    return known.where(~F.col("a").isin(new) & ~F.col("b").isin(new)).unionByName(fresh)


def diagnostics(pairs: DataFrame, saturated: float = 0.3) -> DataFrame:
    """One row: number of pairs, mean, greatest and 95th percentile of dependence, share of saturated pairs."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg("rho").alias("mean_rho"), F.max("rho").alias("max_rho"), F.percentile("rho", 0.95).alias("p95_rho"), F.avg((F.col("rho") > saturated).cast("double")).alias("saturation"))


def novelty(pairs: DataFrame, limit: float = 0.5) -> DataFrame:
    """(factor, novelty, conflicts): 1 less the greatest dependence, and the number of factors beyond the limit."""
    both = pairs.select(F.col("a").alias("factor"), "rho").unionAll(pairs.select(F.col("b").alias("factor"), "rho"))
    return both.groupBy("factor").agg((1 - F.max("rho")).alias("novelty"), F.sum((F.col("rho") >= limit).cast("int")).alias("conflicts"))


def admit(stats: dict[str, float], rho: dict[tuple[str, str], float], least: float = 0.04, limit: float = 0.5, replace_ic: float = 0.10, replace_ratio: float = 1.3) -> tuple[list[str], dict[str, str]]:
    """A library grown greedily from the best IC down, and why others stayed out.

    A factor enters with ic >= least and no dependence of limit or more. One with exactly one
    conflict takes its place if its own ic is replace_ic or more and replace_ratio times the other's.
    """
    inside: list[str] = []
    out: dict[str, str] = {}
    pair = lambda x, y: rho.get((min(x, y), max(x, y)), 0.0)
    for f in sorted(stats, key=lambda f: (-stats[f], f)):
        if stats[f] < least:
            out[f] = "weak"
            continue
        clash = [g for g in inside if pair(f, g) >= limit]
        if not clash:
            inside.append(f)
        elif len(clash) == 1 and stats[f] >= replace_ic and stats[f] >= replace_ratio * stats[clash[0]]:
            inside.remove(clash[0])
            out[clash[0]] = f"replaced by {f}"
            inside.append(f)
        else:
            out[f] = "redundant with " + clash[0]
    return inside, out


def screen(panel: DataFrame, factors: list[str], target: str = "target", least: float = 0.04, limit: float = 0.5, assets: int = 100, seed: int = 42) -> tuple[list[str], dict[str, str]]:
    """Staged admission of candidate columns: IC on a sample of assets, then on all, then redundancy.

    Each stage is one job over all candidates that are left. The sample is by hash of the asset.
    """
    ids = panel.select("asset_id").distinct().orderBy(F.xxhash64("asset_id", F.lit(seed)), "asset_id").limit(assets)
    left, why = list(factors), {}
    for stage, frame in (("fast screen", panel.join(F.broadcast(ids), "asset_id", "left_semi")), ("weak", panel)):
        if not left:
            break
        values = long_form(frame, left, target)
        got = {r.factor: r.ic_paper for r in ic_stats(ic_series(values, "v", target, keys=("factor",)), "factor").collect()}
        cut = least / 2 if stage == "fast screen" else least
        why |= {f: stage for f in left if got.get(f, 0.0) < cut}
        left = [f for f in left if f not in why]
    if not left:
        return [], why
    rho = {(r.a, r.b): r.spearman for r in pair_dependence(wide_pairs(panel, left), "spearman").collect()}
    chosen, dropped = admit({f: got[f] for f in left}, rho, least, limit)
    return chosen, why | dropped


def gate(stats: DataFrame, ic: float = 0.05, icir: float = 0.5, win: float = 0.5, turnover: float = 0.8) -> DataFrame:
    """Rows of factor statistics that reach all thresholds."""
    return stats.where((F.abs("ic_mean") >= ic) & (F.abs("icir") >= icir) & (F.col("win_rate") >= win) & (F.col("turnover") <= turnover))


def gram(wide: DataFrame, factors: list[str]) -> tuple[list[str], np.ndarray]:
    """Factors, and their inner products over the panel, each less its mean (K x K numbers, however many rows): two aggregates over a wide frame."""
    names = sorted(factors)
    means = wide.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in names]).first()
    z = wide.select(*[(F.col(f).cast("double") - F.lit(means[f])).alias(f) for f in names])
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = z.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in at]).first()
    g = np.zeros((len(names), len(names)))
    for i, j in at:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return names, g


def spectral_compression(g: np.ndarray, energy: float = 0.95) -> float:
    """1 less the share of directions that hold ``energy`` of the library's variance."""
    values = np.sort(np.maximum(np.linalg.eigvalsh(g), 0))[::-1]
    if not len(values) or values.sum() <= 0:
        return 0.0
    need = int(np.searchsorted(np.cumsum(values) / values.sum(), energy) + 1)
    return 1 - need / len(values)


def orthogonal_escape(g: np.ndarray, span: list[int], candidate: int, energy: float = 0.99) -> float:
    """The share of a factor's variance outside the main directions of others; 1 for no others."""
    own = g[candidate, candidate]
    if not span:
        return 1.0
    if own <= 0:
        return 0.0
    values, vectors = np.linalg.eigh(g[np.ix_(span, span)])
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    if values.sum() <= 0:
        return 1.0
    need = int(np.searchsorted(np.cumsum(values) / values.sum(), energy) + 1)
    kept = [i for i in range(min(need, len(values))) if values[i] > 1e-10]
    inside = sum(float(vectors[:, i] @ g[span, candidate]) ** 2 / values[i] for i in kept)
    return float(np.clip(1 - inside / own, 0, 1))


def residual_alignment(g: np.ndarray, span: list[int], candidate: int, target: int, energy: float = 0.99) -> float:
    """Absolute cosine of a factor with a target, both without what lies in the main directions of others. All from the Gram matrix."""
    inner = {(x, y): g[x, y] for x in (candidate, target) for y in (candidate, target)}
    if span:
        values, vectors = np.linalg.eigh(g[np.ix_(span, span)])
        order = np.argsort(values)[::-1]
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        if values.sum() > 0:
            need = int(np.searchsorted(np.cumsum(values) / values.sum(), energy) + 1)
            for i in range(min(need, len(values))):
                if values[i] > 1e-10:
                    along = {x: float(vectors[:, i] @ g[span, x]) for x in (candidate, target)}
                    for x, y in inner:
                        inner[x, y] -= along[x] * along[y] / values[i]
    size = inner[candidate, candidate] * inner[target, target]
    return float(np.clip(abs(inner[candidate, target]) / np.sqrt(size), 0, 1)) if size > 1e-30 else 0.0


def jump_worth(compression: float, escape: float, alignment: float, threshold: float = 0.45) -> tuple[float, bool]:
    """Whether a factor is worth leaving the library's span for: weights .3, .45 and .25."""
    score = 0.3 * compression + 0.45 * escape + 0.25 * alignment
    return score, score >= threshold


def standard_by_bar(values: DataFrame) -> DataFrame:
    """Population z-scores by factor and bar; a bar without spread divides by 1."""
    by = Window.partitionBy("factor", T)
    s = F.stddev_pop("v").over(by)
    return values.withColumn("v", (F.col("v") - F.avg("v").over(by)) / F.when(s > 0, s).otherwise(1.0))


def combine_equal(values: DataFrame) -> DataFrame:
    """(asset_id, t_idx, signal): mean of the z-scores there are."""
    return standard_by_bar(values).groupBy(*KEYS).agg(F.avg("v").alias("signal"))


def combine_weighted(values: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Z-scores weighted by positive weights that sum to 1, a missing one counting 0; equal weights if none is positive."""
    up = {f: max(w, 0.0) for f, w in weights.items()}
    total = sum(up.values())
    if total <= 0:
        return combine_equal(values)
    table = F.create_map(*[x for f, w in up.items() for x in (F.lit(f), F.lit(w / total))])
    z = standard_by_bar(values).withColumn("w", F.coalesce(F.try_element_at(table, "factor"), F.lit(0.0)))
    return z.groupBy(*KEYS).agg(F.sum(F.col("v") * F.col("w")).alias("signal"))


def combine_by_block(values: DataFrame, ic: DataFrame, block: int = 20, lookback: int = 60) -> DataFrame:
    """IC weights anew for each block of bars, from the ``lookback`` bars that end before it; the first block is equal.

    ``ic``: (factor, t_idx, ic). Each bar's IC is exploded to the few blocks that it informs.
    """
    first = F.floor(F.col(T) / block) + 1
    last = F.floor((F.col(T) + lookback) / block)
    informed = ic.where("ic IS NOT NULL").select("factor", "ic", F.explode(F.sequence(first, F.greatest(first, last))).alias("block"), F.col(T).alias("u"))
    informed = informed.where((F.col("u") < F.col("block") * block) & (F.col("u") >= F.col("block") * block - lookback))
    w = informed.groupBy("block", "factor").agg(F.greatest(F.avg("ic"), F.lit(0.0)).alias("w"))
    w = w.withColumn("w", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("block"))))
    z = standard_by_bar(values).withColumn("block", F.floor(F.col(T) / block))
    got = z.join(F.broadcast(w), ["block", "factor"], "left").groupBy(*KEYS).agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.avg("v").alias("e"))
    return got.select(*KEYS, F.coalesce("s", "e").alias("signal"))


def orthogonal(values: DataFrame, order: list[str]) -> DataFrame:
    """(factor, asset_id, t_idx, v): Gram-Schmidt over the whole panel in the given order, from the Gram matrix and one projection.

    Takes cells that all factors have.
    """
    whole = values.where(F.col("factor").isin(order)).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("factor", "v"))).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(order))
    cols = whole.select(*KEYS, *[F.try_element_at("m", F.lit(f)).alias(f"f{i}") for i, f in enumerate(order)])
    k = len(order)
    sums = cols.agg(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    # rows of the inverse of the unit lower triangle turn factors into orthogonal ones
    c = np.eye(k)
    for i in range(k):
        for j in range(i):
            low = c[j] @ g @ c[j]
            if low > 1e-12:
                c[i] = c[i] - (c[i] @ g @ c[j]) / low * c[j]
    made = [F.struct(F.lit(order[i]).alias("factor"), sum((F.col(f"f{j}") * float(c[i, j]) for j in range(i + 1)), F.lit(0.0)).alias("v")) for i in range(k)]
    return cols.select(*KEYS, F.explode(F.array(*made)).alias("s")).select("s.factor", *KEYS, "s.v")


def composite(values: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of w * v over sum of |w|; a cell that lacks a factor is missing. Zero weights count as equal ones."""
    if not any(weights.values()):
        weights = dict.fromkeys(weights, 1.0)
    table = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    own = values.where(F.col("factor").isin(list(weights))).withColumn("w", F.element_at(table, F.col("factor")))
    got = own.groupBy(*KEYS).agg(F.count("v").alias("n"), F.sum(F.col("v") * F.col("w")).alias("s"))
    return got.select(*KEYS, F.when(F.col("n") == len(weights), F.col("s") / sum(map(abs, weights.values()))).alias("signal"))


def top_k(stats: DataFrame, k: int, ic: float = 0.05, icir: float = 0.5) -> DataFrame:
    """k factors: those that pass the gate by IC, then the rest by IC."""
    ok = (F.col("ic_paper") >= ic) & (F.abs("icir") >= icir)
    return stats.withColumn("passed", ok).orderBy(F.desc("passed"), F.desc("ic_paper"), "factor").limit(k)


def lasso(wide: DataFrame, factors: list[str], target: str = "target", strength: float = 1e-3) -> dict[str, float]:
    """Coefficients of an L1 fit over complete rows; factors with 0 aren't selected."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = wide.select(*[F.col(f).cast("double") for f in factors], F.col(target).cast("double").alias("label")).na.drop()
    data = VectorAssembler(inputCols=factors, outputCol="features").transform(rows)
    fit = LinearRegression(elasticNetParam=1.0, regParam=strength, standardization=True).fit(data)
    return dict(zip(factors, map(float, fit.coefficients), strict=True))


def stepwise(wide: DataFrame, factors: list[str], target: str = "target", most: int = 5) -> list[str]:
    """Greedy choice by ICIR of the equal combination; every step scores all candidates in one job."""
    chosen: list[str] = []
    best = 0.0
    z = standard_by_bar(long_form(wide, factors))
    labels = wide.select(*KEYS, target)
    while len(chosen) < most:
        left = [f for f in factors if f not in chosen]
        if not left:
            break
        trials = F.explode(F.array(*map(F.lit, left)) if len(left) else F.array())
        tried = z.where(F.col("factor").isin(chosen)).withColumn("trial", trials).unionByName(z.where(F.col("factor").isin(left)).withColumn("trial", F.col("factor")))
        made = tried.groupBy("trial", *KEYS).agg(F.avg("v").alias("v")).join(labels, list(KEYS))
        got = {r.trial: abs(r.icir) for r in ic_stats(ic_series(made, "v", target, keys=("trial",)), "trial").collect()}
        f = max(sorted(got), key=got.get, default=None)
        if f is None or got[f] <= best:
            break
        chosen.append(f)
        best = got[f]
    return chosen


def family_summary(candidates: DataFrame) -> DataFrame:
    """(family, tried, admitted, rate, saturated) from rows (family, admitted)."""
    return candidates.groupBy("family").agg(F.count(F.lit(1)).alias("tried"), F.sum(F.col("admitted").cast("int")).alias("admitted"), F.avg(F.col("admitted").cast("double")).alias("rate")).withColumn("saturated", (F.col("tried") >= 5) & (F.col("rate") < 0.1))
