"""What is put together of other operators to judge factors: splits, IC bundles, purged paths, frozen sets, research scores, a chain of tests."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import causal, inference, library, metrics, portfolio
from tessera.operators.inference import newey_west, purged_paths
from tessera.operators.metrics import T, ic_series, ic_stats
from tessera.sources.store import written

_SPLIT = "split int, train_start int, train_end int, test_start int, test_end int"


def contiguous_split(spark: SparkSession, bars: int, share: float = 0.7) -> DataFrame:
    """One row of a split in two: ends are exclusive."""
    cut = int(bars * share)
    return spark.createDataFrame([(0, 0, cut, cut, bars)], _SPLIT)


def rolling_splits(spark: SparkSession, bars: int, train: int, test: int, step: int = 1) -> DataFrame:
    """Windows of ``train`` bars, each followed by ``test`` bars, every ``step`` bars, as far as they fit."""
    n = max(0, (bars - train - test) // step + 1)
    at = F.col("id") * step
    return spark.range(n).select(F.col("id").cast("int").alias("split"), *[x.cast("int").alias(c) for c, x in (("train_start", at), ("train_end", at + train), ("test_start", at + train), ("test_end", at + train + test))])


def ic_evidence(df: DataFrame, signal: str = "signal", target: str = "target", per_year: int = 252, lags: int | None = None) -> DataFrame:
    """(correlation, n, mean, absolute_mean, mean_absolute, std, icir, annual_icir, t, win_rate, hac_se, hac_t, hac_p) of the linear and the rank IC."""
    out = None
    for name, rank in (("pearson", False), ("spearman", True)):
        series = ic_series(df, signal, target, rank=rank)
        hac = newey_west(series, "ic", lags).select(F.col("se").alias("hac_se"), F.col("t").alias("hac_t"), F.col("p").alias("hac_p"))
        s = ic_stats(series).join(F.broadcast(hac))
        row = s.select(
            F.lit(name).alias("correlation"), F.col("n_bars").alias("n"), F.col("ic_mean").alias("mean"), F.col("ic_paper").alias("absolute_mean"), F.col("ic_abs_mean").alias("mean_absolute"), F.col("ic_std").alias("std"),
            "icir", (F.col("icir") * per_year**0.5).alias("annual_icir"), (F.col("icir") * F.sqrt("n_bars")).alias("t"), "win_rate", "hac_se", "hac_t", "hac_p",
        )
        out = row if out is None else out.unionByName(row)
    return out


def path_means(series: DataFrame, groups: int = 10, tests: int = 2, horizon: int = 1, embargo: float = 0.01) -> DataFrame:
    """(trial, path, mean): each trial's mean over the test bars of each combinatorial purged path. ``series``: (trial, t_idx, v)."""
    series = written(series)  # a row a trial and bar: it is made once, not again for its last bar
    bars = (series.agg(F.max(T)).first()[0] or 0) + 1
    paths = purged_paths(series.sparkSession, bars, groups, tests, horizon, embargo).where("role = 'test'").select("path", T)
    return series.where("v IS NOT NULL").join(F.broadcast(paths), T).groupBy("trial", "path").agg(F.avg("v").alias("mean"))


def path_summary(means: DataFrame) -> dict[str, float | str]:
    """Best trial by mean over paths, probability of overfitting over the paths that all trials have, deflated Sharpe of the best. A row a trial and path is collected."""
    pdf = means.toPandas().pivot(index="path", columns="trial", values="mean").sort_index()
    if pdf.shape[1] < 2:
        return {"trials": pdf.shape[1]}
    whole = pdf.dropna()
    best = pdf.mean().idxmax()
    own = pdf[best].dropna().to_numpy()
    sharpe = (pdf.mean() / pdf.std(ddof=1)).to_numpy()
    pbo = inference.overfit_probability(whole.to_numpy(), 10) if len(whole) >= 10 else float("nan")
    return {"trials": pdf.shape[1], "paths": len(whole), "best": str(best), "mean": float(pdf[best].mean()), "pbo": pbo, "deflated": inference.deflated_sharpe(own, pdf.shape[1], float(np.nanvar(sharpe, ddof=1)))}


def frozen_set(ic: DataFrame, cut: int, k: int, least_ic: float = 0.05, least_icir: float = 0.5) -> DataFrame:
    """(factor, train_ic, train_icir, place, test_ic, test_icir): k factors chosen on the bars before ``cut``, judged on those from it on.

    ``ic``: (factor, t_idx, ic). Those that reach both thresholds come first, the others after them, by absolute mean IC.
    """
    train = library.top_k(ic_stats(ic.where(F.col(T) < cut), "factor"), k, least_ic, least_icir).select("factor", F.col("ic_paper").alias("train_ic"), F.abs("icir").alias("train_icir"), "passed")
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("passed"), F.desc("train_ic"), "factor"))  # k rows
    test = ic_stats(ic.where(F.col(T) >= cut), "factor").select("factor", F.col("ic_paper").alias("test_ic"), F.abs("icir").alias("test_icir"))
    return train.withColumn("place", place).join(test, "factor", "left").drop("passed")


def facts_on_panel(bars: DataFrame, facts: DataFrame, concepts: list[str], asset: str = "asset_id", time: str = "datetime", filed: str = "filed", value: str = "value", order: str | None = None) -> DataFrame:
    """``bars`` with a column for each concept: the value last filed at the bar or before. ``facts``: (asset, filed, concept, value)."""
    from tessera.operators.preparing import as_of

    out = bars
    for c in concepts:
        own = facts.where(F.col("concept") == c).withColumnRenamed(value, c).drop("concept")
        out = as_of(out, own, c, order=order)
    return out


def score_vector(ic_by_horizon: dict[str, np.ndarray], turnover: float, redundancy: float, residual_ic: float = 0.0, rank_gain: float = 0.0, shrink: float = 1.0, z: float = 1.0, redundancy_penalty: float = 0.5, turnover_penalty: float = 0.1, seed: int = 42) -> dict[str, float]:
    """A research score from one IC series a horizon (a number a bar).

    A horizon's mean absolute IC is lowered by ``shrink`` bootstrap errors, not below 0; the score is their mean less
    penalties, with a bonus for what lies outside the library (half the residual IC, a twentieth of the rank gained).
    The bound is the least over horizons of the mean less ``z`` errors; consistency is the share of the commoner sign.
    """
    shrunk, bounds, signs = [], [], []
    for x in ic_by_horizon.values():
        x = x[np.isfinite(x)]
        if not len(x):
            continue
        rng = np.random.default_rng(seed)
        block = max(1, min(20, len(x) // 10))
        at = (rng.integers(0, len(x), (200, -(-len(x) // block)))[:, :, None] + np.arange(block)).reshape(200, -1)[:, : len(x)] % len(x)
        error = float(np.abs(x[at]).mean(1).std(ddof=1))
        mean = float(np.abs(x).mean())
        shrunk.append(max(mean - shrink * error, 0.0))
        bounds.append(mean - z * error)
        signs.append(np.sign(x.mean()))
    if not shrunk:
        return {"score": 0.0, "bound": 0.0, "consistency": 0.0, "slope": 0.0}
    score = float(np.mean(shrunk)) - redundancy_penalty * redundancy - turnover_penalty * turnover + 0.5 * residual_ic + 0.05 * max(rank_gain, 0.0)
    slope = float(np.polyfit(range(len(shrunk)), shrunk, 1)[0]) if len(shrunk) > 1 else 0.0
    return {"score": score, "bound": min(bounds), "consistency": float(max(np.mean(np.array(signs) > 0), np.mean(np.array(signs) < 0))), "slope": slope}


def research_admission(score: dict[str, float], redundancy: float, residual_ic: float, span_gain: float, rank_gain: float, limit: float = 0.5, least_score: float = 0.02, least_bound: float = 0.0, least_gain: float = 0.1, least_rank: float = 0.0) -> tuple[bool, str]:
    """Whether a research score is enough, directly or because the factor reaches outside the library, and why."""
    if score["score"] < least_score:
        return False, "score"
    if score["bound"] < least_bound:
        return False, "bound"
    if redundancy < limit:
        return True, "direct"
    if residual_ic >= least_score and span_gain >= least_gain and rank_gain >= least_rank:
        return True, "outside the span"
    return False, "redundant"


def effective_rank(g: np.ndarray) -> float:
    """exp of the entropy of the spectrum of a Gram matrix."""
    v = np.maximum(np.linalg.eigvalsh(g), 0) if len(g) else np.zeros(0)
    if v.sum() <= 0:
        return 0.0
    p = v[v > 0] / v.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def validation_chain(wide: DataFrame, factors: list[str], labels: DataFrame, target: str = "target", level: float = 0.05) -> DataFrame:
    """(factor, score, regimes, net, adjusted, outcome): causal, regime, capacity and bootstrap tests in turn; the first that fails is the outcome.

    ``labels``: (t_idx, regime). A factor needs two regimes with a mean absolute IC of 0.01, a positive net return at the
    smallest capital, and a sign-flip p-value that stands after the step-up adjustment over those that are left.
    """
    rows, left = {}, []
    for f in factors:
        score = causal.robustness(wide, f, target)
        per = metrics.regime_ic(ic_series(wide, f, target), labels).where("n >= 3 AND ic_abs_mean >= 0.01").count()
        net = portfolio.capacity(wide, f, target, capitals=(1e3,)).first().net
        rows[f] = [f, float(score["score"]), int(per), float(net) if net is not None else 0.0, None, "causal" if not score["passes"] else "regime" if per < 2 else "capacity" if not (net or 0) > 0 else ""]
        if not rows[f][-1]:
            left.append(f)
    p = {f: inference.sign_flip(inference.series(ic_series(wide, f, target), "ic")) for f in left}
    for place, f in enumerate(ordered := sorted(p, key=p.get)):
        rows[f][4] = float(min(min(p[g] * len(p) / (i + 1) for i, g in enumerate(ordered) if i >= place), 1.0))
        rows[f][5] = "kept" if rows[f][4] <= level else "significance"
    return wide.sparkSession.createDataFrame([tuple(r) for r in rows.values()], "factor string, score double, regimes int, net double, adjusted double, outcome string")


def stable_digest(payload) -> str:
    """SHA-256 of a value as JSON with sorted names."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def regime_forecast(labels: DataFrame, features: tuple[str, ...] = ("roll_mean", "roll_vol")) -> DataFrame:
    """(t_idx, regime, forecast): the next bar's regime by a multinomial logistic fit on scaled features of this bar."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.sql import Window

    rows = labels.withColumn("next", F.lead("regime").over(Window.orderBy(T))).where(" AND ".join(f"{f} IS NOT NULL" for f in features))
    known = rows.where("next IS NOT NULL")
    index = StringIndexer(inputCol="next", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(known)
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-3)]
    fit = Pipeline(stages=stages).fit(index.transform(known))
    out = IndexToString(inputCol="prediction", outputCol="forecast", labels=[*index.labels, "__unknown"]).transform(fit.transform(rows))
    return out.select(T, "regime", "forecast")
