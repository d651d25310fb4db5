"""Models over factors: boosted trees, ranking losses, permutation importance and held-out Sharpe."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.causal import uniform
from tessera.operators.library import KEYS
from tessera.operators.metrics import T, ic_series, ic_stats, legs, performance
from tessera.operators.research import _square, normal_equations, solve
from tessera.sources.store import written


def _cut(wide: DataFrame, share: float) -> float:
    return wide.agg(F.percentile(T, share)).first()[0] or 0.0


def boosted(wide: DataFrame, factors: list[str], target: str = "target", trees: int = 20, depth: int = 3, seed: int = 42) -> dict[str, float]:
    """Importance of factors in gradient-boosted trees over complete rows; they sum to 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = wide.select(*[F.col(f).cast("double") for f in factors], F.col(target).cast("double").alias("label")).na.drop()
    data = VectorAssembler(inputCols=factors, outputCol="features").transform(rows)
    fit = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(data)
    return dict(zip(factors, map(float, fit.featureImportances.toArray()), strict=True))


def ridge(wide: DataFrame, factors: list[str], target: str = "target", strength: float = 1e-2) -> np.ndarray:
    """Intercept and coefficients over complete rows, from one aggregate."""
    row = normal_equations(wide.select(*factors, target).na.drop(), factors, target).first()
    return solve(_square(row.s, len(factors) + 2), strength) if row and row.s and row.s[0] is not None else np.zeros(len(factors) + 1)


def ranking(wide: DataFrame, factors: list[str], target: str = "target", loss: str = "listnet", rounds: int = 15, rate: float = 1.0) -> np.ndarray:
    """Coefficients of a linear score by a ranking loss; a round is one aggregate over all bars.

    listnet compares a bar's softmax of scores with that of its standardised targets; bpr and margin take each asset
    with the next one in the order of targets, with a logistic and a hinge loss.
    """
    by = Window.partitionBy(T)
    rows = wide.select(*KEYS, *factors, F.col(target).alias("y")).na.drop()
    spread = F.stddev_pop("y").over(by)
    rows = rows.withColumn("z", (F.col("y") - F.avg("y").over(by)) / F.when(spread > 0, spread).otherwise(1.0))
    if loss == "listnet":
        rows = rows.withColumn("q", F.exp("z") / F.sum(F.exp("z")).over(by))
    elif loss in ("bpr", "margin"):
        order = by.orderBy("y", "asset_id")
        rows = rows.select(T, *[(F.lead(f).over(order) - F.col(f)).alias(f) for f in factors]).na.drop()
    else:
        raise ValueError("loss is listnet, bpr or margin")
    # rounds read the rows from the shared folder; a bar's softmax is a quotient of its sums, so no round moves rows
    rows = written(rows.select(T, *factors, *(["q"] if loss == "listnet" else [])))
    beta = np.zeros(len(factors))
    for _ in range(rounds):
        score = sum((F.col(f) * float(b) for f, b in zip(factors, beta, strict=True)), F.lit(0.0))
        per = rows.withColumn("s", score)
        if loss == "listnet":
            sums = [e for i, f in enumerate(factors) for e in (F.sum(F.col("q") * F.col(f)).alias(f"a{i}"), F.sum(F.exp("s") * F.col(f)).alias(f"b{i}"))]
            bars = per.groupBy(T).agg(F.sum(F.exp("s")).alias("z"), *sums)
            row = bars.agg(*[F.avg(F.col(f"a{i}") - F.col(f"b{i}") / F.col("z")).alias(f"g{i}") for i in range(len(factors))]).first()
        else:
            weight = 1 / (1 + F.exp("s")) if loss == "bpr" else (F.col("s") < 1).cast("double")
            row = per.withColumn("w", weight).agg(*[F.avg(F.col("w") * F.col(f)).alias(f"g{i}") for i, f in enumerate(factors)]).first()
        beta = beta + rate * np.array([row[f"g{i}"] or 0.0 for i in range(len(factors))])
    return beta


def scored(wide: DataFrame, factors: list[str], beta: np.ndarray, name: str = "fit") -> DataFrame:
    """``wide`` with a linear score; ``beta`` has an intercept or none."""
    own = beta[-len(factors) :]
    return wide.withColumn(name, sum((F.col(f) * float(b) for f, b in zip(factors, own, strict=True)), F.lit(float(beta[0]) if len(beta) > len(factors) else 0.0)))


def permutation_importance(wide: DataFrame, factors: list[str], beta: np.ndarray, target: str = "target", seed: int = 42) -> DataFrame:
    """(factor, ic, drop): rank IC of a linear score when one factor's values change places within each bar, and the loss against the whole score.

    Values are dealt by the order of a digest of asset and bar; all factors are scored in one job.
    """
    by = Window.partitionBy(T)
    rows = wide.select(*KEYS, *factors, target).na.drop()
    draw = uniform(seed, F.col("asset_id"), F.col(T))
    rows = rows.withColumns({"__i": F.row_number().over(by.orderBy("asset_id")), "__j": F.row_number().over(by.orderBy(draw, "asset_id"))})
    other = rows.select(T, F.col("__j").alias("__i"), *[F.col(f).alias(f"__{f}") for f in factors])
    both = scored(rows.join(other, [T, "__i"]), factors, beta)
    own = beta[-len(factors) :]
    cases = [F.struct(F.lit("").alias("factor"), F.col("fit").alias("s"))] + [F.struct(F.lit(f).alias("factor"), (F.col("fit") + (F.col(f"__{f}") - F.col(f)) * float(b)).alias("s")) for f, b in zip(factors, own, strict=True)]
    each = both.select("asset_id", T, target, F.explode(F.array(*cases)).alias("c")).select("asset_id", T, target, "c.factor", "c.s")
    got = ic_stats(ic_series(each, "s", target, keys=("factor",)), "factor").select("factor", F.col("ic_mean").alias("ic"))
    whole = got.where("factor = ''").select(F.col("ic").alias("whole"))
    return got.where("factor <> ''").join(F.broadcast(whole)).select("factor", "ic", (F.col("whole") - F.col("ic")).alias("drop"))


def held_out(wide: DataFrame, factors: list[str], target: str = "target", share: float = 0.6, per_year: int = 252) -> DataFrame:
    """(model, ic, sharpe) of models that learn on the earlier bars, judged by rank IC and long-short returns on the later ones."""
    cut = _cut(wide, share)
    early, late = wide.where(F.col(T) <= cut), wide.where(F.col(T) > cut)
    models = {"ridge": ridge(early, factors, target), "listnet": ranking(early, factors, target), "bpr": ranking(early, factors, target, "bpr"), "equal": np.ones(len(factors))}
    out = None
    for name, beta in models.items():
        s = scored(late, factors, beta)
        row = ic_stats(ic_series(s, "fit", target)).select(F.lit(name).alias("model"), F.col("ic_mean").alias("ic")).join(F.broadcast(performance(legs(s, "fit", target), "ls", per_year).select("sharpe")))
        out = row if out is None else out.unionByName(row)
    return out
