from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.catalog.panel import quintile_backtest
from tessera.operators import causal as C
from tessera.operators import evidence as E
from tessera.operators import lifecycle as Y
from tessera.operators import library as L
from tessera.operators import models as D
from tessera.operators import retrieval as V
from tessera.operators.inference import newey_west, two_sided


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(60):
        a, b = rng.normal(size=30), rng.normal(size=30)
        y = 0.8 * a + 0.1 * rng.normal(size=30)
        rows += [(f"a{i:02d}", t, float(a[i]), float(b[i]), float(y[i])) for i in range(30)]
    return spark.createDataFrame(rows, "asset_id string, t_idx int, good double, noise double, target double").cache()


def test_two_sided_p(spark, panel):
    z = [0.0, 0.5, -1.96, 3.3, 6.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(two_sided(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], abs=2e-7)
    assert 0 <= newey_west(panel.groupBy("t_idx").agg(F.avg("noise").alias("v")), "v").first().p <= 1


def test_life_of_series(spark):
    series = {"gone": [0.1, 0.08, 0.05, 0.02, 0.0, -0.01], "calm": [0.05, 0.06, 0.05, 0.06], "few": [0.1, None, 0.2], "fading": [0.10, 0.09, 0.08, 0.07, 0.06, 0.05]}
    ic = spark.createDataFrame([(k, t, v) for k, x in series.items() for t, v in enumerate(x)], "factor string, t_idx int, ic double")
    got = {r.factor: r for r in Y.life_curve(ic, "factor").collect()}
    assert {k: r.state for k, r in got.items()} == {"gone": "decayed", "calm": "stable", "few": "insufficient_data", "fading": "decaying"}
    assert got["few"].ic_first == 0.1 and got["few"].ic_last == 0.2 and got["fading"].half_life == pytest.approx(0.09 / 0.02)
    hyper = spark.createDataFrame([("h", t, 0.2 / (1 + 0.1 * t)) for t in range(12)] + [("f", 0, 0.1)], "factor string, t_idx int, ic double")
    fit = {r.factor: r for r in Y.hyperbolic_fit(hyper, "factor").collect()}
    assert (fit["h"].k, fit["h"].rate, fit["h"].half_life, fit["h"].r2) == pytest.approx((0.2, 0.1, 10, 1)) and fit["f"].k == 0
    risks = spark.createDataFrame([("Trend/Momentum", 5.0), ("Trend/Momentum", None), ("Volatility/Risk", 5.0), ("Volatility/Risk", 50.0)], "m string, h double").select(Y.crowding_risk(F.col("m"), F.col("h")).alias("r"))
    assert [r.r for r in risks.collect()] == ["high_crowding_decay_risk", "elevated_crowding_decay_risk", "decay_watch", "low_crowding_decay_risk"]


def test_granger_by_simulation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = np.concatenate(([0.0], 0.6 * x[:-1])) + 0.5 * rng.normal(size=300)
    assert min(p for _, _, p in C.granger_lags(y, x)) < 1e-6 and min(p for _, _, p in C.granger_lags(x, y)) > 0.001
    # what leads stays so beside an idle control, and has nothing to add beside itself
    assert min(p for _, _, p in C.granger_lags(y, x, rng.normal(size=300))) < 1e-6 and C.granger_lags(y, x + 1e-3 * rng.normal(size=300), x)[0][2] > 1e-4
    assert C.f_tail(4.0, 1, 10**6) == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-4) and C.f_tail(1.0, 7, 7) == pytest.approx(0.5, abs=1e-6)


def test_interventions_and_robustness(panel):
    got = {r.scenario: r for r in C.interventions(panel, "good").collect()}
    assert set(got) == {"volume", "volatility", "liquidity"} and got["volume"].ratio == pytest.approx(1.0) and got["volatility"].ratio < got["liquidity"].ratio < 1
    r = C.robustness(panel, "good")
    assert 0 <= r["score"] <= 1 and 0 <= r["p"] <= 1
    assert C.granger_test(panel.where("t_idx < 5"), "good") == (1.0, 0.0)


def test_models_find_the_good_factor(panel):
    boosted = D.boosted(panel, ["good", "noise"], trees=5)
    assert boosted["good"] > 0.8
    for loss in ("listnet", "bpr", "margin"):
        beta = D.ranking(panel, ["good", "noise"], loss=loss, rounds=5)
        assert beta[0] > 3 * abs(beta[1]), loss
    drop = {r.factor: r["drop"] for r in D.permutation_importance(panel, ["good", "noise"], D.ridge(panel, ["good", "noise"])).collect()}
    assert drop["good"] > 0.5 > abs(drop["noise"])
    held = {r.model: r for r in D.held_out(panel, ["good", "noise"]).collect()}
    assert held["ridge"].ic > 0.9 and held["ridge"].sharpe > held["equal"].sharpe


def test_splits_paths_and_frozen_sets(spark, panel):
    assert [tuple(r) for r in E.rolling_splits(spark, 10, 4, 2, 2).collect()] == [(0, 0, 4, 4, 6), (1, 2, 6, 6, 8), (2, 4, 8, 8, 10)]
    assert E.rolling_splits(spark, 5, 4, 2).count() == 0 and tuple(E.contiguous_split(spark, 10).first()) == (0, 0, 7, 7, 10)
    trials = spark.createDataFrame([(k, t, v + 0.01 * (t % 3)) for k, v in (("best", 0.1), ("other", 0.0), ("last", -0.1)) for t in range(40)], "trial string, t_idx int, v double")
    s = E.path_summary(E.path_means(trials))
    assert s["best"] == "best" and s["paths"] == 45 and s["pbo"] == 0.0
    ic = spark.createDataFrame([(f, t, v + 0.001 * (t % 2)) for f, v in (("x", 0.1), ("y", 0.02), ("z", 0.06)) for t in range(20)], "factor string, t_idx int, ic double")
    assert [r.factor for r in E.frozen_set(ic, 10, 2).orderBy("place").collect()] == ["x", "z"]


def test_research_scores_and_geometry():
    rng = np.random.default_rng(1)
    strong = E.score_vector({"h1": 0.1 + 0.01 * rng.normal(size=80)}, 0.1, 0.1)
    assert E.research_admission(strong, 0.1, 0, 0, 0) == (True, "direct") and E.research_admission(strong, 0.9, 0.0, 0, 0)[1] == "redundant"
    assert E.research_admission(strong, 0.9, 0.1, 0.5, 1.0) == (True, "outside the span") and not E.research_admission(E.score_vector({}, 0, 0), 0, 0, 0, 0)[0]
    v = rng.normal(size=(4, 500))
    v[3] = v[2] + 0.1 * v[1]
    g = v @ v.T
    assert E.effective_rank(np.eye(3)) == pytest.approx(3) and L.residual_alignment(g, [0], 2, 3) == pytest.approx(abs(np.corrcoef(v[2], v[3])[0, 1]), abs=0.02)
    assert E.stable_digest({"b": 1, "a": 2}) == E.stable_digest({"a": 2, "b": 1})


def test_chain_and_forecast(spark, panel):
    labels = panel.select("t_idx").distinct().select("t_idx", F.when(F.col("t_idx") % 20 < 10, "BULL").otherwise("BEAR").alias("regime"), (F.col("t_idx") % 20 / 20.0).alias("roll_mean"), F.lit(1.0).alias("roll_vol"))
    got = {r.factor: r.outcome for r in E.validation_chain(panel.withColumn("amount", F.lit(1e6)), ["good", "noise"], labels).collect()}
    assert got["good"] in ("kept", "causal") and got["noise"] != "kept"
    f = E.regime_forecast(labels)
    assert f.count() == 60 and f.where("forecast = 'BULL' OR forecast = 'BEAR'").count() == 60


def test_exact_ranks_without_a_single_sort(spark):
    rows = [(i, float((i * 7919) % 50)) for i in range(500)]
    got = {r.id: r.place for r in V.ranked(spark.createDataFrame(rows, "id long, score double"), parts=7).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert V.ranked(spark.createDataFrame(rows[:1], "id long, score double")).first().place == 1


def test_backtest_reads_its_signal_once(spark):
    plan = quintile_backtest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2


def test_extended_pairs_are_only_the_new(panel):
    v = L.long_form(panel, ["good", "noise", "target"])
    assert {(r.a, r.b) for r in L.dependence(v, new=["target"]).collect()} == {("good", "target"), ("noise", "target")}
    whole = {(r.a, r.b): round(r.rho, 9) for r in L.dependence(v).collect()}
    assert {(r.a, r.b): round(r.rho, 9) for r in L.extend(L.dependence(v.where("factor <> 'target'")), v, ["target"]).collect()} == whole
