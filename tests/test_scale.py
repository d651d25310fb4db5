"""Results of the steps that were made to grow with their input, against plain definitions on small tables."""

from __future__ import annotations

import itertools
import math
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.catalog.base import QUERIES, SQL
from tessera.operators import evidence as E
from tessera.operators import library as L
from tessera.operators import metrics as M
from tessera.operators import models as D
from tessera.operators import portfolio as P
from tessera.operators import research as S
from tessera.operators import retrieval as V
from tessera.sources.panels import dense


def test_comomentum_by_pairs_without_pairs_as_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(f"a{i:02d}", t, float(rng.normal()), None if rng.random() < 0.2 or (i == 3 and t < 6) else 0.5 if i == 7 else float(rng.normal())) for i in range(40) for t in range(14)]
    df = spark.createDataFrame(rows, "asset_id string, t_idx int, signal double, returns double")
    w = P.leg_weights(df).toPandas()
    r = df.toPandas().pivot(index="t_idx", columns="asset_id", values="returns")
    e = r.sub(r.mean(axis=1), axis=0)
    want = {}
    for end in range(8, 14, 2):
        found = []
        for sign in (1, -1):
            leg = w[(w.t_idx == end) & (np.sign(w.w) == sign)].asset_id
            for a, b in itertools.combinations(sorted(leg), 2):
                both = e.loc[end - 7 : end, [a, b]].dropna()
                if len(both) >= 3:
                    found.append(both[a].corr(both[b]))
        want[end] = np.mean(found)
    got = P.comomentum(df, window=8)
    assert {x.end: pytest.approx(x.comomentum) for x in got.collect()} == want
    try:
        P.LEG_ASSETS, kept = 3, P.LEG_ASSETS  # a leg in several parts
        assert {x.end: pytest.approx(x.comomentum) for x in P.comomentum(df, window=8).collect()} == want
    finally:
        P.LEG_ASSETS = kept


def test_distance_correlation_without_matrices(spark):
    def plain(x, y):
        def centred(v):
            d = np.abs(v[:, None] - v[None])
            return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

        a, b = centred(x), centred(y)
        low = np.sqrt((a * a).mean() * (b * b).mean())
        return np.sqrt(max((a * b).mean(), 0) / low) if low > 1e-12 else 0.0

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 8, 33, 100):
        for x, y in ((rng.normal(size=n), rng.normal(size=n)), (np.round(rng.normal(size=n)), np.round(rng.normal(size=n))), (np.ones(n), rng.normal(size=n))):
            assert L.distance_correlation(x, y) == pytest.approx(plain(x, y), abs=1e-9)
    x, y = rng.normal(size=100_000), rng.normal(size=100_000)  # whose matrices would take 80 GB each
    assert 0 < L.distance_correlation(x, y) < 0.02


def test_profile_in_one_pass_over_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(f"a{i}", t, float(np.round(rng.normal(), 1)), None if rng.random() < 0.2 else float(rng.normal())) for i in range(12) for t in range(6)]
    wide = spark.createDataFrame(rows, "asset_id string, t_idx int, p double, q double")
    got = S.dependence_profile(L.wide_pairs(wide, ["q", "p"]))
    r = got.first()
    for m in ("distance", "pearson", "spearman"):
        own = L.dependence(L.long_form(wide, ["p", "q"]), m, 5).first()
        assert (own.a, own.b) == (r.a, r.b) == ("p", "q") and own.rho == pytest.approx(r[m])
    # rows meet once, by pair and bar, not by cell and once more for each measure
    assert got._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_linkage_goes_as_the_greedy_merges_do():
    def greedy(gap):
        gap, alive, groups = gap + np.diag([np.inf] * len(gap)), list(range(len(gap))), [[i] for i in range(len(gap))]
        while len(alive) > 1:
            i, j = sorted(divmod(int(np.argmin(gap[np.ix_(alive, alive)])), len(alive)))
            a, b = alive[i], alive[j]
            groups[a] += groups[b]
            gap[a] = gap[:, a] = np.minimum(gap[a], gap[b])
            gap[a, a] = np.inf
            alive.pop(j)
        return groups[alive[0]]

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 20, 80):
        d = rng.integers(0, 6, (n, n)).astype(float)  # many ties
        d = np.triu(d, 1) + np.triu(d, 1).T
        assert P.single_linkage(d.copy()) == greedy(d)


def test_equal_shares_of_many_assets():
    x = np.random.default_rng(1).normal(size=(250, 83))
    c = P.definite(np.cov(np.concatenate([x, x, x, x])))
    began = time.process_time()
    w = P.risk_parity(c, rounds=40)  # damped steps alone take more than 40 rounds here
    share = w * (c @ w)
    assert np.ptp(share) < 1e-9 * share.sum() and (w > 0).all() and w.sum() == pytest.approx(1)
    assert time.process_time() - began < 300


def test_close_vectors_by_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    m = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), base * 3.0])
    rows = [(int(i), [float(e) for e in v]) for i, v in enumerate(m)] + [(900, [0.0] * 8), (901, None), (902, [1.0, None, *[0.0] * 6]), (903, [float(e) for e in m[0][:7]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {(i, j): pytest.approx(u[i] @ u[j]) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= 0.92}
    got = V.semantic_duplicates(df)
    assert {(r.a, r.b): r.score for r in got.collect()} == want and len(want) >= 90
    # blocks meet, not vectors: no join compares them one by one
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_grid_without_joins_of_grids(spark):
    rows = [("a", 2, 1.0), ("a", 4, 2.0), ("b", 1, None), ("c", None, 3.0), (None, 3, 4.0), ("d", 1, 5.0), ("d", 2, 6.0), ("d", 4, 7.0), ("d", 3, 8.0)]
    panel = spark.createDataFrame(rows, "asset_id string, datetime int, v double")
    want = {(a, i): {(x, y): z for x, y, z in rows}.get((a, t)) if a else None for a in ("a", "b", "c", "d", None) for i, t in enumerate((1, 2, 3, 4))}
    for unique in (True, False):
        got = dense(panel, unique=unique)
        found = got.collect()
        assert len(found) == 20 and {(r.asset_id, r.t_idx): r.v for r in found} == want and all(r.datetime == r.t_idx + 1 for r in found)
    # the panel moves by asset; only the calendar is joined, as a broadcast
    plan = dense(panel, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(asset_id") == 1


@pytest.mark.parametrize("name", ["op_CumMax", "op_CumMin"])
def test_running_extremes_of_late_assets_equal_sql(spark, tmp_path, name):
    c = duckdb.connect()
    li = "/root/testdata/sf0.001/lineitem.parquet"
    c.sql(f"COPY (SELECT * FROM '{li}' WHERE NOT (l_suppkey % 3 = 0 AND l_shipdate < TIMESTAMP '1996-06-01')) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = sorted((r.asset_id, r.t_idx, r.v) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(SQL[name]).fetchall()) and sum(math.isinf(v) for _, _, v in got) > 50


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_legs_carry_their_columns_and_sort_once(spark, wide):
    plan = _plan(P.capacity(wide, "f"))
    assert "Join" not in plan and plan.count("row_number()") >= 1 and plan.count("Sort [") == 1
    pdf, want = wide.toPandas(), {}
    for t, b in pdf.dropna(subset=["f"]).groupby("t_idx"):
        b = b.sort_values(["f", "asset_id"])
        k = int(min(max(1, len(b) * 0.2 // 1), len(b) // 2))
        for sign, own in ((-1, b[:k]), (1, b[-k:])):
            want |= {(t, a, y): sign / k for a, y in zip(own.asset_id, own.target)} if k else {}
    got = P.leg_weights(wide, "f", 0.2, F.col("target").alias("y")).toPandas()
    assert {(t, a, y): w for t, a, y, w in zip(got.t_idx, got.asset_id, got.y, got.w)} == want
    ls = {r.t_idx: r.ls for r in M.legs(wide, "f").collect()}
    for t, b in pdf.dropna().groupby("t_idx"):
        b, k = b.sort_values(["f", "asset_id"]), int(min(max(1, len(b) * 0.2 // 1), len(b) // 2))
        assert ls[t] == pytest.approx(b.target[-k:].mean() - b.target[:k].mean())


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    rows = [(f"a{i:02d}", t, None if rng.random() < 0.1 else float(np.round(rng.normal(), 1)), float(rng.normal()), float(rng.normal()), float(rng.uniform(1, 5))) for i in range(25) for t in range(20)]
    return spark.createDataFrame(rows, "asset_id string, t_idx int, f double, g double, target double, amount double").cache()


def test_gram_from_aggregates_alone(spark, wide):
    pdf = wide.toPandas()[["f", "g", "target"]]
    z = (pdf - pdf.mean()).fillna(0.0).to_numpy()
    names, g = L.gram(wide, ["target", "f", "g"])
    assert names == ["f", "g", "target"] and np.allclose(g, z.T @ z)


def test_paths_make_their_series_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        made.add(1)
        yield from batches

    base = spark.range(0, 40, numPartitions=1).selectExpr("'x' AS trial", "cast(id AS int) AS t_idx", "cast(id AS double) AS v")
    E.path_means(base.mapInPandas(count, "trial string, t_idx int, v double")).collect()
    assert made.value == 1


def test_ranking_rounds_move_no_rows(spark, wide):
    pdf = wide.dropna().toPandas()
    z = pdf.groupby("t_idx").target.transform(lambda v: (v - v.mean()) / v.std(ddof=0))
    q = np.exp(z) / np.exp(z).groupby(pdf.t_idx).transform("sum")
    beta = np.zeros(2)
    for _ in range(3):
        e = np.exp(pdf[["f", "g"]].to_numpy() @ beta)
        p = e / pd.Series(e, pdf.index).groupby(pdf.t_idx).transform("sum")
        beta = beta + ((q - p).to_numpy()[:, None] * pdf[["f", "g"]].to_numpy()).sum(0) / pdf.t_idx.nunique()
    assert np.allclose(D.ranking(wide, ["f", "g"], rounds=3), beta)
    kept, files = D.written, []
    try:
        D.written = lambda df: files.append(1) or kept(df)
        D.ranking(wide, ["f", "g"], loss="bpr", rounds=2)
    finally:
        D.written = kept
    assert files == [1]


def test_factors_take_their_target_along(spark, wide):
    got = L.long_form(wide, ["f", "g"], "target")
    assert "Join" not in _plan(got) and got.columns == ["factor", "asset_id", "t_idx", "v", "target"]
    joined = L.long_form(wide, ["f", "g"]).join(wide.select("asset_id", "t_idx", "target"), ["asset_id", "t_idx"]).select(*got.columns)
    assert sorted(got.collect()) == sorted(joined.collect())


def test_neighbours_of_repeated_edges(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (4, 3), (5, 6), (2, None)], "a long, b long")
    got = V.neighbours(e, 1, 3)
    assert {(r.node, r.hop) for r in got.collect() if r.node is not None} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    # one step doesn't make the doubled edges distinct
    assert {(r.node, r.root) for r in V.connected(e.where("b IS NOT NULL")).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)}


def test_rerank_reads_texts_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        made.add(1)
        yield from batches

    hits = spark.createDataFrame([(1, "the fox", 2.0), (2, "a dog", 1.0), (3, None, 0.5)], "id long, text string, bm25 double").coalesce(1)
    rows = V.rerank(hits.mapInPandas(count, hits.schema), "the dog").collect()
    assert made.value == 1 and [r.id for r in rows] == [1, 2, 3]
    assert [r.score for r in rows] == pytest.approx([0.45 / 3 + 0.4 + 0.075, 0.45 / 3 + 0.2 + 0.075, 0.1])
