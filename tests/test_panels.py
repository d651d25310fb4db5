from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.catalog.base import QUERIES
from tessera.operators import inference as I
from tessera.operators import library as L
from tessera.operators import metrics as M
from tessera.operators import portfolio as P
from tessera.operators import preparing as R
from tessera.operators import retrieval as V
from tessera.sources.panels import canonical, dense, load
from tessera.sources.sinks import company_facts, mock_panel, save_library
from tessera.streaming.bars import tumbling
from tessera.streaming.regime import batch, stream

D = [dt.datetime(2024, 1, d) for d in range(1, 7)]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(D[i], a, 1.0 + i + k, 2.0 + i + k, 0.5 + i, 1.5 + i + k, 10.0 * i, 15.0 * i) for k, a in enumerate("xyz") for i in range(6) if (a, i) != ("y", 2)]
    return spark.createDataFrame(rows, "datetime timestamp_ntz, asset_id string, open double, high double, low double, close double, volume double, amount double")


def test_canonical_names_and_types(spark):
    raw = spark.createDataFrame([("2024-01-01", "A", "1", "2", "x", "NaN", "3", "4")], "Date string, Ticker string, Open string, High string, Low string, Close string, Vol string, Amt string")
    r = canonical(raw).first()
    assert r.datetime == dt.datetime(2024, 1, 1) and r.low is None and r.close is None and r.amount == 4.0
    with pytest.raises(ValueError):
        canonical(raw.drop("Close"))


def test_load_round_trip(spark, panel, tmp_path):
    save_library(panel, str(tmp_path / "p"), "parquet")
    panel.write.csv(str(tmp_path / "c"), header=True)
    got = load(spark, str(tmp_path / "p"), assets=["x"], start="2024-01-02", end="2024-01-04")
    assert got.count() == 3
    assert load(spark, str(tmp_path / "c"), kind="csv").count() == panel.count()


def test_dense_grid(panel):
    d = dense(panel.unionByName(panel.limit(1)))
    assert d.count() == 18 and d.where("close IS NULL").select("asset_id", "t_idx").collect() == [("y", 2)]


def test_targets_count_rows_not_bars(panel):
    y = R.with_targets(panel, [R.Target("n", 0, 1, "close_to_close")]).where("asset_id = 'y'").orderBy("datetime").collect()
    assert y[1].target_n == pytest.approx(y[2].close / y[1].close - 1) and y[-1].target_n is None
    with pytest.raises(ValueError):
        R.Target(holding=0).ends  # noqa: B018


def test_fill_limit_and_as_of(spark, panel):
    gaps = panel.withColumn("close", F.when(F.col("asset_id") != "x", F.col("close")))
    filled = R.fill(gaps, ["close"])
    assert filled.where("close IS NULL").count() == 0
    facts = spark.createDataFrame([("x", D[1], 1.0, 1), ("x", D[1], 2.0, 2), ("x", D[3], 9.0, 1)], "asset_id string, filed timestamp_ntz, f double, n int")
    got = [r.f for r in R.as_of(panel.where("asset_id = 'x'"), facts, "f", order="n").orderBy("datetime").collect()]
    assert got == [None, 2.0, 2.0, 9.0, 9.0, 9.0]


def test_validation_finds_planted_faults(panel):
    bad = panel.unionByName(panel.limit(1)).withColumn("high", F.when(F.col("datetime") == F.lit(D[5]), 0.0).otherwise(F.col("high")))
    r = R.validation_report(bad).first()
    assert r.repeated_keys == 1 and r.broken_bars == 3 and r.coverage == pytest.approx(17 / 18)
    assert R.leaky_columns(bad.withColumn("next_close", F.lit(1))) == ["next_close"]


def test_perfect_and_opposite_signals(spark):
    rng = np.random.default_rng(0)
    rows = [(f"a{i:02d}", t, float(x), float(x)) for t in range(12) for i, x in enumerate(rng.normal(size=20))]
    df = spark.createDataFrame(rows, "asset_id string, t_idx int, signal double, target double")
    s = M.ic_stats(M.ic_series(df)).first()
    assert s.ic_mean == pytest.approx(1) and s.win_rate == 1
    assert M.ic_stats(M.ic_series(df.withColumn("target", -F.col("target")), rank=False)).first().ic_mean == pytest.approx(-1)
    q = M.quantile_returns(df).first()
    assert q.monotonicity == pytest.approx(1) and q.long_short > 0
    assert M.ic_series(df.where("asset_id < 'a04'")).where("ic IS NOT NULL").count() == 0
    constant = M.ic_series(df.withColumn("signal", F.lit(1.0)))
    assert constant.select("ic").distinct().collect() == [(0.0,)]
    assert M.turnover(df.withColumn("signal", F.length("asset_id").cast("double"))).first().turnover == 0.0


def test_admission_and_replacement():
    rho = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2}
    inside, why = L.admit({"a": 0.08, "b": 0.06, "c": 0.05, "d": 0.01}, rho)
    assert inside == ["a", "c"] and why == {"b": "redundant with a", "d": "weak"}


def test_orthogonal_factors_are_orthogonal(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{i}", t, *map(float, rng.normal(size=3) + 1)) for i in range(10) for t in range(5)]
    wide = spark.createDataFrame(rows, "asset_id string, t_idx int, p double, q double, r double")
    o = L.orthogonal(L.long_form(wide, ["p", "q", "r"]), ["p", "q", "r"]).groupBy("asset_id", "t_idx").pivot("factor").sum("v").toPandas()[["p", "q", "r"]].to_numpy()
    g = o.T @ o
    assert abs(g - np.diag(np.diag(g))).max() < 1e-9


def test_inference():
    rng = np.random.default_rng(2)
    good, noise = rng.normal(0.3, 1, 300), rng.normal(0, 1, 300)
    assert I.sign_flip(good) < 0.01 < I.sign_flip(noise)
    m, lo, hi = I.block_bootstrap(good)
    assert lo < m < hi and lo > 0
    assert I.deflated_sharpe(good, 10, 0.01) > I.deflated_sharpe(noise, 10, 0.01)
    assert I.overfit_probability(np.stack([good, noise, -good], 1), 8) < 0.1
    assert I.wilcoxon(good + 1, good)[1] < 1e-6 and I.diebold_mariano(good + noise + 1, good)[1] < 1e-6


def test_portfolio_weights():
    c = np.diag([1.0, 4.0, 9.0])
    w = P.risk_parity(c)
    assert np.allclose(w * (c @ w), (w * (c @ w)).mean(), rtol=1e-4)
    assert P.hierarchical_parity(c).sum() == pytest.approx(1)
    assert P.capacity_limit([(1, 1.0), (2, 0.6), (3, 0.2)]) == pytest.approx(2.25)
    assert P.crowding(0.7, 0.4, True)[0] == "crowded"


def test_risk_weights_of_all_assets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 25)) * rng.uniform(0.1, 3, (60, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3, 1:] = np.nan
    df = spark.createDataFrame([(f"a{i:02}", t, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for t, v in enumerate(row)], "asset_id string, t_idx int, returns double")
    monkeypatch.setattr(P, "PAIR_ASSETS", 7)
    names, c = P.covariance(df)
    assert names == [f"a{i:02}" for i in range(60) if (~np.isnan(x[i])).any()]
    x = x[[int(a[1:]) for a in names]]
    for i in range(len(x)):
        for j in range(len(x)):
            both = ~np.isnan(x[i] + x[j])
            want = np.cov(x[i, both], x[j, both])[0, 1] if both.sum() > 1 else 0.0
            assert c[i, j] == pytest.approx(want, abs=1e-9)
    good = P.definite(c)
    w, h = P.risk_parity(good), P.hierarchical_parity(good)
    own = w * (good @ w)
    assert np.linalg.eigvalsh(c)[0] < 0 and np.allclose(own, own.mean(), rtol=1e-6) and (w > 0).all() and (h > 0).all() and h.sum() == pytest.approx(1)
    rows = QUERIES["risk_weights"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.asset_id for r in rows}) == len(rows) == 100 and sum(r.parity for r in rows) == pytest.approx(1)


def test_whole_graphs(spark, tmp_path):
    rows = [(s, p) for s in range(0, 40, 2) for p in (s * 5, s * 5 + 97, s * 5 + 194)] + [(1, 1), (1, 98), (3, 98), (3, 7), (5, 7), (5, 300), (8, 1), (None, 1), (1, None)]
    spark.createDataFrame([(*r, 1.0, 0.0) for r in rows], "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {}
    for s, p in rows:
        if s is not None and p is not None:
            near.setdefault(s, set()).add((1 << 40) + p)
            near.setdefault((1 << 40) + p, set()).add(s)

    def reach(start):
        hop, edge, k = {start: 0}, {start}, 0
        while edge:
            k += 1
            edge = {y for x in edge for y in near[x]} - hop.keys()
            hop.update(dict.fromkeys(edge, k))
        return hop

    got = {r.node: r.root for r in QUERIES["graph_components_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: min(reach(x)) for x in near} and len(set(got.values())) > 5
    got = {r.node: r.hop for r in QUERIES["graph_neighbours_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: h for x, h in reach((1 << 40) + 1).items() if h <= 2} and max(got.values()) == 2


def test_components_and_retrieval(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 10)], "a long, b long")
    assert {(r.node, r.root) for r in V.connected(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9), (10, 9)}
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, None), (4, "")], "doc_id long, text string")
    top = V.bm25(docs, "red fish").orderBy(F.desc("score")).collect()
    assert [r.id for r in top] == [1, 2]
    v = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate([0, 0.1, 1.5, 1.55, 3.0])], "vec_id long, embedding array<double>")
    assert {(r.a, r.b) for r in V.semantic_duplicates(v).collect()} == {(0, 1), (2, 3)}


def test_mock_panel_and_facts(spark, tmp_path):
    m = mock_panel(spark, 5, 30, halts=0.2)
    assert m.count() == 150 and R.flag_halts(m).where("is_halt").count() > 0
    assert R.validation_report(m).first().broken_bars == 0
    (tmp_path / "f.json").write_text('{"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"val": 5.5, "filed": "2024-02-01", "end": "2023-12-31", "form": "10-K"}]}}}}}')
    r = company_facts(spark, str(tmp_path / "f.json")).first()
    assert (r.cik, r.concept, r.value, str(r.filed)) == (7, "Revenues", 5.5, "2024-02-01")


def test_streams_give_what_tables_give(spark, tmp_path):
    rng = np.random.default_rng(3)
    for k in range(3):
        rows = [("m", 20 * k + i, float(x)) for i, x in enumerate(rng.normal(0, 0.01, 20))]
        spark.createDataFrame(rows, "market string, t long, ret double").coalesce(1).write.parquet(str(tmp_path / "bars" / f"k={k}"))
    src = spark.readStream.schema("market string, t long, ret double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "bars"))
    q = stream(src).writeStream.format("memory").queryName("regimes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    table = batch(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "bars")))
    assert spark.sql("SELECT count(*), max(t) FROM regimes").first() == (60, 59)
    assert table.count() == 60
    ev = spark.createDataFrame([(1, D[0], 1.0, 1), (1, D[0] + dt.timedelta(hours=1), 3.0, 2), (1, D[2], 2.0, 3)], "user_id long, ts timestamp_ntz, value double, event_id long")
    r = tumbling(ev).orderBy("datetime").first()
    assert (r.open, r.high, r.close, r.volume, r.amount) == (1.0, 3.0, 3.0, 2.0, 4.0)
