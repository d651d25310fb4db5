"""Queries of the library, portfolio, inference, retrieval and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.base import PANEL_M, q6, query, r6
from tessera.catalog.panel import _LEG, _SIGNAL_SQL, SIGNAL
from tessera.operators import inference as I
from tessera.operators import library as L
from tessera.operators import metrics as M
from tessera.operators import portfolio as P
from tessera.operators import preparing as R
from tessera.operators import research as S
from tessera.operators import retrieval as V
from tessera.plans.compiler import evaluate
from tessera.plans.formula import family, parse
from tessera.sources.panels import bars, dense, monthly, with_vwap_returns
from tessera.sources.store import stored
from tessera.streaming.bars import tumbling
from tessera.streaming.regime import batch

FACTORS = {"f1": SIGNAL, "f2": "CsRank(Neg(Delta($close, 1)))", "f3": "CsRank($volume)", "f4": "CsRank(Div(Sub($close, $low), Add(Sub($high, $low), 1)))"}
_RK = lambda c: f"CASE WHEN {c} IS NOT NULL THEN row_number() OVER (PARTITION BY t_idx, {c} IS NULL ORDER BY {c}, asset_id) / count({c}) OVER (PARTITION BY t_idx) END"
_F = f"""{_SIGNAL_SQL},
fa AS (SELECT asset_id, t_idx, -(close - lag(close) OVER (PARTITION BY asset_id ORDER BY t_idx)) AS a2, volume AS a3, CASE WHEN abs(high - low + 1) > 1e-10 THEN (close - low) / (high - low + 1) ELSE 0.0 END AS a4 FROM p),
fw AS (SELECT asset_id, t_idx, {_RK('a2')} AS f2, {_RK('a3')} AS f3, {_RK('a4')} AS f4 FROM fa),
fv AS (SELECT * FROM (SELECT 'f1' AS factor, asset_id, t_idx, signal AS v FROM s UNION ALL SELECT 'f2', asset_id, t_idx, f2 FROM fw UNION ALL SELECT 'f3', asset_id, t_idx, f3 FROM fw UNION ALL SELECT 'f4', asset_id, t_idx, f4 FROM fw) WHERE v IS NOT NULL),
pr AS (SELECT a.factor AS a, b.factor AS b, t_idx, asset_id, a.v AS x, b.v AS y FROM fv a JOIN fv b USING (t_idx, asset_id) WHERE a.factor < b.factor)"""
_CORR = "CASE WHEN var_pop(x) > 1e-20 AND var_pop(y) > 1e-20 AND abs(corr(x, y)) > 1e-12 THEN corr(x, y) ELSE 0.0 END"
_Z = "zs AS (SELECT factor, asset_id, t_idx, (v - avg(v) OVER b) / CASE WHEN stddev_pop(v) OVER b > 0 THEN stddev_pop(v) OVER b ELSE 1.0 END AS z FROM fv WINDOW b AS (PARTITION BY factor, t_idx))"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = R.with_targets(with_vwap_returns(monthly(spark, sf_dir)), [R.Target("paper"), *[R.Target(f"h{h}", 1, h, "close_to_close") for h in (1, 2, 3)]])
    return stored(spark, "monthly_factors", monthly(spark, sf_dir), lambda _: evaluate(dense(raw, unique=True), FACTORS).withColumnRenamed("target_paper", "target"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.long_form(wide(spark, sf_dir), list(FACTORS))


def dependence(spark: SparkSession, sf_dir: str, method: str = "spearman") -> DataFrame:
    """(a, b, rho) of the factors, paired within the rows of the wide frame."""
    return L.pair_dependence(L.wide_pairs(wide(spark, sf_dir), list(FACTORS)), method).withColumnRenamed(method, "rho")


_RANKED = "(rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0)"
_SP = f"rp AS (SELECT a, b, t_idx, {_RANKED.format(k='a, b, t_idx', c='x')} AS x, {_RANKED.format(k='a, b, t_idx', c='y')} AS y FROM pr), d AS (SELECT a, b, t_idx, count(*) AS n, abs({_CORR}) AS r FROM rp GROUP BY ALL), dp AS (SELECT a, b, avg(r) AS rho FROM d WHERE n >= 3 GROUP BY ALL)"


@query("dependence_spearman", f"WITH {_F}, {_SP} SELECT a, b, {q6('rho')} AS rho FROM dp")
def dependence_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence(spark, sf_dir).select("a", "b", r6("rho").alias("rho"))


@query("dependence_pearson", f"WITH {_F}, d AS (SELECT a, b, t_idx, count(*) AS n, abs({_CORR}) AS r FROM pr GROUP BY ALL) SELECT a, b, {q6('avg(r)')} AS rho FROM d WHERE n >= 3 GROUP BY ALL")
def dependence_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence(spark, sf_dir, "pearson").select("a", "b", r6("rho").alias("rho"))


@query("dependence_signed", f"""WITH {_F}, rv AS (SELECT factor, asset_id, t_idx, {_RANKED.format(k='factor, t_idx', c='v')} AS v FROM fv),
rp AS (SELECT a.factor AS a, b.factor AS b, t_idx, a.v AS x, b.v AS y FROM rv a JOIN rv b USING (t_idx, asset_id) WHERE a.factor < b.factor), d AS (SELECT a, b, t_idx, count(*) AS n, {_CORR} AS r FROM rp GROUP BY ALL)
SELECT a, b, {q6('abs(avg(r))')} AS rho FROM d WHERE n >= 5 GROUP BY ALL""")
def dependence_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dependence(values(spark, sf_dir), "signed").select("a", "b", r6("rho").alias("rho"))


@query("dependence_distance")
def dependence_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence(spark, sf_dir, "distance").select("a", "b", r6("rho").alias("rho"))


@query("library_diagnostics", f"WITH {_F}, {_SP} SELECT count(*) AS pairs, {q6('avg(rho)')} AS mean_rho, {q6('max(rho)')} AS max_rho, {q6('quantile_cont(rho, 0.95)')} AS p95_rho, {q6('avg((rho > 0.3)::INT)')} AS saturation FROM dp")
def library_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.diagnostics(dependence(spark, sf_dir))
    return got.select("pairs", *[r6(c).alias(c) for c in got.columns[1:]])


@query("library_novelty", f"WITH {_F}, {_SP}, u AS (SELECT a AS factor, rho FROM dp UNION ALL SELECT b, rho FROM dp) SELECT factor, {q6('1 - max(rho)')} AS novelty, count(*) FILTER (rho >= 0.3) AS conflicts FROM u GROUP BY factor")
def library_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.novelty(dependence(spark, sf_dir), 0.3).select("factor", r6("novelty").alias("novelty"), "conflicts")


@query("combined_equal", f"WITH {_F}, {_Z} SELECT asset_id, t_idx, {q6('avg(z)')} AS signal FROM zs GROUP BY ALL")
def combined_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combine_equal(values(spark, sf_dir)).withColumn("signal", r6("signal"))


@query("combined_weighted", f"WITH {_F}, {_Z} SELECT asset_id, t_idx, {q6("sum(z * CASE factor WHEN 'f1' THEN 0.6 WHEN 'f3' THEN 0.4 ELSE 0.0 END)")} AS signal FROM zs GROUP BY ALL")
def combined_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combine_weighted(values(spark, sf_dir), {"f1": 0.03, "f2": -0.01, "f3": 0.02}).withColumn("signal", r6("signal"))


_FIC = f"""fo AS (SELECT factor, t_idx, v, target FROM fv JOIN (SELECT asset_id AS aid, t_idx AS tid, target FROM s WHERE target IS NOT NULL) ON aid = asset_id AND tid = t_idx),
fr AS (SELECT factor, t_idx, {_RANKED.format(k='factor, t_idx', c='v')} AS x, {_RANKED.format(k='factor, t_idx', c='target')} AS y FROM fo), fi AS (SELECT factor, t_idx, CASE WHEN count(*) >= 5 THEN {_CORR} END AS ic FROM fr GROUP BY ALL)"""


@query("combined_by_block", f"""WITH {_F}, {_Z}, {_FIC}, bl AS (SELECT unnest(range(1, 6)) AS block), w0 AS (SELECT block, factor, greatest(avg(ic), 0.0) AS w FROM fi JOIN bl ON t_idx < block * 20 AND t_idx >= block * 20 - 60 WHERE ic IS NOT NULL GROUP BY ALL),
w AS (SELECT block, factor, CASE WHEN sum(w) OVER (PARTITION BY block) <> 0 THEN w / sum(w) OVER (PARTITION BY block) END AS w FROM w0)
SELECT asset_id, t_idx, {q6('coalesce(sum(z * w), avg(z))')} AS signal FROM zs LEFT JOIN w ON w.factor = zs.factor AND block = t_idx // 20 GROUP BY ALL""")
def combined_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    v = L.long_form(w, list(FACTORS))
    ic = M.ic_series(L.long_form(w, list(FACTORS), "target"), "v", "target", keys=("factor",))
    return L.combine_by_block(v, ic).withColumn("signal", r6("signal"))


@query("composite_signal", f"WITH {_F} SELECT asset_id, t_idx, {q6("CASE WHEN count(*) = 3 THEN sum(v * CASE factor WHEN 'f1' THEN 0.5 WHEN 'f2' THEN -1.0 ELSE 0.25 END) / 1.75 END")} AS signal FROM fv WHERE factor IN ('f1', 'f2', 'f3') GROUP BY ALL")
def composite_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.composite(values(spark, sf_dir), {"f1": 0.5, "f2": -1.0, "f3": 0.25}).withColumn("signal", r6("signal"))


@query("orthogonal_factors")
def orthogonal_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.orthogonal(values(spark, sf_dir), ["f1", "f2", "f3"]).withColumn("v", r6("v"))


@query("factor_ic_statistics", f"WITH {_F}, {_FIC} SELECT factor, count(ic) AS n_bars, {q6('avg(ic)')} AS ic_mean, {q6('avg(ic) / stddev_samp(ic)')} AS icir FROM fi GROUP BY factor")
def factor_ic_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    v = L.long_form(w, list(FACTORS), "target")
    return M.ic_stats(M.ic_series(v, "v", "target", keys=("factor",)), "factor").select("factor", "n_bars", r6("ic_mean").alias("ic_mean"), r6("icir").alias("icir"))


@query("staged_screen")
def staged_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, why = L.screen(wide(spark, sf_dir), list(FACTORS), least=0.01)
    return spark.createDataFrame([(f, "admitted") for f in chosen] + sorted(why.items()), "factor string, outcome string")


@query("stepwise_choice")
def stepwise_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(L.stepwise(wide(spark, sf_dir), list(FACTORS), most=2))), "place int, factor string")


@query("lasso_choice")
def lasso_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(L.lasso(wide(spark, sf_dir), list(FACTORS)).items()), "factor string, coefficient double")


@query("decay_curve", f"""WITH {_SIGNAL_SQL}, hz AS (SELECT asset_id, datetime, unnest([1, 2, 3]) AS horizon, unnest([lead(close, 2) OVER r / lead(close, 1) OVER r - 1, lead(close, 3) OVER r / lead(close, 1) OVER r - 1, lead(close, 4) OVER r / lead(close, 1) OVER r - 1]) AS y FROM raw WINDOW r AS (PARTITION BY asset_id ORDER BY datetime)),
ho AS (SELECT horizon, t_idx, signal, y FROM s JOIN hz ON hz.asset_id = s.asset_id AND hz.datetime = s.datetime WHERE signal IS NOT NULL AND y IS NOT NULL),
hr AS (SELECT horizon, t_idx, {_RANKED.format(k='horizon, t_idx', c='signal')} AS x, {_RANKED.format(k='horizon, t_idx', c='y')} AS y FROM ho), hi AS (SELECT horizon, t_idx, CASE WHEN count(*) >= 5 THEN {_CORR} END AS ic FROM hr GROUP BY ALL)
SELECT horizon, {q6('avg(ic)')} AS ic_mean, {q6('avg(ic) / stddev_samp(ic)')} AS icir FROM hi GROUP BY horizon""")
def decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.decay_curve(wide(spark, sf_dir), "f1", ["target_h1", "target_h2", "target_h3"])
    return got.select("horizon", r6("ic_mean").alias("ic_mean"), r6("icir").alias("icir"))


@query("newey_west", f"""WITH {_SIGNAL_SQL}, {_LEG}, e AS (SELECT t_idx, ls - (SELECT avg(ls) FROM ls) AS e FROM ls WHERE ls IS NOT NULL), l AS (SELECT e, lag(e, 1) OVER (ORDER BY t_idx) AS l1, lag(e, 2) OVER (ORDER BY t_idx) AS l2, lag(e, 3) OVER (ORDER BY t_idx) AS l3 FROM e),
g AS (SELECT count(*) AS n, sum(e * e) + 2 * (0.75 * sum(e * l1) + 0.5 * sum(e * l2) + 0.25 * sum(e * l3)) AS v FROM l)
SELECT n, {q6('(SELECT avg(ls) FROM ls)')} AS mean, {q6('sqrt(greatest(v, 0)) / n')} AS se, {q6('(SELECT avg(ls) FROM ls) / (sqrt(greatest(v, 0)) / n)')} AS t FROM g""")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).withColumnRenamed("f1", "signal")
    got = I.newey_west(M.legs(w), "ls", 3)
    return got.select("n", *[r6(c).alias(c) for c in ("mean", "se", "t")])


@query("adjusted_p", f"""WITH {PANEL_M}, q AS (SELECT asset_id, count(*) FILTER (close > open) / count(*) * 0.2 AS p FROM raw GROUP BY asset_id), r AS (SELECT asset_id, p, row_number() OVER (ORDER BY p, asset_id) AS r, count(*) OVER () AS m FROM q)
SELECT asset_id, {q6('p')} AS p, {q6('least(min(p * m / r) OVER (ORDER BY r DESC), 1.0)')} AS adjusted FROM r""")
def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir).groupBy("asset_id").agg((F.sum((F.col("close") > F.col("open")).cast("int")) / F.count(F.lit(1)) * 0.2).alias("p"))
    return I.benjamini_hochberg(p).select("asset_id", r6("p").alias("p"), r6("adjusted").alias("adjusted"))


@query("purged_paths", """WITH g AS (SELECT unnest(range(0, 6)) AS i), c AS (SELECT (row_number() OVER (ORDER BY a.i, b.i) - 1)::INT AS path, a.i AS x, b.i AS y FROM g a JOIN g b ON a.i < b.i), t AS (SELECT unnest(range(0, 120))::INT AS t_idx),
k AS (SELECT path, t_idx, max((t_idx >= e * 20 AND t_idx < e * 20 + 20)::INT) AS ins, max((t_idx >= e * 20 - 2 AND t_idx < e * 20 + 20 + 1)::INT) AS near FROM (SELECT path, unnest([x, y]) AS e FROM c), t GROUP BY ALL)
SELECT path, t_idx, CASE WHEN ins = 1 THEN 'test' WHEN near = 1 THEN 'purged' ELSE 'train' END AS role FROM k""")
def purged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.purged_paths(spark, 120, 6, 2, 2, 0.01)


@query("significance_summary")
def significance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    made = {f: M.legs(w.withColumnRenamed(f, "signal")).withColumnRenamed("ls", f) for f in FACTORS}
    table = None
    for d in made.values():
        table = d if table is None else table.join(d, "t_idx")
    m = table.orderBy("t_idx").toPandas()[list(FACTORS)].dropna().to_numpy()
    sharpe = m.mean(0) / m.std(0, ddof=1)
    rows = []
    for i, f in enumerate(FACTORS):
        mean, lo, hi = I.block_bootstrap(m[:, i])
        rows.append((f, float(mean), lo, hi, I.sign_flip(m[:, i]), I.deflated_sharpe(m[:, i], len(FACTORS), float(sharpe.var(ddof=1))), I.overfit_probability(m, 8), *I.diebold_mariano(m[:, i], m[:, 0]), *I.wilcoxon(m[:, i], m[:, 0])))
    return spark.createDataFrame(rows, "factor string, mean double, lo double, hi double, p double, deflated double, pbo double, dm double, dm_p double, w double, w_p double")


@query("granger_f")
def granger_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = wide(spark, sf_dir).groupBy("t_idx").agg(F.avg("f1").alias("s"), F.avg("returns").alias("r"), F.avg("volume").alias("v"))
    return spark.createDataFrame([(c, I.granger(bars, c, "r")) for c in ("s", "v")], "cause string, f double")


# -- portfolio --

_LW = """lw AS (SELECT t_idx, asset_id, target, CASE WHEN down <= k THEN 1.0 ELSE -1.0 END / k AS w FROM (SELECT *, least(greatest(1, floor(n * 0.2)), floor(n / 2)) AS k FROM (SELECT t_idx, asset_id, target, count(*) OVER (PARTITION BY t_idx) AS n,
row_number() OVER (PARTITION BY t_idx ORDER BY signal, asset_id) AS up, row_number() OVER (PARTITION BY t_idx ORDER BY signal DESC, asset_id DESC) AS down FROM s WHERE signal IS NOT NULL)) WHERE k > 0 AND (up <= k OR down <= k))"""


@query("leg_weights", f"WITH {_SIGNAL_SQL}, {_LW} SELECT t_idx, asset_id, {q6('w')} AS w FROM lw")
def leg_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.leg_weights(wide(spark, sf_dir), "f1").withColumn("w", r6("w"))


@query("cost_stress", f"""WITH {_SIGNAL_SQL}, {_LW}, mv AS (SELECT t_idx, sum(abs(d)) AS notional FROM (SELECT t_idx, asset_id, sum(w) AS d FROM (SELECT t_idx, asset_id, w FROM lw UNION ALL SELECT t_idx + 1, asset_id, -w FROM lw) GROUP BY ALL) WHERE t_idx <= (SELECT max(t_idx) FROM lw) GROUP BY t_idx),
er AS (SELECT t_idx, sum(w * target) AS gross FROM lw GROUP BY t_idx), b AS (SELECT mv.t_idx, notional, coalesce(gross, 0) AS gross, unnest([0.0, 5.0, 10.0, 20.0]::DOUBLE[]) AS cost_bps FROM mv LEFT JOIN er USING (t_idx))
SELECT cost_bps, {q6('avg(gross)')} AS gross, {q6('avg(notional)')} AS notional, {q6('avg(gross - cost_bps / 10000 * notional)')} AS net FROM b GROUP BY cost_bps""")
def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.cost_stress(wide(spark, sf_dir), "f1")
    return got.select("cost_bps", *[r6(c).alias(c) for c in ("gross", "notional", "net")])


@query("capacity_curve", f"""WITH {_SIGNAL_SQL}, {_LW}, e AS (SELECT lw.*, p.amount AS adv, unnest([1000.0, 10000.0, 100000.0, 1000000.0, 10000000.0]::DOUBLE[]) AS capital FROM lw JOIN p USING (asset_id, t_idx)),
b AS (SELECT capital, t_idx, sum(w * target) AS gross, sum(abs(w) * coalesce(0.1 * sqrt(CASE WHEN adv > 0 THEN capital * abs(w) / adv END), 0)) AS cost FROM e GROUP BY ALL)
SELECT capital, {q6('avg(gross)')} AS gross, {q6('avg(cost)')} AS cost, {q6('avg(gross - cost)')} AS net FROM b GROUP BY capital""")
def capacity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.capacity(wide(spark, sf_dir), "f1")
    return got.select("capital", *[r6(c).alias(c) for c in ("gross", "cost", "net")])


@query("residual_signal", f"""WITH {_SIGNAL_SQL}, x AS (SELECT s.asset_id, s.t_idx, signal AS y, amount * 0.000001 AS e FROM s JOIN p USING (asset_id, t_idx) WHERE signal IS NOT NULL AND amount IS NOT NULL),
f AS (SELECT t_idx, regr_slope(y, e) AS b, regr_intercept(y, e) AS a, count(*) AS n, CASE WHEN var_pop(y) * count(*) > 1e-12 THEN regr_r2(y, e) ELSE 0.0 END AS r2 FROM x GROUP BY t_idx HAVING count(*) > 2)
SELECT asset_id, t_idx, {q6('y - a - b * e')} AS residual, {q6('r2')} AS r2 FROM x JOIN f USING (t_idx)""")
def residual_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).withColumn("e", F.col("amount") * 1e-6)
    return P.residualise(w, "f1", ["e"]).select("asset_id", "t_idx", r6("residual").alias("residual"), r6("r2").alias("r2"))


@query("comomentum")
def comomentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.comomentum(wide(spark, sf_dir), "f1").select("end", r6("comomentum").alias("comomentum"))


@query("consensus_overlap")
def consensus_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    c = w.groupBy("t_idx").agg(F.avg("target").alias("market"), F.stddev_samp("target").alias("spread"))
    return P.consensus_overlap(w.withColumnRenamed("f1", "signal"), c, ["market", "spread"]).withColumn("correlation", r6("correlation"))


@query("trade_costs", f"""SELECT o_orderkey, {q6('0.001 * abs(v) * (0.02 * (0.1 * pow(abs(v) / 1000000, 0.5) + 0.2 * abs(v) / 1000000) + 0.0003 + CASE WHEN v < 0 THEN 0.001 ELSE 0.0 END)')} AS cost
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS v FROM orders)""")
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("v"))
    return o.select("o_orderkey", r6(0.001 * P.trade_cost(F.col("v"), F.lit(0.02), F.lit(1e6), stamp_bps=10.0)).alias("cost"))


@query("expected_shortfall", f"""WITH {_SIGNAL_SQL}, {_LEG}, q AS (SELECT quantile_cont(-ls, 0.95) AS q FROM ls) SELECT {q6('max(q)')} AS value_at_risk, {q6('avg(-ls)')} AS shortfall FROM ls, q WHERE -ls >= q""")
def expected_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.expected_shortfall(M.legs(wide(spark, sf_dir).withColumnRenamed("f1", "signal")), "ls")
    return got.select(*[r6(c).alias(c) for c in got.columns])


@query("risk_weights")
def risk_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, c = P.covariance(wide(spark, sf_dir))
    c = P.definite(c)
    h, p = P.hierarchical_parity(c), P.risk_parity(c)
    return spark.createDataFrame([(n, float(a), float(b)) for n, a, b in zip(names, h, p, strict=True)], "asset_id string, hierarchical double, parity double")


@query("formula_sensitivity")
def formula_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sensitivity(wide(spark, sf_dir).select("asset_id", "t_idx", "close", "volume", "target"), SIGNAL)


@query("formula_families")
def formula_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(family(parse(f)), k == "f1") for k, f in FACTORS.items()]
    return L.family_summary(spark.createDataFrame(rows, "family string, admitted boolean"))


# -- retrieval, graphs, streams --

_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '')"
_BM = f"""tk AS (SELECT doc_id, {_TOK} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tk), qt AS (SELECT unnest(['er', 'the', 'tion']) AS term),
tf AS (SELECT doc_id, len(ts) AS l, term, len(list_filter(ts, lambda t: t = term)) AS f FROM tk, qt), df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id HAVING score > 0)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bm25(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "the tion er")


@query("bm25", f"WITH {_BM} SELECT id, {q6('score')} AS score FROM bm")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).withColumn("score", r6("score"))


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_COS = f"cs AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS score FROM embeddings)"


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return V.nearest(e, e.where("vec_id = 7").first().embedding, k)


@query("nearest_vectors", f"WITH {_COS} SELECT id, {q6('score')} AS score FROM cs ORDER BY cs.score DESC, id LIMIT 10")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10).withColumn("score", r6("score"))


@query("semantic_duplicates", f"SELECT a.vec_id AS a, b.vec_id AS b, {q6('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.92")
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.semantic_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("score", r6("score"))


@query("fused_ranking", f"""WITH {_BM}, {_COS}, c AS (SELECT id, score FROM cs ORDER BY score DESC, id LIMIT 50), u AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM bm UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM c)
SELECT id, {q6('sum(s::DOUBLE)')} AS score FROM u GROUP BY id""")
def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fuse(_bm25(spark, sf_dir), _nearest(spark, sf_dir, 50)).withColumn("score", r6("score"))


@query("reranked", f"""WITH {_BM}, h AS (SELECT id, score AS bm, list_distinct({_TOK}) AS t FROM bm JOIN documents ON doc_id = id), q AS (SELECT *, len(list_intersect(t, ['the', 'tion', 'er'])) AS sh FROM h)
SELECT id, {q6("0.45 * sh / len(list_distinct(list_concat(t, ['the', 'tion', 'er']))) + 0.40 * bm / (SELECT max(score) FROM bm) + 0.15 * sh / 3")} AS score FROM q""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    hits = _bm25(spark, sf_dir).withColumnRenamed("score", "bm25").join(d, "id")
    return V.rerank(hits, "the tion er").withColumn("score", r6("score"))


_EDGE = "ed AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey % 97 AS b FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 50 AND l_discount >= 0.09")
    return li.select(F.col("l_suppkey").alias("a"), (1000000 + F.col("l_partkey") % 97).alias("b")).distinct()


@query("graph_components", f"WITH RECURSIVE {_EDGE}, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re(node, m) AS (SELECT a, a FROM bo UNION SELECT bo.b, re.m FROM re JOIN bo ON bo.a = re.node WHERE re.m < bo.b) SELECT node, least(node, min(m)) AS root FROM re GROUP BY node")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.connected(_edges(spark, sf_dir))


@query("graph_neighbours", f"WITH {_EDGE}, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), h1 AS (SELECT DISTINCT b AS node FROM bo WHERE a = 1000001), h2 AS (SELECT DISTINCT bo.b AS node FROM h1 JOIN bo ON bo.a = h1.node), u AS (SELECT 1000001 AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, min(hop) AS hop FROM u GROUP BY node")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.neighbours(_edges(spark, sf_dir), 1000001, 2)


#: Parts are numbered from here on in the whole graph, past any supplier.
PART = 1 << 40


def _all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL")
    return li.select(F.col("l_suppkey").cast("long").alias("a"), (F.col("l_partkey").cast("long") + F.lit(PART)).alias("b"))


# graph_components and graph_neighbours follow their SQL, which cuts rows and merges parts; these two have no SQL and cut nothing


@query("graph_components_whole")
def graph_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.connected(_all_edges(spark, sf_dir))


@query("graph_neighbours_whole")
def graph_neighbours_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.neighbours(_all_edges(spark, sf_dir), PART + 1, 2)


@query("co_occurrence", "SELECT x.t AS a, y.t AS b, count(DISTINCT x.user_id) AS n FROM (SELECT user_id, event_type AS t FROM events) x JOIN (SELECT user_id, event_type AS t FROM events) y ON x.user_id = y.user_id AND x.t < y.t GROUP BY ALL")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.co_occurrence(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type")


@query("tumbling_bars", "SELECT user_id AS asset_id, date_trunc('day', ts)::TIMESTAMP AS datetime, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close, count(value)::DOUBLE AS volume, " + q6("sum(value)") + " AS amount FROM events GROUP BY ALL")
def tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("amount", r6("amount"))


@query("regime_stream")
def regime_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = with_vwap_returns(monthly(spark, sf_dir))
    ret = raw.groupBy("datetime").agg(F.avg("returns").alias("ret")).join(F.broadcast(bars(raw)), "datetime")
    return batch(ret.select(F.lit("all").alias("market"), F.col("t_idx").cast("long").alias("t"), "ret"))





@query("reward", f"SELECT c_custkey, {q6('pow(least(abs(c_acctbal / 10000), 1.0), 0.5) * pow(1 - greatest(0.0, least(1.0, c_nationkey / 25.0)), 2.0)')} AS reward FROM customer")
def reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", r6(S.reward(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25.0, 0.5, 2.0)).alias("reward"))


@query("dependence_profile")
def dependence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.dependence_profile(L.wide_pairs(wide(spark, sf_dir), list(FACTORS)))
    return got.select(*[F.col(c) if c in ("a", "b") else r6(c).alias(c) for c in got.columns])


@query("marginal_utility")
def marginal_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.marginal_utility(wide(spark, sf_dir), ["f1", "f2"], "f3")


@query("rolling_ridge")
def rolling_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling_ridge(wide(spark, sf_dir), ["f1", "f2", "f3"])


@query("attribution", f"""WITH {_F}, {_FIC}, g AS (SELECT factor, t_idx, target AS y, floor(count(*) OVER (PARTITION BY factor, t_idx) / 5) AS k, row_number() OVER (PARTITION BY factor, t_idx ORDER BY v, aid) AS up, row_number() OVER (PARTITION BY factor, t_idx ORDER BY v DESC, aid DESC) AS down
FROM (SELECT factor, t_idx, v, target, asset_id AS aid FROM fv JOIN (SELECT asset_id AS x, t_idx AS tid, target FROM s WHERE target IS NOT NULL) ON x = asset_id AND tid = t_idx)),
b AS (SELECT factor, t_idx, avg(y) FILTER (down <= k) - avg(y) FILTER (up <= k) AS ls FROM g WHERE k > 0 GROUP BY ALL), l AS (SELECT factor, avg(ls) AS ls FROM b GROUP BY factor), i AS (SELECT factor, avg(ic) AS m, avg(ic) / stddev_samp(ic) AS r FROM fi GROUP BY factor)
SELECT i.factor, {q6('m')} AS ic_mean, {q6('r')} AS icir, {q6('ls')} AS ls FROM i LEFT JOIN l ON l.factor = i.factor""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.attribution(wide(spark, sf_dir), list(FACTORS))
    return got.select("factor", *[r6(c).alias(c) for c in ("ic_mean", "icir", "ls")])
