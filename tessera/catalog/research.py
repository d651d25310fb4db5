"""Queries of life cycles, causes, evidence, splits, frozen sets and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.analytics import _CORR, _F, _FIC, _LW, _RANKED, _SP, FACTORS, PART, dependence, values, wide
from tessera.catalog.base import SQL, q6, query, r6
from tessera.catalog.panel import _LEG, _SIGNAL_SQL
from tessera.operators import causal as C
from tessera.operators import evidence as E
from tessera.operators import library as L
from tessera.operators import lifecycle as Y
from tessera.operators import metrics as M
from tessera.operators import models as D
from tessera.operators import portfolio as P
from tessera.operators import retrieval as V
from tessera.operators.inference import ERFC
from tessera.plans.formula import canonical, family, mechanism, parse
from tessera.sources.panels import bars, monthly

_MECH = {f: mechanism(family(parse(x))) for f, x in FACTORS.items()}


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(factor, t_idx, ic) of the factors."""
    w = wide(spark, sf_dir)
    v = L.long_form(w, list(FACTORS), "target")
    return M.ic_series(v, "v", "target", keys=("factor",))


def _rounded(df: DataFrame, *plain: str) -> DataFrame:
    return df.select(*[F.col(c) if c in plain else r6(c).alias(c) for c in df.columns])


_LIFE = f"""{_F}, {_FIC}, lk AS (SELECT factor, t_idx, ic, count(*) OVER (PARTITION BY factor) AS n, row_number() OVER (PARTITION BY factor ORDER BY t_idx) AS up, row_number() OVER (PARTITION BY factor ORDER BY t_idx DESC) AS down FROM fi WHERE ic IS NOT NULL),
lg AS (SELECT factor, max(n) AS n, avg(ic) FILTER (up <= CASE WHEN n < 4 THEN 1 ELSE least(3, n // 2) END) AS a, avg(ic) FILTER (down <= CASE WHEN n < 4 THEN 1 ELSE least(3, n // 2) END) AS b, CASE WHEN max(n) < 4 THEN 0.0 ELSE regr_slope(ic, t_idx) END AS s FROM lk GROUP BY factor),
lr AS (SELECT *, CASE WHEN abs(a) > 1e-9 THEN abs(b) / abs(a) WHEN abs(b) <= 1e-9 THEN 1.0 ELSE 0.0 END AS r FROM lg)"""


@query("factor_life", f"""WITH {_LIFE} SELECT factor, n, {q6('a')} AS ic_first, {q6('b')} AS ic_last, {q6('s')} AS slope, {q6('CASE WHEN n >= 4 AND s < -1e-9 AND abs(a) > 1e-9 THEN abs(a) / (2 * abs(s)) END')} AS half_life,
CASE WHEN n < 4 THEN 'insufficient_data' WHEN s >= 0 OR r >= 0.8 THEN 'stable' WHEN r <= 0.2 OR (a > 0 AND b <= 0) THEN 'decayed' ELSE 'decaying' END AS state FROM lr""")
def factor_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Y.life_curve(_ic(spark, sf_dir), "factor"), "factor", "n", "state")


_HYP = f"""{_F}, {_FIC}, hh AS (SELECT factor, t_idx::DOUBLE AS t, abs(ic) AS y FROM fi WHERE ic IS NOT NULL),
hf AS (SELECT factor, count(*) AS n, count(*) FILTER (y > 1e-9) AS m, avg(y) AS mean, avg(y) FILTER (y > 1e-9) AS used, regr_slope(1 / y, t) FILTER (y > 1e-9) AS s, regr_intercept(1 / y, t) FILTER (y > 1e-9) AS i FROM hh GROUP BY factor),
hk AS (SELECT *, CASE WHEN n < 4 THEN 0.0 WHEN m < 4 THEN mean WHEN i <= 1e-12 THEN used ELSE 1 / i END AS k, CASE WHEN m < 4 OR i <= 1e-12 THEN 0.0 ELSE greatest(0.0, s / i) END AS rate FROM hf),
he AS (SELECT factor, sum(pow(y - k / (1 + rate * t), 2)) AS l, sum(pow(y - used, 2)) AS o FROM hh JOIN hk USING (factor) WHERE y > 1e-9 GROUP BY factor),
hy AS (SELECT factor, n, k, rate, CASE WHEN rate > 1e-12 THEN 1 / rate END AS half_life, CASE WHEN m >= 4 AND o > 1e-18 THEN greatest(0.0, least(1.0, 1 - l / o)) ELSE 0.0 END AS r2 FROM hk LEFT JOIN he USING (factor))"""


@query("factor_hyperbola", f"WITH {_HYP} SELECT factor, n, {q6('k')} AS k, {q6('rate')} AS rate, {q6('half_life')} AS half_life, {q6('r2')} AS r2 FROM hy")
def factor_hyperbola(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Y.hyperbolic_fit(_ic(spark, sf_dir), "factor"), "factor", "n")


_CASES = " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in _MECH.items())


@query("crowding_risk", f"""WITH {_HYP}, hm AS (SELECT factor, CASE factor {_CASES} END AS mechanism, coalesce(half_life < 20, false) AS fast FROM hy)
SELECT factor, mechanism, CASE WHEN mechanism IN ('Trend/Momentum', 'Reversal/Mean-Reversion') THEN CASE WHEN fast THEN 'high_crowding_decay_risk' ELSE 'elevated_crowding_decay_risk' END WHEN fast THEN 'decay_watch' ELSE 'low_crowding_decay_risk' END AS risk FROM hm""")
def crowding_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.create_map(*[F.lit(x) for p in _MECH.items() for x in p])
    fit = Y.hyperbolic_fit(_ic(spark, sf_dir), "factor").withColumn("mechanism", F.element_at(of, F.col("factor")))
    return fit.select("factor", "mechanism", Y.crowding_risk(F.col("mechanism"), F.col("half_life")).alias("risk"))


# -- causes --

_U = lambda seed, *c: f"((('0x' || substr(md5(concat_ws('|', {', '.join(c)}, '{seed}')), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
_SHOCK = f"""{_SIGNAL_SQL}, sp AS (SELECT stddev_pop(target) AS spread FROM s),
sh AS (SELECT 'none' AS scenario, asset_id, t_idx, signal AS x, target AS y FROM s UNION ALL SELECT 'volume', asset_id, t_idx, CASE WHEN {_U(44, 't_idx')} < 0.3 THEN signal * 2.0 ELSE signal END, target FROM s
UNION ALL SELECT 'volatility', asset_id, t_idx, signal, target + sqrt(-2 * ln({_U(42, 'asset_id', 't_idx')})) * cos(6.283185307179586 * {_U(43, 'asset_id', 't_idx')}) * spread * 2.0 FROM s, sp
UNION ALL SELECT 'liquidity', asset_id, t_idx, CASE WHEN signal IS NOT NULL AND {_U(45, 'asset_id', 't_idx')} < 0.1 THEN 0.0 ELSE signal END, target FROM s),
so AS (SELECT * FROM sh WHERE x IS NOT NULL AND y IS NOT NULL), sr AS (SELECT scenario, t_idx, {_RANKED.format(k='scenario, t_idx', c='x')} AS x, {_RANKED.format(k='scenario, t_idx', c='y')} AS y FROM so),
si AS (SELECT scenario, t_idx, CASE WHEN count(*) >= 5 THEN {_CORR} END AS ic FROM sr GROUP BY ALL), sa AS (SELECT scenario, avg(abs(ic)) AS ic FROM si GROUP BY scenario),
sq AS (SELECT scenario, ic, ic / (SELECT ic FROM sa WHERE scenario = 'none') AS ratio FROM sa WHERE scenario <> 'none')"""


@query("interventions", f"WITH {_SHOCK} SELECT scenario, {q6('ic')} AS ic, {q6('ratio')} AS ratio, ratio >= 0.5 AS passes FROM sq")
def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.interventions(wide(spark, sf_dir), "f1"), "scenario", "passes")


@query("causal_robustness")
def causal_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    rows = [(f, *map(float, (r["p"], r["f"], r["ratio"], r["score"])), bool(r["passes"])) for f in FACTORS for r in [C.robustness(w, f, controls=tuple(g for g in FACTORS if g != f))]]
    return spark.createDataFrame(rows, "factor string, p double, f double, ratio double, score double, passes boolean")


# -- evidence --


@query("contiguous_split", "SELECT 0 AS split, 0 AS train_start, (max(t_idx) + 1) * 7 // 10 AS train_end, (max(t_idx) + 1) * 7 // 10 AS test_start, max(t_idx) + 1 AS test_end FROM (SELECT (row_number() OVER (ORDER BY d) - 1)::INTEGER AS t_idx FROM (SELECT DISTINCT date_trunc('month', l_shipdate) AS d FROM lineitem))")
def contiguous_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contiguous_split(spark, bars(monthly(spark, sf_dir)).count())


@query("rolling_splits", """WITH m AS (SELECT count(DISTINCT date_trunc('month', l_shipdate))::INTEGER AS bars FROM lineitem), k AS (SELECT unnest(range(0, (bars - 48) // 6 + 1))::INTEGER AS split FROM m)
SELECT split, split * 6 AS train_start, split * 6 + 36 AS train_end, split * 6 + 36 AS test_start, split * 6 + 48 AS test_end FROM k""")
def rolling_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rolling_splits(spark, bars(monthly(spark, sf_dir)).count(), 36, 12, 6)


def _p(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = repr(ERFC[0])
    for c in ERFC[1:]:
        poly = f"({poly} * {t} + {c!r})"
    return f"{t} * exp(-{x} * {x} + {poly})"


_BUNDLE = f"""{_SIGNAL_SQL}, ev AS (SELECT 'spearman' AS correlation, t_idx, ic FROM ic UNION ALL SELECT 'pearson', t_idx, CASE WHEN count(*) >= 5 THEN corr(signal, target) END FROM ok GROUP BY t_idx),
em AS (SELECT correlation, count(ic) AS n, avg(ic) AS m, abs(avg(ic)) AS am, avg(abs(ic)) AS ma, stddev_samp(ic) AS sd, avg((ic > 0)::INT) AS win FROM ev WHERE ic IS NOT NULL GROUP BY correlation),
el AS (SELECT correlation, e, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2, lag(e, 3) OVER w AS l3 FROM (SELECT correlation, t_idx, ic - m AS e FROM ev JOIN em USING (correlation) WHERE ic IS NOT NULL) WINDOW w AS (PARTITION BY correlation ORDER BY t_idx)),
eh AS (SELECT correlation, sqrt(greatest(sum(e * e) + 2 * (0.75 * sum(e * l1) + 0.5 * sum(e * l2) + 0.25 * sum(e * l3)), 0)) / count(*) AS se FROM el GROUP BY correlation),
eb AS (SELECT *, m / sd AS ir, m / se AS ht FROM em JOIN eh USING (correlation))"""


@query("ic_evidence", f"""WITH {_BUNDLE} SELECT correlation, n, {', '.join(q6(x) + f' AS {c}' for x, c in (('m', 'mean'), ('am', 'absolute_mean'), ('ma', 'mean_absolute'), ('sd', 'std'), ('ir', 'icir'), ('ir * sqrt(12)', 'annual_icir'), ('ir * sqrt(n)', 't'), ('win', 'win_rate'), ('se', 'hac_se'), ('ht', 'hac_t'), (_p('ht'), 'hac_p')))} FROM eb""")
def ic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.ic_evidence(wide(spark, sf_dir), "f1", per_year=12, lags=3), "correlation", "n")


_TRIALS = f"""{_F}, ft AS (SELECT factor, asset_id, t_idx, v, target FROM fv JOIN (SELECT asset_id, t_idx, target FROM s WHERE target IS NOT NULL) USING (asset_id, t_idx)),
fl AS (SELECT factor, t_idx, target AS y, least(greatest(1, floor(n * 0.2)), floor(n / 2)) AS k, up, down FROM (SELECT *, count(*) OVER (PARTITION BY factor, t_idx) AS n, row_number() OVER (PARTITION BY factor, t_idx ORDER BY v, asset_id) AS up,
row_number() OVER (PARTITION BY factor, t_idx ORDER BY v DESC, asset_id DESC) AS down FROM ft)), ls AS (SELECT factor AS trial, t_idx, avg(y) FILTER (down <= k) - avg(y) FILTER (up <= k) AS v FROM fl WHERE k > 0 GROUP BY ALL)"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    out = None
    for f in FACTORS:
        own = M.legs(w, f).select(F.lit(f).alias("trial"), "t_idx", F.col("ls").alias("v"))
        out = own if out is None else out.unionByName(own)
    return out


@query("purged_path_means", f"""WITH {_TRIALS}, nb AS (SELECT max(t_idx) + 1 AS bars FROM ls), g AS (SELECT i, round(i * bars / 6) AS lo, round((i + 1) * bars / 6) AS hi FROM nb, (SELECT unnest(range(0, 6)) AS i)),
c AS (SELECT (row_number() OVER (ORDER BY a.i, b.i) - 1)::INT AS path, [a.i, b.i] AS gs FROM g a JOIN g b ON a.i < b.i), t AS (SELECT path, lo, hi FROM (SELECT path, unnest(gs) AS i FROM c) JOIN g USING (i))
SELECT trial, path, {q6('avg(v)')} AS mean FROM ls JOIN t ON t_idx >= lo AND t_idx < hi GROUP BY ALL""")
def purged_path_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.path_means(_trials(spark, sf_dir), 6, 2), "trial", "path")


@query("purged_path_summary")
def purged_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.path_summary(E.path_means(_trials(spark, sf_dir)))
    return spark.createDataFrame([(int(s["trials"]), int(s["paths"]), s["best"], float(s["mean"]), float(s["pbo"]), float(s["deflated"]))], "trials int, paths int, best string, mean double, pbo double, deflated double")


_HALF = lambda name, where: f"{name} AS (SELECT factor, coalesce(abs(avg(ic)), 0) AS ic, coalesce(abs(avg(ic) / stddev_samp(ic)), 0) AS ir FROM fi WHERE {where} GROUP BY factor)"


@query("frozen_set", f"""WITH {_F}, {_FIC}, {_HALF('tr', 't_idx < 50')}, {_HALF('te', 't_idx >= 50')}, pl AS (SELECT *, row_number() OVER (ORDER BY (ic >= 0.02 AND ir >= 0.1) DESC, ic DESC, factor) AS place FROM tr)
SELECT factor, {q6('pl.ic')} AS train_ic, {q6('pl.ir')} AS train_icir, place::INT AS place, {q6('te.ic')} AS test_ic, {q6('te.ir')} AS test_icir FROM pl LEFT JOIN te USING (factor) WHERE place <= 3""")
def frozen_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.frozen_set(_ic(spark, sf_dir), 50, 3, 0.02, 0.1), "factor", "place")


@query("library_gate", f"WITH {_F}, {_FIC} SELECT factor FROM fi GROUP BY factor HAVING abs(avg(ic)) >= 0.01 AND abs(avg(ic) / stddev_samp(ic)) >= 0.05 AND avg((ic > 0)::INT) FILTER (ic IS NOT NULL) >= 0.4")
def library_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = M.ic_stats(_ic(spark, sf_dir), "factor").withColumn("turnover", F.lit(0.5))
    return L.gate(stats, 0.01, 0.05, 0.4).select("factor")


@query("dependence_extended", f"WITH {_F}, {_SP} SELECT a, b, {q6('rho')} AS rho FROM dp")
def dependence_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    return L.extend(L.dependence(v.where("factor <> 'f4'")), v, ["f4"]).select("a", "b", r6("rho").alias("rho"))


@query("facts_on_panel", """WITH b AS (SELECT c_custkey AS asset_id, d AS datetime FROM customer, (SELECT unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '1999-01-01', INTERVAL 90 DAY)) AS d)),
f AS (SELECT o_custkey, o_orderdate, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderdate ORDER BY o_orderkey DESC) = 1),
x AS (SELECT asset_id, datetime, o_totalprice AS "F" FROM b ASOF LEFT JOIN (SELECT * FROM f WHERE o_orderstatus = 'F') f ON b.asset_id = f.o_custkey AND b.datetime >= f.o_orderdate)
SELECT asset_id, datetime, "F", o_totalprice AS "O" FROM x ASOF LEFT JOIN (SELECT * FROM f WHERE o_orderstatus = 'O') f ON x.asset_id = f.o_custkey AND x.datetime >= f.o_orderdate""")
def facts_on_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = F.expr("sequence(TIMESTAMP_NTZ '1995-01-01', TIMESTAMP_NTZ '1998-12-31', INTERVAL 90 DAYS)")
    bars = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("asset_id"), F.explode(dates).alias("datetime"))
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").alias("filed"), F.col("o_orderstatus").alias("concept"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return E.facts_on_panel(bars, facts, ["F", "O"], order="o_orderkey")


_PAYLOAD = {f: '{"formula":"%s","name":"%s"}' % (canonical(parse(x)), f) for f, x in FACTORS.items()}


@query("provenance", " UNION ALL ".join(f"SELECT '{f}' AS factor, sha256('{p}') AS digest" for f, p in _PAYLOAD.items()))
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f, E.stable_digest({"name": f, "formula": str(canonical(parse(x)))})) for f, x in FACTORS.items()], "factor string, digest string")


@query("pattern_scores", f"SELECT p_partkey, {q6('p_size / 50.0 * (1 + ln(1 + p_size)) * CASE WHEN p_size % 3 = 2 THEN 0.4 WHEN p_size % 3 = 1 THEN 0.9 ELSE 1.0 END')} AS score FROM part")
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", r6(V.pattern_score(F.col("p_size") / 50.0, F.col("p_size"), F.col("p_size") % 3 / 2.0)).alias("score"))


@query("research_scores")
def research_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.inference import series

    w = wide(spark, sf_dir)
    names, g = L.gram(w, list(FACTORS))
    rho = {r.factor: 1 - r.novelty for r in L.novelty(dependence(spark, sf_dir)).collect()}
    rows = []
    for f in FACTORS:
        ics = {h: series(M.ic_series(w, f, f"target_{h}"), "ic") for h in ("h1", "h2", "h3")}
        i, others = names.index(f), [k for k, n in enumerate(names) if n != f]
        gain = E.effective_rank(g) - E.effective_rank(g[[[k] for k in others], others])
        escape = L.orthogonal_escape(g, others, i)
        s = E.score_vector(ics, M.turnover(w, f).first().turnover, rho[f], rank_gain=gain)
        ok, why = E.research_admission(s, rho[f], 0.0, escape, gain)
        rows.append((f, *[float(s[k]) for k in ("score", "bound", "consistency", "slope")], float(gain), float(escape), ok, why))
    return spark.createDataFrame(rows, "factor string, score double, bound double, consistency double, slope double, rank_gain double, span_gain double, admitted boolean, reason string")


@query("jump_worth")
def jump_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, g = L.gram(wide(spark, sf_dir), [*FACTORS, "target"])
    at = {n: i for i, n in enumerate(names)}
    rows = []
    for f in FACTORS:
        span = [at[o] for o in FACTORS if o != f]
        parts = L.spectral_compression(g[[[k] for k in span], span]), L.orthogonal_escape(g, span, at[f]), L.residual_alignment(g, span, at[f], at["target"])
        rows.append((f, *map(float, parts), *L.jump_worth(*parts)))
    return spark.createDataFrame(rows, "factor string, compression double, escape double, alignment double, score double, worth boolean")


@query("validation_chain")
def validation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    return E.validation_chain(w, list(FACTORS), M.regimes(w, lookback=12))


@query("regime_forecast")
def regime_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regime_forecast(M.regimes(wide(spark, sf_dir), lookback=12))


@query("boosted_importance")
def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(D.boosted(wide(spark, sf_dir), list(FACTORS)).items()), "factor string, importance double")


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    return D.permutation_importance(w, list(FACTORS), D.ridge(w, list(FACTORS)))


@query("held_out_models")
def held_out_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.held_out(wide(spark, sf_dir), list(FACTORS), per_year=12)


@query("capacity_limit")
def capacity_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    return spark.createDataFrame([(f, float(P.capacity_limit([(r.capital, r.net) for r in P.capacity(w, f).collect()]))) for f in FACTORS], "factor string, capital double")


# -- SQL for queries of other modules --

_LIN = f"WITH {_SIGNAL_SQL}, li2 AS (SELECT t_idx, CASE WHEN count(*) >= 5 THEN corr(signal, target) END AS ic FROM ok GROUP BY t_idx) SELECT {q6('avg(ic)')} AS linear_ic_mean, {q6('avg(ic) / stddev_samp(ic)')} AS linear_icir FROM li2"
SQL["factor_stats"] = f"SELECT * FROM ({SQL['ic_statistics']}) a, ({_LIN}) b, ({SQL['quantile_returns']}) c, ({SQL['turnover']}) d"
SQL["orthogonal_factors"] = f"""WITH {_F}, w AS (SELECT asset_id, t_idx, max(v) FILTER (factor = 'f1') AS x, max(v) FILTER (factor = 'f2') AS y, max(v) FILTER (factor = 'f3') AS z FROM fv GROUP BY ALL HAVING count(*) FILTER (factor IN ('f1', 'f2', 'f3')) = 3),
g AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * y) AS yy, sum(y * z) AS yz FROM w), h AS (SELECT xy / xx AS a, xz / xx AS b, (yz - xy * xz / xx) / (yy - xy * xy / xx) AS c FROM g),
o AS (SELECT asset_id, t_idx, x AS e1, y - a * x AS e2, z - b * x - c * (y - a * x) AS e3 FROM w, h)
SELECT factor, asset_id, t_idx, {q6('v')} AS v FROM (SELECT 'f1' AS factor, asset_id, t_idx, e1 AS v FROM o UNION ALL SELECT 'f2', asset_id, t_idx, e2 FROM o UNION ALL SELECT 'f3', asset_id, t_idx, e3 FROM o)"""
_DC = """dd AS (SELECT i.a, i.b, i.t_idx, i.asset_id AS i, j.asset_id AS j, abs(i.x - j.x) AS p, abs(i.y - j.y) AS q FROM pr i JOIN pr j ON i.a = j.a AND i.b = j.b AND i.t_idx = j.t_idx),
dn AS (SELECT a, b, t_idx, p - avg(p) OVER r - avg(p) OVER c + avg(p) OVER w AS p, q - avg(q) OVER r - avg(q) OVER c + avg(q) OVER w AS q FROM dd WINDOW r AS (PARTITION BY a, b, t_idx, i), c AS (PARTITION BY a, b, t_idx, j), w AS (PARTITION BY a, b, t_idx)),
ds AS (SELECT a, b, t_idx, sqrt(count(*)) AS n, CASE WHEN sqrt(avg(p * p) * avg(q * q)) > 1e-12 THEN sqrt(greatest(avg(p * q), 0) / sqrt(avg(p * p) * avg(q * q))) ELSE 0.0 END AS r FROM dn GROUP BY ALL)"""
SQL["dependence_distance"] = f"WITH {_F}, {_DC} SELECT a, b, {q6('avg(r)')} AS rho FROM ds WHERE n >= 3 GROUP BY ALL"
SQL["dependence_profile"] = f"""WITH {_F}, {_DC}, {_SP}, d1 AS (SELECT a, b, avg(r) AS distance FROM ds WHERE n >= 5 GROUP BY ALL), d2 AS (SELECT a, b, avg(r) AS pearson FROM (SELECT a, b, t_idx, count(*) AS n, abs({_CORR}) AS r FROM pr GROUP BY ALL) WHERE n >= 5 GROUP BY ALL),
d3 AS (SELECT a, b, avg(r) AS spearman FROM d WHERE n >= 5 GROUP BY ALL), al AS (SELECT *, -ln(1 - least(spearman * spearman, 1 - 1e-12)) / 2 AS information FROM d1 JOIN d2 USING (a, b) JOIN d3 USING (a, b))
SELECT a, b, {', '.join(q6(c) + f' AS {c}' for c in ('distance', 'pearson', 'spearman', 'information'))}, {q6('greatest(distance, 1 - exp(-information))')} AS score FROM al"""
SQL["comomentum"] = f"""WITH {_SIGNAL_SQL}, {_LW}, en AS (SELECT t_idx AS "end", asset_id, sign(w) AS leg FROM lw WHERE t_idx % 5 = 0 AND t_idx >= 19), y AS (SELECT asset_id, t_idx, returns - avg(returns) OVER (PARTITION BY t_idx) AS e FROM s),
hd AS (SELECT "end", leg, y.asset_id, y.t_idx, e FROM en JOIN y ON y.asset_id = en.asset_id AND y.t_idx <= "end" AND y.t_idx > "end" - 20 WHERE e IS NOT NULL),
pc AS (SELECT a."end", a.leg, a.asset_id, b.asset_id AS other, corr(a.e, b.e) AS r, count(*) AS n FROM hd a JOIN hd b ON a."end" = b."end" AND a.leg = b.leg AND a.t_idx = b.t_idx AND a.asset_id < b.asset_id GROUP BY ALL)
SELECT "end", {q6('avg(r)')} AS comomentum FROM pc WHERE n >= 3 GROUP BY "end\""""
SQL["consensus_overlap"] = f"""WITH {_SIGNAL_SQL}, {_LEG}, c AS (SELECT t_idx, avg(target) AS market, stddev_samp(target) AS spread FROM s GROUP BY t_idx), a AS (SELECT ls, row_number() OVER (ORDER BY t_idx DESC) AS i FROM ls), b AS (SELECT market, spread, row_number() OVER (ORDER BY t_idx DESC) AS i FROM c)
SELECT 'market' AS factor, {q6('corr(ls, market)')} AS correlation FROM a JOIN b USING (i) UNION ALL SELECT 'spread', {q6('corr(ls, spread)')} FROM a JOIN b USING (i)"""
_WHOLE = f"ed AS (SELECT DISTINCT l_suppkey AS a, l_partkey + {PART} AS b FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL), bo AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed)"
SQL["graph_neighbours_whole"] = f"WITH {_WHOLE}, h1 AS (SELECT DISTINCT b AS node FROM bo WHERE a = {PART + 1}), h2 AS (SELECT DISTINCT bo.b AS node FROM h1 JOIN bo ON bo.a = h1.node), u AS (SELECT {PART + 1} AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, min(hop) AS hop FROM u GROUP BY node"
# every supplier and part lies within a few steps of the smallest of its component: ten rounds of the least label settle all
_ROUNDS = ", ".join(f"r{k} AS (SELECT o.node, least(o.m, min(n.m)) AS m FROM r{k - 1} o JOIN bo ON bo.a = o.node JOIN r{k - 1} n ON n.node = bo.b GROUP BY o.node, o.m)" for k in range(1, 11))
SQL["graph_components_whole"] = f"WITH {_WHOLE}, r0 AS (SELECT DISTINCT a AS node, a AS m FROM bo), {_ROUNDS} SELECT node, m AS root FROM r10"
_fam: dict[str, list[bool]] = {}
for _f, _x in FACTORS.items():
    _fam.setdefault(family(parse(_x)), []).append(_f == "f1")
SQL["formula_families"] = " UNION ALL ".join(f"SELECT '{k}' AS family, {len(v)}::BIGINT AS tried, {sum(v)}::BIGINT AS admitted, {sum(v) / len(v)}::DOUBLE AS rate, false AS saturated" for k, v in _fam.items())
