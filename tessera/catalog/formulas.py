"""One query for each formula operator and semantics, and a few whole formulas.

x is the bar's move and y its range, in thousands; both are missing where the panel has no bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog.base import PANEL_E, PANEL_M, QUERIES, SQL, q6, r6
from tessera.functions.specs import KERNEL_DIFFERS, SPECS
from tessera.plans.compiler import evaluate
from tessera.sources.panels import daily, dense, dense_monthly

X, Y, Z = "Mul(Sub($close, $open), 0.001)", "Mul(Sub($high, $low), 0.001)", "$volume"
W = 6

_V = "list_filter(wx, lambda e: e IS NOT NULL)"
_PAIR = f"list_transform(range(1, {W + 1}), lambda i: (wx[i] - mx) * (wy[i] - my))"
_OK = f"len(list_filter({_PAIR}, lambda e: e IS NOT NULL))"
_SUMS = f"CASE WHEN {_OK} > 0 THEN list_sum({_PAIR}) END"
_VY = f"(list_var_pop(wy) * len(list_filter(wy, lambda e: e IS NOT NULL)))"
_BETA = f"CASE WHEN {_VY} > 1e-10 THEN coalesce({_SUMS}, 0) / ({_VY}) ELSE 0 END"
_KBETA0 = f"CASE WHEN list_var_pop(wy) > 1e-10 THEN ({_SUMS}) / {_OK} / list_var_pop(wy) ELSE 0 END"
_U = f"list_transform(range(1, {W + 1}), lambda i: (wx[i] - mx) * (i - {(W + 1) / 2}))"
_SLOPE = f"(CASE WHEN mx IS NOT NULL THEN list_sum({_U}) / {W * (W * W - 1) / 12.0} END)"
_FIT = f"(mx + {_SLOPE} * {(W - 1) / 2})"
_RES = f"list_sum(list_transform(range(1, {W + 1}), lambda i: pow(wx[i] - mx - {_SLOPE} * (i - {(W + 1) / 2}), 2)))"
_TOT = f"list_sum(list_transform({_V}, lambda e: pow(e - mx, 2)))"
_WMA = f"list_sum(list_transform(range(1, {W + 1}), lambda i: wx[i] * i)) / {W * (W + 1) / 2}"
_A = 2.0 / (W + 1)
_DEC = f"list_sum(list_transform(range(1, {W + 1}), lambda i: wx[i] * {_A} * pow({1 - _A}, {W} - i)))"
_ALL = f"len({_V}) = {W}"
_Z = "(e - mx) / (CASE WHEN sx > 1e-10 THEN sx ELSE 1.0 END)"


def _bool(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


#: SQL of each operator on columns x, y, z, and for rolling ones on the window's lists wx, wy with mx, my, sx.
TREE: dict[str, str] = {
    "Add": "x + y", "Sub": "x - y", "Mul": "x * y", "Div": "CASE WHEN abs(y) > 1e-10 THEN x / y ELSE 0.0 END", "Neg": "-x", "Abs": "abs(x)", "Sign": "sign(x)::DOUBLE",
    "Log": "sign(x) * ln(1 + abs(x))", "Sqrt": "sign(x) * sqrt(abs(x))", "Square": "x * x", "Pow": "sign(x) * pow(abs(x), y / 100)", "SignedPower": "sign(x) * pow(abs(x), 1.5)", "Power": "pow(x, 3)",
    "Exp": "CASE WHEN x IS NOT NULL THEN exp(greatest(-50.0, least(x / 10, 50.0))) END", "Tanh": "tanh(x)",
    "Max": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END", "Min": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END",
    "Clip": "CASE WHEN x IS NOT NULL THEN greatest(-1.0, least(x, 2.0)) END", "Inv": "CASE WHEN abs(x) > 1e-10 THEN 1.0 / x ELSE 0.0 END",
    "Mean": f"list_avg({_V})", "Std": f"list_stddev_samp({_V})", "Var": f"list_var_samp({_V})",
    "Skew": f"CASE WHEN len({_V}) > 0 THEN list_avg(list_transform({_V}, lambda e: pow({_Z}, 3))) * {W * W / ((W - 1) * (W - 2))} END",
    "Kurt": f"CASE WHEN len({_V}) > 0 THEN list_avg(list_transform({_V}, lambda e: pow({_Z}, 4))) - 3 END",
    "Median": f"list_median({_V})", "Sum": f"coalesce(list_sum({_V}), 0)", "Prod": f"coalesce(list_product({_V}), 1)", "TsMax": f"list_max({_V})", "TsMin": f"list_min({_V})",
    "TsArgMax": f"(list_position(wx, list_max({_V})) - 1)::DOUBLE", "TsArgMin": f"(list_position(wx, list_min({_V})) - 1)::DOUBLE",
    "TsRank": f"len(list_filter(wx, lambda e: e <= x)) / {W}.0", "Quantile": f"list_aggregate({_V}, 'quantile_cont', 0.3)",
    "CountNaN": f"({W} - len({_V}))::DOUBLE", "CountNotNaN": f"len({_V})::DOUBLE",
    "Delta": "x - lag3", "Delay": "lag3", "Return": "CASE WHEN t_idx >= 3 THEN CASE WHEN abs(lag3) > 1e-10 THEN (x - lag3) / lag3 ELSE 0.0 END END",
    "LogReturn": "CASE WHEN t_idx >= 3 THEN ln(abs(x / CASE WHEN abs(lag3) > 1e-10 THEN lag3 ELSE 1.0 END) + 1e-10) END",
    "Corr": f"CASE WHEN sx * sy > 1e-10 THEN ({_SUMS}) / {_OK} / (sx * sy) ELSE 0.0 END", "Cov": f"({_SUMS}) / {_OK}", "Beta": _BETA, "Resid": f"x - (mx + ({_BETA}) * (y - my))",
    "WMA": f"CASE WHEN {_ALL} THEN {_WMA} END", "Decay": f"CASE WHEN {_ALL} THEN {_DEC} END",
    "CumSum": "coalesce(sum(x) OVER c, 0)", "CumProd": "coalesce(product(1 + x * 0.001) OVER c, 1)", "CumMax": "coalesce(max(x) OVER c, '-inf'::DOUBLE)", "CumMin": "coalesce(min(x) OVER c, 'inf'::DOUBLE)",
    "EMA": f"list_reduce(cx, lambda a, e: {_A} * e + {1 - _A} * a)", "SMA": f"list_avg({_V})", "KAMA": f"list_reduce(cx, lambda a, e: {_A} * e + {1 - _A} * a)",
    "CsRank": "CASE WHEN x IS NOT NULL THEN row_number() OVER n / count(x) OVER b END", "CsZScore": "CASE WHEN count(x) OVER b >= 2 THEN (x - avg(x) OVER b) / greatest(stddev_samp(x) OVER b, 1e-10) END",
    "CsDemean": "x - avg(x) OVER b", "CsScale": "x / CASE WHEN sum(abs(x)) OVER b > 1e-10 THEN sum(abs(x)) OVER b ELSE 1.0 END",
    "CsQuantile": "CASE WHEN x IS NOT NULL THEN greatest(1.0, least(ceil(row_number() OVER n / count(x) OVER b * 4), 4.0)) END",
    "TsLinReg": _FIT, "TsLinRegSlope": _SLOPE, "TsLinRegIntercept": f"mx - {_SLOPE} * {(W - 1) / 2}", "TsLinRegResid": f"x - {_FIT}", "Rsquare": f"CASE WHEN {_TOT} > 1e-10 THEN 1 - {_RES} / {_TOT} END",
    "IfElse": "CASE WHEN x > 0 THEN y ELSE z END", "Greater": _bool("x > y"), "GreaterEqual": _bool("x >= y"), "Less": _bool("x < y"), "LessEqual": _bool("x <= y"),
    "Equal": _bool("abs(x - y) < 1e-10"), "Ne": _bool("abs(x - y) >= 1e-10"), "And": _bool("x > 0 AND y > 0"), "Or": _bool("coalesce(x > 0, false) OR coalesce(y > 0, false)"), "Not": _bool("x <= 0"),
}
for _alias, _spec in SPECS.items():
    if _spec.alias_of and _spec.alias_of in TREE:
        TREE[_alias] = TREE[_spec.alias_of]

_BOTH = "x IS NOT NULL AND y IS NOT NULL"
_M = lambda k: f"list_avg(list_transform({_V}, lambda e: pow(e - mx, {k})))"
_CARRY = f"list_reduce(cx, lambda a, e: CASE WHEN e IS NULL THEN a WHEN a IS NULL THEN e ELSE {_A} * e + {1 - _A} * a END)"
KERNEL: dict[str, str] = {
    "Div": "CASE WHEN abs(y) > 1e-10 THEN x / y END", "Inv": "CASE WHEN abs(x) > 1e-10 THEN 1.0 / x END", "Pow": TREE["Pow"], "Max": "greatest(x, y)", "Min": "least(x, y)",
    "Skew": f"CASE WHEN len({_V}) >= 3 AND {_M(2)} > 0 THEN {_M(3)} / pow({_M(2)}, 1.5) END", "Kurt": f"CASE WHEN len({_V}) >= 4 AND {_M(2)} > 0 THEN {_M(4)} / pow({_M(2)}, 2) - 3 END",
    "Sum": f"list_sum({_V})", "Prod": f"list_product({_V})", "TsRank": f"CASE WHEN len({_V}) > 1 THEN len(list_filter(wx, lambda e: e < x)) / (len({_V}) - 1.0) END",
    "Return": "CASE WHEN t_idx >= 3 AND abs(lag3) > 1e-10 THEN (x - lag3) / lag3 END", "LogReturn": "CASE WHEN t_idx >= 3 AND abs(lag3) > 1e-10 AND x / lag3 > 0 THEN ln(x / lag3) END",
    "Corr": f"CASE WHEN list_stddev_pop(wx) > 1e-10 AND list_stddev_pop(wy) > 1e-10 THEN ({_SUMS}) / {_OK} / (list_stddev_pop(wx) * list_stddev_pop(wy)) END",
    "Beta": f"CASE WHEN list_var_pop(wy) > 1e-10 THEN ({_SUMS}) / {_OK} / list_var_pop(wy) END", "WMA": f"coalesce({_WMA}, 0)", "Decay": f"coalesce({_WMA}, 0)",
    "CumMax": "max(x) OVER c", "CumMin": "min(x) OVER c", "EMA": _CARRY, "SMA": f"coalesce(list_sum({_V}), 0) / {W}",
    "CsRank": "CASE WHEN x IS NOT NULL AND count(x) OVER b >= 2 THEN (row_number() OVER n - 1) / (count(x) OVER b - 1) END", "CsZScore": "CASE WHEN stddev_pop(x) OVER b > 1e-10 THEN (x - avg(x) OVER b) / stddev_pop(x) OVER b END",
    "CsScale": "CASE WHEN sum(abs(x)) OVER b > 1e-10 THEN x / sum(abs(x)) OVER b END", "CsQuantile": "CASE WHEN x IS NOT NULL AND count(x) OVER b >= 2 THEN least(floor((row_number() OVER n - 1) / count(x) OVER b * 4), 3.0) END",
    "IfElse": "CASE WHEN x IS NOT NULL THEN CASE WHEN x > 0 THEN y ELSE z END END", "Not": "CASE WHEN x IS NOT NULL THEN " + TREE["Not"] + " END",
    **{k: f"CASE WHEN {_BOTH} THEN {TREE[k]} END" for k in ("Greater", "GreaterEqual", "Less", "LessEqual", "Equal", "Ne", "And", "Or")},
}
for _alias, _spec in SPECS.items():
    if _spec.alias_of and _spec.alias_of in KERNEL:
        KERNEL[_alias] = KERNEL[_spec.alias_of]

_PARAMS = {"SignedPower": "1.5", "Power": "3", "Clip": "-1, 2", "Quantile": f"{W}, 0.3", "CsQuantile": "4", **dict.fromkeys(("Delta", "Delay", "Return", "LogReturn"), "3")}
_OPERANDS = {"Pow": (X, "Mul(Sub($high, $low), 0.00001)"), "Exp": ("Mul(Sub($close, $open), 0.0001)",), "CumProd": (f"Add(1, Mul({X}, 0.001))",)}


def formula_of(op: str) -> str:
    spec = SPECS[op]
    args = list(_OPERANDS.get(op, (X, Y, Z)[: spec.arity]))
    given = _PARAMS.get(op, str(W) if any(p[0] == "window" for p in spec.params) else "")
    return f"{op}({', '.join([*args, *([given] if given else [])])})"


def sql_of(expression: str, rolling: bool) -> str:
    inner = f"CASE WHEN t_idx >= {W - 1} THEN {expression} END" if rolling else expression
    return f"""
WITH {PANEL_M},
a AS (SELECT asset_id, t_idx, (close - open) * 0.001 AS x, (high - low) * 0.001 AS y, volume AS z FROM p),
q AS (SELECT *, list(x) OVER w AS wx, list(y) OVER w AS wy, list(x) OVER c AS cx, lag(x, 3) OVER o AS lag3, avg(x) OVER w AS mx, avg(y) OVER w AS my, stddev_samp(x) OVER w AS sx, stddev_samp(y) OVER w AS sy FROM a
      WINDOW w AS (PARTITION BY asset_id ORDER BY t_idx ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW), c AS (PARTITION BY asset_id ORDER BY t_idx ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY asset_id ORDER BY t_idx)),
v AS (SELECT asset_id, t_idx, {inner} AS v FROM q
      WINDOW c AS (PARTITION BY asset_id ORDER BY t_idx ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY t_idx), n AS (PARTITION BY t_idx, x IS NULL ORDER BY x, asset_id))
SELECT asset_id, t_idx, {q6('v')} AS v FROM v"""


def _query(formula: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate(dense_monthly(spark, sf_dir), {"v": formula}, mode)
        return out.select("asset_id", "t_idx", r6("v").alias("v"))

    return run


for _op, _spec in SPECS.items():
    _roll = _spec.kind == "time" and _op not in ("Delta", "Delay", "Return", "LogReturn") or _op == "SMA"
    QUERIES[f"op_{_op}"] = _query(formula_of(_op), "tree")
    if _op in TREE:
        SQL[f"op_{_op}"] = sql_of(TREE[_op], _roll)
    if _op in KERNEL_DIFFERS:
        QUERIES[f"op_{_op}_kernel"] = _query(formula_of(_op), "kernel")
        if _op in KERNEL:
            SQL[f"op_{_op}_kernel"] = sql_of(KERNEL[_op], _roll)


def _wma(x: str, w: int, name: str) -> str:
    return f"CASE WHEN t_idx >= {w - 1} AND count({x}) OVER {name} = {w} THEN (sum(t_idx * {x}) OVER {name} - (t_idx - {w}) * sum({x}) OVER {name}) / {w * (w + 1) / 2} END"


_HEAD = f"WITH {PANEL_M}, a AS (SELECT asset_id, t_idx, (close - open) * 0.001 AS x FROM p)"
_WIN = lambda n, w: f"{n} AS (PARTITION BY asset_id ORDER BY t_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
SQL["op_HMA"] = f"""{_HEAD},
h AS (SELECT asset_id, t_idx, 2 * coalesce({_wma('x', W // 2, 'h')}, 0) - coalesce({_wma('x', W, 'f')}, 0) AS d FROM a WINDOW {_WIN('h', W // 2)}, {_WIN('f', W)}),
v AS (SELECT asset_id, t_idx, {_wma('d', 2, 's')} AS v FROM h WINDOW {_WIN('s', 2)})
SELECT asset_id, t_idx, {q6('v')} AS v FROM v"""
_KW = lambda x, w, n: f"CASE WHEN t_idx >= {w - 1} THEN coalesce((sum(t_idx * {x}) OVER {n} - (t_idx - {w}) * sum({x}) OVER {n}) / {w * (w + 1) / 2}, 0) END"
SQL["op_HMA_kernel"] = f"""{_HEAD},
h AS (SELECT asset_id, t_idx, 2 * {_KW('x', W // 2, 'h')} - {_KW('x', W, 'f')} AS d FROM a WINDOW {_WIN('h', W // 2)}, {_WIN('f', W)}),
v AS (SELECT asset_id, t_idx, {_KW('d', 2, 's')} AS v FROM h WINDOW {_WIN('s', 2)})
SELECT asset_id, t_idx, {q6('v')} AS v FROM v"""
_RUN = "OVER (PARTITION BY asset_id ORDER BY t_idx ROWS UNBOUNDED PRECEDING)"
for _name, _step in (("op_DEMA", f"{_A} * e + {1 - _A} * a"), ("op_DEMA_kernel", f"CASE WHEN e IS NULL THEN a WHEN a IS NULL THEN e ELSE {_A} * e + {1 - _A} * a END")):
    SQL[_name] = f"""{_HEAD},
e1 AS (SELECT asset_id, t_idx, list_reduce(l, lambda a, e: {_step}) AS e1 FROM (SELECT *, list(x) {_RUN} AS l FROM a)),
e2 AS (SELECT asset_id, t_idx, e1, list_reduce(l, lambda a, e: {_step}) AS e2 FROM (SELECT *, list(e1) {_RUN} AS l FROM e1))
SELECT asset_id, t_idx, {q6('2 * e1 - e2')} AS v FROM e2"""

_STEP = f"pow(CASE WHEN walked > 1e-10 THEN moved / walked ELSE 0.0 END * {2 / 3 - 2 / 31} + {2 / 31}, 2)"
SQL["op_KAMA_kernel"] = f"""{_HEAD},
d AS (SELECT *, abs(x - lag(x) OVER o) AS d, abs(x - lag(x, {W}) OVER o) AS moved FROM a WINDOW o AS (PARTITION BY asset_id ORDER BY t_idx)),
s AS (SELECT asset_id, t_idx, x, {_STEP} AS s FROM (SELECT *, sum(coalesce(d, 0)) OVER w AS walked FROM d WINDOW {_WIN('w', W)})),
l AS (SELECT asset_id, t_idx, list({{'x': x, 's': s, 't': t_idx}}) {_RUN} AS l FROM s)
SELECT asset_id, t_idx, {q6(f"list_reduce(l, lambda a, e: {{'x': CASE WHEN e.t < {W} OR a.x IS NULL OR e.x IS NULL THEN e.x ELSE a.x + e.s * (e.x - a.x) END, 's': e.s, 't': e.t}}).x")} AS v FROM l"""

#: Whole formulas: several stages planned together over the sparser panel.
_FORMULAS = {
    "reversal": "Neg(CsRank(Delta($close, 2)))",
    "volume_trend": "CsZScore(Sub(Mean($volume, 3), Mean($volume, 8)))",
    "range_rank": "CsRank(Div(Sub($close, $low), Add(Sub($high, $low), 1)))",
    "conditional": "IfElse(Greater($close, Mean($close, 5)), CsRank($volume), Neg(CsRank($volume)))",
}


def formulas_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate(dense(daily(spark, sf_dir), unique=True), _FORMULAS)
    return out.select("asset_id", "t_idx", *[r6(k).alias(k) for k in _FORMULAS])


QUERIES["formulas_together"] = formulas_together
SQL["formulas_together"] = f"""
WITH {PANEL_E},
a AS (SELECT *, close - lag(close, 2) OVER (PARTITION BY asset_id ORDER BY t_idx) AS d2,
      CASE WHEN t_idx >= 7 THEN avg(volume) OVER w3 - avg(volume) OVER w8 END AS vt, CASE WHEN abs(high - low + 1) > 1e-10 THEN (close - low) / (high - low + 1) ELSE 0.0 END AS rr,
      CASE WHEN t_idx >= 4 THEN avg(close) OVER w5 END AS m5 FROM p
      WINDOW {_WIN('w3', 3)}, {_WIN('w8', 8)}, {_WIN('w5', 5)}),
b AS (SELECT asset_id, t_idx, CASE WHEN d2 IS NOT NULL THEN row_number() OVER (PARTITION BY t_idx, d2 IS NULL ORDER BY d2, asset_id) / count(d2) OVER b END AS rd,
      CASE WHEN count(vt) OVER b >= 2 THEN (vt - avg(vt) OVER b) / greatest(stddev_samp(vt) OVER b, 1e-10) END AS vz,
      row_number() OVER (PARTITION BY t_idx, rr IS NULL ORDER BY rr, asset_id) / count(rr) OVER b AS rrr,
      CASE WHEN volume IS NOT NULL THEN row_number() OVER (PARTITION BY t_idx, volume IS NULL ORDER BY volume, asset_id) / count(volume) OVER b END AS rv, coalesce(close > m5, false) AS up
      FROM a WINDOW b AS (PARTITION BY t_idx))
SELECT asset_id, t_idx, {q6('-rd')} AS reversal, {q6('vz')} AS volume_trend, {q6('rrr')} AS range_rank, {q6('CASE WHEN up THEN rv ELSE -rv END')} AS conditional FROM b"""
