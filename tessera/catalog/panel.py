"""Queries of the panel and evaluation operators. Targets are computed on raw rows, before the panel is made dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.base import PANEL_E, PANEL_M, q6, query, r6
from tessera.operators import metrics as M
from tessera.operators import preparing as P
from tessera.plans.compiler import evaluate
from tessera.sources.panels import daily, dense, monthly, with_vwap_returns
from tessera.sources.store import stored

SIGNAL = "CsRank(Div(Sub($close, Mean($close, 6)), Std($close, 6)))"
_SIGNAL_SQL = f"""{PANEL_M},
tg AS (SELECT asset_id, datetime, lead(close) OVER r / lead(open) OVER r - 1 AS target, close / lag(close) OVER r - 1 AS returns FROM raw WINDOW r AS (PARTITION BY asset_id ORDER BY datetime)),
z AS (SELECT p.asset_id, p.t_idx, p.datetime, target, returns, avg(close) OVER w AS m, CASE WHEN t_idx >= 5 THEN stddev_samp(close) OVER w END AS sd, close FROM p LEFT JOIN tg ON tg.asset_id = p.asset_id AND tg.datetime = p.datetime
      WINDOW w AS (PARTITION BY p.asset_id ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
zz AS (SELECT *, CASE WHEN abs(sd) > 1e-10 THEN (close - m) / sd ELSE 0.0 END AS v FROM z),
s AS (SELECT asset_id, t_idx, datetime, target, returns, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY t_idx, v IS NULL ORDER BY v, asset_id) / count(v) OVER (PARTITION BY t_idx) END AS signal FROM zz),
ok AS (SELECT * FROM s WHERE signal IS NOT NULL AND target IS NOT NULL),
rk AS (SELECT t_idx, rank() OVER (PARTITION BY t_idx ORDER BY signal) + (count(*) OVER (PARTITION BY t_idx, signal) - 1) / 2.0 AS x, rank() OVER (PARTITION BY t_idx ORDER BY target) + (count(*) OVER (PARTITION BY t_idx, target) - 1) / 2.0 AS y FROM ok),
ic AS (SELECT t_idx, count(*) AS n, CASE WHEN count(*) >= 5 THEN CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 AND abs(corr(x, y)) > 1e-12 THEN corr(x, y) ELSE 0.0 END END AS ic FROM rk GROUP BY t_idx)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, t_idx, datetime, signal, target, returns) of the monthly panel."""
    raw = P.with_targets(with_vwap_returns(monthly(spark, sf_dir)))
    return evaluate(stored(spark, "monthly_target", monthly(spark, sf_dir), lambda _: dense(raw, unique=True)), {"signal": SIGNAL}).select("asset_id", "t_idx", "datetime", "signal", F.col("target_paper").alias("target"), "returns")


@query("rank_ic_monthly", f"WITH {_SIGNAL_SQL} SELECT t_idx, n, {q6('ic')} AS ic FROM ic")
def rank_ic_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ic_series(signals(spark, sf_dir)).select("t_idx", "n", r6("ic").alias("ic"))


@query("linear_ic_monthly", f"WITH {_SIGNAL_SQL} SELECT t_idx, count(*) AS n, {q6('CASE WHEN count(*) >= 5 THEN corr(signal, target) END')} AS ic FROM ok GROUP BY t_idx")
def linear_ic_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ic_series(signals(spark, sf_dir), rank=False).select("t_idx", "n", r6("ic").alias("ic"))


@query("ic_statistics", f"""WITH {_SIGNAL_SQL} SELECT count(ic) AS n_bars, {q6('avg(ic)')} AS ic_mean, {q6('abs(avg(ic))')} AS ic_paper, {q6('avg(abs(ic))')} AS ic_abs_mean, {q6('stddev_samp(ic)')} AS ic_std,
{q6('avg(ic) / stddev_samp(ic)')} AS icir, {q6('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS win_rate, {q6('max(ic)')} AS ic_max, {q6('min(ic)')} AS ic_min FROM ic""")
def ic_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.ic_stats(M.ic_series(signals(spark, sf_dir)))
    return got.select("n_bars", *[r6(c).alias(c) for c in got.columns[1:]])


_BUCKET = """rr AS (SELECT t_idx, target AS y, rank() OVER (PARTITION BY t_idx ORDER BY signal) + (count(*) OVER (PARTITION BY t_idx, signal) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY t_idx) AS n FROM s WHERE signal IS NOT NULL)"""
_QS = f"""WITH {_SIGNAL_SQL}, {_BUCKET},
b AS (SELECT t_idx, q, CASE WHEN count(y) = count(*) THEN avg(y) END AS r FROM (SELECT t_idx, y, greatest(1, least(5, ceil(r / n * 5)))::INT AS q FROM rr WHERE n >= 5) GROUP BY ALL),
m AS (SELECT q, coalesce(avg(r), 0) AS r FROM b GROUP BY q),
mono AS (SELECT corr(q, k) AS c FROM (SELECT q, rank() OVER (ORDER BY r) AS k FROM m))
SELECT {', '.join(q6(f'max(r) FILTER (q = {k})') + f' AS Q{k}' for k in range(1, 6))}, {q6('max(r) FILTER (q = 5) - max(r) FILTER (q = 1)')} AS long_short, {q6('(SELECT c FROM mono)')} AS monotonicity FROM m"""


@query("quantile_returns", _QS)
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.quantile_returns(signals(spark, sf_dir))
    return got.select(*[r6(c).alias(c) for c in got.columns])


_TOP = """tp AS (SELECT asset_id, t_idx, count(signal) OVER (PARTITION BY t_idx) AS valid, row_number() OVER (PARTITION BY t_idx ORDER BY signal DESC NULLS LAST, asset_id DESC) AS place FROM s)"""


@query("turnover", f"""WITH {_SIGNAL_SQL}, {_TOP}, k AS (SELECT greatest(floor(count(DISTINCT asset_id) * 0.2), 1) AS k FROM s), t AS (SELECT asset_id, t_idx FROM tp, k WHERE valid >= k AND place <= k),
u AS (SELECT DISTINCT t_idx FROM t), o AS (SELECT a.t_idx, count(*) AS c FROM t a JOIN t b ON a.asset_id = b.asset_id AND a.t_idx = b.t_idx + 1 GROUP BY a.t_idx)
SELECT {q6('avg(1 - coalesce(c, 0) / (SELECT k FROM k))')} AS turnover FROM u x JOIN u y ON x.t_idx = y.t_idx + 1 LEFT JOIN o ON o.t_idx = x.t_idx""")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.turnover(signals(spark, sf_dir)).select(r6("turnover").alias("turnover"))


_TURN = f"""{_TOP}, t AS (SELECT asset_id, t_idx, greatest(floor(valid * 0.2), 1) AS k FROM tp WHERE valid >= 5 AND place <= greatest(floor(valid * 0.2), 1)),
u AS (SELECT t_idx, max(k) AS k FROM t GROUP BY t_idx), o AS (SELECT a.t_idx, count(*) AS c FROM t a JOIN t b ON a.asset_id = b.asset_id AND a.t_idx = b.t_idx + 1 GROUP BY a.t_idx),
tn AS (SELECT d.t_idx, coalesce((x.k + y.k - 2 * coalesce(c, 0)) / (2 * x.k), 0) AS turnover FROM (SELECT DISTINCT t_idx FROM s) d LEFT JOIN u x ON x.t_idx = d.t_idx LEFT JOIN u y ON y.t_idx = d.t_idx - 1 LEFT JOIN o ON o.t_idx = d.t_idx)"""
_BT = f"""{_SIGNAL_SQL}, {_BUCKET}, {_TURN},
b AS (SELECT t_idx, q, CASE WHEN count(y) = count(*) THEN avg(y) END AS r FROM (SELECT t_idx, y, 1 + (f >= 0.2)::INT + (f >= 0.4)::INT + (f >= 0.6)::INT + (f >= 0.8)::INT AS q FROM (SELECT t_idx, y, (r - 1) / greatest(n - 1, 1) AS f FROM rr WHERE n >= 5)) GROUP BY ALL),
qq AS (SELECT t_idx, {', '.join(f'max(r) FILTER (q = {k}) AS q{k}' for k in range(1, 6))} FROM b GROUP BY t_idx),
bt AS (SELECT tn.t_idx, turnover, q1, q2, q3, q4, q5, q5 - q1 AS gross, q5 - q1 - 2 * 0.0004 * turnover AS net FROM tn LEFT JOIN qq USING (t_idx))"""


@query("quintile_backtest", f"""WITH {_BT} SELECT t_idx, {', '.join(q6(c) + f' AS {c}' for c in ('turnover', 'q1', 'q2', 'q3', 'q4', 'q5', 'gross', 'net'))}, {q6('coalesce(sum(net) OVER (ORDER BY t_idx), 0)')} AS cumulative FROM bt""")
def quintile_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.backtest(signals(spark, sf_dir))
    return got.select("t_idx", *[r6(c).alias(c) for c in got.columns if c != "t_idx"])


@query("cost_pressure", f"""WITH {_BT}, c AS (SELECT unnest([1.0, 4.0, 7.0, 10.0, 11.0]::DOUBLE[]) AS cost_bps), x AS (SELECT cost_bps, gross - 2 * cost_bps / 10000 * turnover AS net FROM bt, c)
SELECT cost_bps, {q6('avg(net)')} AS net_mean, {q6('avg(net) / stddev_samp(net)')} AS net_ir FROM x GROUP BY cost_bps""")
def cost_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cost_pressure(M.backtest(signals(spark, sf_dir))).select("cost_bps", r6("net_mean").alias("net_mean"), r6("net_ir").alias("net_ir"))


@query("rolling_ic", f"WITH {_SIGNAL_SQL} SELECT t_idx, {q6('ic')} AS ic, {q6('avg(ic) OVER (ORDER BY t_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS rolling, {q6('avg(ic) OVER (ORDER BY t_idx)')} AS cumulative FROM ic")
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.rolling_ic(M.ic_series(signals(spark, sf_dir)))
    return got.select("t_idx", *[r6(c).alias(c) for c in ("ic", "rolling", "cumulative")])


_LEG = """lg AS (SELECT t_idx, target AS y, least(greatest(1, floor(n * 0.2)), floor(n / 2)) AS k, up, down FROM (SELECT *, count(*) OVER (PARTITION BY t_idx) AS n, row_number() OVER (PARTITION BY t_idx ORDER BY signal, asset_id) AS up,
row_number() OVER (PARTITION BY t_idx ORDER BY signal DESC, asset_id DESC) AS down FROM ok)), ls AS (SELECT t_idx, avg(y) FILTER (down <= k) - avg(y) FILTER (up <= k) AS ls FROM lg WHERE k > 0 GROUP BY t_idx)"""


@query("long_short_series", f"WITH {_SIGNAL_SQL}, {_LEG} SELECT t_idx, {q6('ls')} AS ls FROM ls")
def long_short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.legs(signals(spark, sf_dir)).select("t_idx", r6("ls").alias("ls"))


@query("drawdown_spells", f"""WITH {_SIGNAL_SQL}, {_LEG}, c AS (SELECT t_idx, sum(coalesce(ls, 0)) OVER (ORDER BY t_idx) AS c FROM ls), g AS (SELECT t_idx, c - max(c) OVER (ORDER BY t_idx) AS gap FROM c),
h AS (SELECT *, (sum((gap >= 0)::INT) OVER (ORDER BY t_idx))::BIGINT AS spell FROM g) SELECT spell, min(t_idx) AS start, arg_min(t_idx, {{'a': gap, 'b': t_idx}}) AS trough, max(t_idx) AS "end", {q6('min(gap)')} AS depth FROM h WHERE gap < 0 GROUP BY spell""")
def drawdown_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.drawdowns(M.legs(signals(spark, sf_dir)), "ls").withColumn("depth", r6("depth"))


@query("performance", f"""WITH {_SIGNAL_SQL}, {_LEG}, c AS (SELECT ls AS v, sum(ls) OVER (ORDER BY t_idx) AS c, t_idx FROM ls WHERE ls IS NOT NULL), g AS (SELECT v, max(c) OVER (ORDER BY t_idx) - c AS gap FROM c)
SELECT {q6('avg(v)')} AS mean, {q6('stddev_samp(v)')} AS std, {q6('avg(v) / stddev_samp(v) * sqrt(12)')} AS sharpe, {q6('max(gap)')} AS max_drawdown, {q6('avg(v) * 12 / max(gap)')} AS calmar FROM g""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.performance(M.legs(signals(spark, sf_dir)), "ls", 12)
    return got.select(*[r6(c).alias(c) for c in got.columns])


_REG = """mk AS (SELECT t_idx, avg(returns) AS market FROM s GROUP BY t_idx), rl AS (SELECT t_idx, market, CASE WHEN t_idx >= 11 THEN avg(market) OVER w END AS roll_mean, CASE WHEN t_idx >= 11 THEN stddev_samp(market) OVER w END AS roll_vol FROM mk
WINDOW w AS (ORDER BY t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
rg AS (SELECT *, CASE WHEN t_idx >= 12 AND roll_mean > 0 AND roll_vol < (SELECT quantile_cont(roll_vol, 0.7) FROM rl) THEN 'BULL' WHEN t_idx >= 12 AND roll_mean < 0 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM rl)"""


@query("regime_labels", f"WITH {_SIGNAL_SQL}, {_REG} SELECT t_idx, {q6('market')} AS market, {q6('roll_mean')} AS roll_mean, {q6('roll_vol')} AS roll_vol, regime FROM rg")
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.regimes(signals(spark, sf_dir), lookback=12)
    return got.select("t_idx", *[r6(c).alias(c) for c in ("market", "roll_mean", "roll_vol")], "regime")


@query("regime_ic", f"WITH {_SIGNAL_SQL}, {_REG} SELECT regime, count(ic) AS n, {q6('coalesce(avg(abs(ic)), 0)')} AS ic_abs_mean, {q6('coalesce(CASE WHEN count(ic) >= 3 THEN avg(ic) / stddev_samp(ic) END, 0)')} AS icir FROM ic JOIN rg USING (t_idx) GROUP BY regime")
def regime_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    return M.regime_ic(M.ic_series(s), M.regimes(s, lookback=12)).select("regime", "n", r6("ic_abs_mean").alias("ic_abs_mean"), r6("icir").alias("icir"))


@query("factor_stats")
def factor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.factor_stats(signals(spark, sf_dir))
    return got.select("n_bars", *[r6(c).alias(c) for c in got.columns if c != "n_bars"])


# -- panel preparation --

_SPECS = [P.Target("paper"), P.Target("cc2", 0, 2, "close_to_close"), P.Target("oo1", 1, 1, "open_to_open", True), P.Target("co1", 0, 1, "close_to_open")]


@query("forward_targets", f"""WITH {PANEL_M} SELECT asset_id, datetime, {q6('lead(close, 1) OVER r / lead(open, 1) OVER r - 1')} AS target_paper, {q6('lead(close, 2) OVER r / close - 1')} AS target_cc2,
{q6('ln(lead(open, 2) OVER r / lead(open, 1) OVER r)')} AS target_oo1, {q6('lead(open, 1) OVER r / close - 1')} AS target_co1 FROM raw WINDOW r AS (PARTITION BY asset_id ORDER BY datetime)""")
def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.with_targets(monthly(spark, sf_dir), _SPECS)
    return got.select("asset_id", "datetime", *[r6(f"target_{t.name}").alias(f"target_{t.name}") for t in _SPECS])


@query("load_filtered", f"WITH {PANEL_E} SELECT asset_id, datetime, close FROM raw WHERE asset_id IN ('00000001', '00000003') AND datetime >= (SELECT min(datetime) + INTERVAL 5 DAY FROM raw)")
def load_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.panels import canonical

    panel = canonical(daily(spark, sf_dir).withColumnsRenamed({"asset_id": "Ticker", "datetime": "Trade_Date", "volume": "VOL"}))
    first = panel.agg(F.min("datetime").alias("d"))
    return panel.where(F.col("asset_id").isin("00000001", "00000003")).join(F.broadcast(first), F.col("datetime") >= F.col("d") + F.expr("INTERVAL 5 DAYS")).select("asset_id", "datetime", "close")


_FIVE = "to_timestamp(floor(epoch(datetime) / 432000) * 432000)::TIMESTAMP"


@query("resample_bars", f"""WITH {PANEL_E}, b AS (SELECT asset_id, make_timestamp((floor(epoch(datetime) / 432000) * 432000000000)::BIGINT) AS d, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, sum(volume) AS volume, sum(amount) AS amount FROM raw GROUP BY ALL)
SELECT asset_id, d AS datetime, open, high, low, close, volume, {q6('amount')} AS amount, {q6('CASE WHEN volume > 0 THEN amount / volume ELSE close END')} AS vwap, {q6('CASE WHEN lag(close) OVER r <> 0 THEN close / lag(close) OVER r - 1 END')} AS returns FROM b WINDOW r AS (PARTITION BY asset_id ORDER BY d)""")
def resample_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.resample(daily(spark, sf_dir), "5 days")
    return got.select("asset_id", "datetime", "open", "high", "low", "close", "volume", *[r6(c).alias(c) for c in ("amount", "vwap", "returns")])


@query("halts", f"WITH {PANEL_E} SELECT asset_id, datetime, volume <= 1 AND open = high AND high = low AND low = close AS is_halt, CASE WHEN NOT (volume <= 1 AND open = high AND high = low AND low = close) THEN close END AS close FROM raw")
def halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mask_halts(P.flag_halts(daily(spark, sf_dir), 1.0)).select("asset_id", "datetime", "is_halt", "close")


@query("fill_missing", f"""WITH {PANEL_E}, m AS (SELECT t_idx, median(close) AS md, avg(volume) AS av FROM p GROUP BY t_idx) SELECT asset_id, t_idx, {q6('coalesce(close, md)')} AS close FROM p JOIN m USING (t_idx)""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fill(dense(daily(spark, sf_dir)), ["close"]).select("asset_id", "t_idx", r6("close").alias("close"))


@query("winsorised", f"""WITH {PANEL_M}, e AS (SELECT datetime, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM raw GROUP BY datetime) SELECT asset_id, datetime, {q6('greatest(lo, least(close, hi))')} AS close FROM raw JOIN e USING (datetime)""")
def winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.winsorise(monthly(spark, sf_dir), ["close"]).select("asset_id", "datetime", r6("close").alias("close"))


@query("standardised", f"""WITH {PANEL_M} SELECT asset_id, datetime, {q6('coalesce(CASE WHEN stddev_samp(close) OVER b > 0 THEN (close - avg(close) OVER b) / stddev_samp(close) OVER b END, 0)')} AS close FROM raw WINDOW b AS (PARTITION BY datetime)""")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.standardise(monthly(spark, sf_dir), ["close"]).select("asset_id", "datetime", r6("close").alias("close"))


@query("complete_bars", f"WITH {PANEL_E}, g AS (SELECT datetime FROM p WHERE close IS NOT NULL GROUP BY datetime HAVING count(*) >= 0.9 * (SELECT count(DISTINCT asset_id) FROM p)) SELECT asset_id, t_idx FROM p SEMI JOIN g USING (datetime)")
def complete_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.complete_bars(dense(daily(spark, sf_dir)), ["close"], 0.9).select("asset_id", "t_idx")


@query("preprocessed")
def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.preprocess(monthly(spark, sf_dir))


@query("dense_panel", f"WITH {PANEL_M} SELECT asset_id, datetime, t_idx, close, volume FROM p")
def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(monthly(spark, sf_dir)).select("asset_id", "datetime", "t_idx", "close", "volume")


@query("as_of_join", """WITH b AS (SELECT c_custkey AS asset_id, d AS datetime FROM customer, (SELECT unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '1999-01-01', INTERVAL 90 DAY)) AS d)),
f AS (SELECT o_custkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)
SELECT asset_id, datetime, o_totalprice AS fact FROM b ASOF LEFT JOIN f ON b.asset_id = f.o_custkey AND b.datetime >= f.o_orderdate""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = F.expr("sequence(TIMESTAMP_NTZ '1995-01-01', TIMESTAMP_NTZ '1998-12-31', INTERVAL 90 DAYS)")
    bars = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("asset_id"), F.explode(dates).alias("datetime"))
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").alias("filed"), F.col("o_totalprice").alias("fact"), "o_orderkey")
    return P.as_of(bars, facts, "fact", order="o_orderkey")


_FUT = f"""{PANEL_M}, fu AS (SELECT asset_id, datetime, close, amount, 1 + (extract(year FROM datetime) - 1995) * 0.01 AS f FROM raw)"""


@query("roll_adjusted", f"""WITH {_FUT}, l AS (SELECT *, last_value(f) OVER (PARTITION BY asset_id ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fl FROM fu)
SELECT asset_id, datetime, {q6('fl / f')} AS adjustment_factor, {q6('0.00137 * close * fl / f')} AS close FROM l""")
def roll_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fut = monthly(spark, sf_dir).withColumn("adjustment_factor", 1 + (F.year("datetime") - 1995) * F.lit(0.01))
    return P.roll_adjust(fut).select("asset_id", "datetime", r6("adjustment_factor").alias("adjustment_factor"), r6(F.col("close") * 0.00137).alias("close"))


@query("futures_basis", f"""WITH {_FUT}, x AS (SELECT u.*, r.open AS spot, lag(f) OVER (PARTITION BY u.asset_id ORDER BY u.datetime) AS f0 FROM fu u JOIN raw r ON r.asset_id = u.asset_id AND r.datetime = u.datetime)
SELECT asset_id, datetime, {q6('close - spot')} AS basis, {q6('CASE WHEN spot > 0 THEN close / spot - 1 END')} AS premium, {q6('CASE WHEN f0 > 0 THEN f / f0 - 1 ELSE 0.0 END')} AS roll_yield FROM x""")
def futures_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = monthly(spark, sf_dir)
    fut = raw.withColumn("adjustment_factor", 1 + (F.year("datetime") - 1995) * F.lit(0.01))
    got = P.basis(fut, raw.withColumn("close", F.col("open")))
    return got.select("asset_id", "datetime", r6("basis").alias("basis"), r6("premium").alias("premium"), r6("roll_yield").alias("roll_yield"))


@query("validation_report", f"""WITH {PANEL_E}, t AS (SELECT * FROM raw) SELECT count(*) AS n_rows, count(DISTINCT asset_id) AS n_assets, count(DISTINCT datetime) AS n_bars, 0::BIGINT AS repeated_keys,
{', '.join(f'(count(*) - count({c}))::BIGINT AS missing_{c}' for c in ('open', 'high', 'low', 'close', 'volume', 'amount'))},
count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low) AS broken_bars, count(*) FILTER (least(open, high, low, close) < 0 OR volume < 0) AS negatives,
count(*) FILTER (volume <= 0 AND open = high AND high = low AND low = close) AS halts, count(*) / (count(DISTINCT asset_id) * count(DISTINCT datetime)) AS coverage FROM t""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.validation_report(daily(spark, sf_dir))
