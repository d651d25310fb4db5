"""Cross-sectional evaluation of a signal against a target, on long frames (``asset_id``, ``t_idx``, signal, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

T = "t_idx"
TINY = 1e-12


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def average_rank(c: str, *keys: str) -> Column:
    """1-based rank with ties averaged, within keys."""
    peers = Window.partitionBy(*keys, c)
    return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson over a group; 0 where either side doesn't vary, and where only rounding is left."""
    d = F.sqrt(F.var_pop(x) * F.var_pop(y)) * F.count(F.lit(1))
    r = F.covar_pop(x, y) * F.count(F.lit(1)) / d
    return F.when((d > TINY) & (F.abs(r) > TINY), r).otherwise(0.0)


def ic_series(df: DataFrame, signal: str = "signal", target: str = "target", rank: bool = True, least: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ``t_idx``, ``n``, ``ic``): correlation over the assets with both values; null below ``least`` of them.

    Ranks are of the valid pairs, so the filter comes first; one shuffle by bar serves ranks and sums.
    """
    pairs = df.select(*keys, T, finite(F.col(signal)).alias("x"), finite(F.col(target)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    if rank:
        pairs = pairs.select(*keys, T, average_rank("x", *keys, T).alias("x"), average_rank("y", *keys, T).alias("y"))
    return pairs.groupBy(*keys, T).agg(F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("ic")).withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def ic_stats(ic: DataFrame, *keys: str) -> DataFrame:
    """Mean, absolute mean, mean of absolutes, deviation, information ratio, win rate; 0 where nothing is known."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = F.stddev_samp("ic")
    got = ic.groupBy(*keys) if keys else ic
    return got.agg(
        F.count("ic").alias("n_bars"), zero(F.avg("ic")).alias("ic_mean"), zero(F.abs(F.avg("ic"))).alias("ic_paper"), zero(F.avg(F.abs("ic"))).alias("ic_abs_mean"), zero(s).alias("ic_std"),
        zero(F.when((F.count("ic") >= 3) & (s >= TINY), F.avg("ic") / s)).alias("icir"), zero(F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double")))).alias("win_rate"),
        zero(F.max("ic")).alias("ic_max"), zero(F.min("ic")).alias("ic_min"),
    )


def _buckets(df: DataFrame, signal: str, target: str, n: int, by_share: bool) -> DataFrame:
    """(t_idx, q, r): mean target of each bucket of a usable bar; null unless all the bucket's targets are known."""
    rows = df.select(T, finite(F.col(signal)).alias("x"), finite(F.col(target)).alias("y")).where("x IS NOT NULL")
    count = F.count(F.lit(1)).over(Window.partitionBy(T))
    ranked = rows.select(T, "y", average_rank("x", T).alias("rank"), count.alias("n"))
    if by_share:  # equal cuts of the percentile, the last closed
        share = (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
        q = F.lit(1)
        for k in range(1, n):
            q = q + (share >= k / n).cast("int")
        usable = F.col("n") >= 5
    else:
        q = F.least(F.greatest(F.ceil(F.col("rank") / F.col("n") * n), F.lit(1)), F.lit(n)).cast("int")
        usable = F.col("n") >= n
    return ranked.where(usable).select(T, q.alias("q"), "y").groupBy(T, "q").agg(F.when(F.count("y") == F.count(F.lit(1)), F.avg("y")).alias("r"))


def quantile_returns(df: DataFrame, signal: str = "signal", target: str = "target", n: int = 5) -> DataFrame:
    """One row: mean return of each bucket, ``long_short``, and the rank correlation of bucket and return (``monotonicity``)."""
    means = _buckets(df, signal, target, n, False).groupBy("q").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("r"))
    at = [F.coalesce(F.max(F.when(F.col("q") == k, F.col("r"))), F.lit(0.0)).alias(f"Q{k}") for k in range(1, n + 1)]
    row = means.agg(*at)
    cells = [F.col(f"Q{k}") for k in range(1, n + 1)]
    # ranks among n numbers: how many are below, plus half of the ties
    ranks = [sum((F.when(o < c, 1.0).when(o == c, 0.5).otherwise(0.0) for o in cells), F.lit(0.5)) for c in cells]
    mid = (n + 1) / 2
    top = sum(((k - mid) * (r - mid) for k, r in enumerate(ranks, 1)), F.lit(0.0))
    low = F.sqrt(sum(((r - mid) * (r - mid) for r in ranks), F.lit(0.0)) * sum((k - mid) ** 2 for k in range(1, n + 1)))
    mean = sum(cells, F.lit(0.0)) / n
    spread = F.sqrt(sum(((c - mean) * (c - mean) for c in cells), F.lit(0.0)) / n)
    return row.withColumns({"long_short": cells[-1] - cells[0], "monotonicity": F.when((spread >= TINY) & (low > TINY), top / low).otherwise(0.0)})


def _membership(df: DataFrame, signal: str, k: Column, least: Column, *more: Column) -> DataFrame:
    """Rows with ``x``, ``n`` (valid values of the bar), ``rank`` (average, ascending), ``k``, ``top`` and ``again``.

    ``top`` marks the k highest of a usable bar (ties go to the larger asset), ``again`` those that were so in the bar
    before. Bars and assets are each one shuffle; the places come from one sort of a bar.
    """
    by = Window.partitionBy(T)
    rows = df.select("asset_id", T, finite(F.col(signal)).alias("x"), *more)
    up = by.orderBy(F.asc_nulls_first("x"), "asset_id")
    rows = rows.withColumns({"n": F.count("x").over(by), "place": F.count(F.lit(1)).over(by) - F.row_number().over(up) + 1, "rank": average_rank("x", T)})
    # nulls rank below all values
    rows = rows.withColumn("rank", F.when(F.col("x").isNotNull(), F.col("rank") - F.count(F.when(F.col("x").isNull(), 1)).over(by)))
    rows = rows.withColumn("k", k).withColumn("top", F.col("x").isNotNull() & least & (F.col("place") <= F.col("k")))
    line = Window.partitionBy("asset_id").orderBy(T)
    return rows.withColumn("again", F.col("top") & F.coalesce(F.lag("top").over(line) & (F.lag(T).over(line) == F.col(T) - 1), F.lit(False)))


def _sets(rows: DataFrame, *more: Column) -> DataFrame:
    """(t_idx, k, k0, common, ...): a bar's set, that of the bar before (null where a bar isn't usable), and what they share."""
    bars = rows.groupBy(T).agg(F.max(F.when(F.col("top"), F.col("k"))).alias("k"), F.sum(F.col("again").cast("int")).alias("common"), *more)
    line = Window.orderBy(T)  # a row a bar
    return bars.withColumn("k0", F.when(F.lag(T).over(line) == F.col(T) - 1, F.lag("k").over(line)))


def turnover(df: DataFrame, signal: str = "signal", share: float = 0.2) -> DataFrame:
    """One row: mean share of the top set (a share of all assets) that changes from bar to bar."""
    assets = df.agg(F.greatest(F.floor(F.countDistinct("asset_id") * share), F.lit(1)).cast("int").alias("k0")).first().k0
    got = _sets(_membership(df, signal, F.lit(assets), F.col("n") >= assets)).where("k IS NOT NULL AND k0 IS NOT NULL")
    return got.agg(F.coalesce(F.avg(1 - F.col("common") / F.col("k")), F.lit(0.0)).alias("turnover"))


def _changed() -> Column:
    return F.coalesce((F.col("k") + F.col("k0") - 2 * F.col("common")) / (2 * F.col("k")), F.lit(0.0))


def turnover_series(df: DataFrame, signal: str = "signal", share: float = 0.2) -> DataFrame:
    """(t_idx, turnover): half the symmetric difference over k, k a share of the bar's valid assets; 0 after an unusable bar."""
    k = F.greatest(F.floor(F.col("n") * share), F.lit(1)).cast("int")
    return _sets(_membership(df, signal, k, F.col("n") >= 5)).select(T, _changed().alias("turnover"))


def factor_stats(df: DataFrame, signal: str = "signal", target: str = "target") -> DataFrame:
    """IC statistics, linear IC, bucket returns and turnover side by side, one row."""
    linear = ic_stats(ic_series(df, signal, target, rank=False)).select(F.col("ic_mean").alias("linear_ic_mean"), F.col("icir").alias("linear_icir"))
    parts = [ic_stats(ic_series(df, signal, target)), linear, quantile_returns(df, signal, target), turnover(df, signal)]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one")


def backtest(df: DataFrame, signal: str = "signal", target: str = "target", cost_bps: float = 4.0) -> DataFrame:
    """(t_idx, q1..q5, gross, turnover, net, cumulative): quintiles by percentile; net of twice the cost of the turnover.

    Ranks, the top set and its change are carried by one frame, which is read once and summed once by bar.
    """
    k = F.greatest(F.floor(F.col("n") * 0.2), F.lit(1)).cast("int")
    rows = _membership(df, signal, k, F.col("n") >= 5, finite(F.col(target)).alias("y"))
    share = (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    q = F.lit(1)
    for cut in range(1, 5):
        q = q + (share >= cut / 5).cast("int")
    rows = rows.withColumn("q", F.when(F.col("x").isNotNull() & (F.col("n") >= 5), q))

    def mean(i: int) -> Column:
        own = F.col("q") == i
        return F.when(F.count(F.when(own, F.col("y"))) == F.count(F.when(own, 1)), F.avg(F.when(own, F.col("y")))).alias(f"q{i}")

    out = _sets(rows, *[mean(i) for i in range(1, 6)]).withColumn("turnover", _changed()).withColumn("gross", F.col("q5") - F.col("q1"))
    out = out.select(T, "turnover", *[f"q{i}" for i in range(1, 6)], "gross")
    out = out.withColumn("net", F.col("gross") - 2 * cost_bps / 10_000 * F.col("turnover"))
    return out.withColumn("cumulative", F.coalesce(F.sum("net").over(Window.orderBy(T).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def cost_pressure(bt: DataFrame, costs: tuple[float, ...] = (1, 4, 7, 10, 11)) -> DataFrame:
    """(cost_bps, net_mean, net_sharpe) from one backtest: costs are exploded, the backtest isn't run again."""
    each = bt.select("gross", "turnover", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost_bps"))
    each = each.withColumn("net", F.col("gross") - 2 * F.col("cost_bps") / 10_000 * F.col("turnover"))
    s = F.stddev_samp("net")
    return each.groupBy("cost_bps").agg(F.avg("net").alias("net_mean"), F.when(s > TINY, F.avg("net") / s).otherwise(0.0).alias("net_ir"))


def rolling_ic(ic: DataFrame, w: int = 10) -> DataFrame:
    """(t_idx, ic, rolling, cumulative): trailing mean over w bars and expanding mean of the known ones."""
    bars = Window.orderBy(T)
    return ic.select(T, "ic", F.avg("ic").over(bars.rowsBetween(-(w - 1), 0)).alias("rolling"), F.avg("ic").over(bars.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def drawdowns(series: DataFrame, value: str = "net") -> DataFrame:
    """(spell, start, trough, end, depth) of each stretch below the running maximum of the cumulative sum."""
    bars = Window.orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    line = series.select(T, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(bars).alias("c"))
    line = line.withColumn("gap", F.col("c") - F.max("c").over(bars)).withColumn("spell", F.sum((F.col("gap") >= 0).cast("int")).over(bars))
    under = line.where("gap < 0")
    return under.groupBy("spell").agg(F.min(T).alias("start"), F.min_by(T, F.struct("gap", T)).alias("trough"), F.max(T).alias("end"), F.min("gap").alias("depth"))


def performance(series: DataFrame, value: str = "net", per_year: int = 252) -> DataFrame:
    """One row: mean, deviation, annual Sharpe and Calmar with the additive drawdown."""
    bars = Window.orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    base = series.where(F.col(value).isNotNull()).select(T, F.col(value).alias("v")).withColumn("c", F.sum("v").over(bars)).withColumn("gap", F.max("c").over(bars) - F.col("c"))
    s, mean = F.stddev_samp("v"), F.avg("v")
    return base.agg(mean.alias("mean"), s.alias("std"), F.when(s > TINY, mean / s * per_year**0.5).otherwise(0.0).alias("sharpe"), F.max("gap").alias("max_drawdown"), F.when(F.max("gap") > TINY, mean * per_year / F.max("gap")).otherwise(0.0).alias("calmar"))


def legs(df: DataFrame, signal: str = "signal", target: str = "target", share: float = 0.2, least: int = 1) -> DataFrame:
    """(t_idx, ls): mean target of the top leg less that of the bottom leg, k = max(least, share of n) and at most half."""
    rows = df.select("asset_id", T, finite(F.col(signal)).alias("x"), finite(F.col(target)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    by = Window.partitionBy(T)
    n = F.count(F.lit(1)).over(by)
    k = F.least(F.greatest(F.lit(least), F.floor(n * share)), F.floor(n / 2))
    # the order from above is the reverse of that from below: a bar is sorted once
    placed = rows.withColumn("up", F.row_number().over(by.orderBy("x", "asset_id"))).withColumns({"k": k, "n": n}).withColumn("down", F.col("n") - F.col("up") + 1).where("k > 0")
    return placed.groupBy(T).agg((F.avg(F.when(F.col("down") <= F.col("k"), F.col("y"))) - F.avg(F.when(F.col("up") <= F.col("k"), F.col("y")))).alias("ls"))


def regimes(df: DataFrame, returns: str = "returns", lookback: int = 60, vol_share: float = 0.7, edge: float = 0.0) -> DataFrame:
    """(t_idx, market, roll_mean, roll_vol, regime) from the market's mean return: trailing mean and deviation over ``lookback`` bars.

    SIDEWAYS for the first ``lookback`` bars; then BULL above ``edge`` with a deviation below its quantile, BEAR below ``-edge``.
    """
    market = df.groupBy(T).agg(F.avg(returns).alias("market"))
    w = Window.orderBy(T).rowsBetween(-(lookback - 1), 0)
    whole = F.col(T) >= lookback - 1
    out = market.withColumns({"roll_mean": F.when(whole, F.avg("market").over(w)), "roll_vol": F.when(whole, F.stddev_samp("market").over(w))})
    out = out.withColumn("cut", F.coalesce(F.percentile("roll_vol", vol_share).over(Window.partitionBy()), F.lit(float("inf"))))
    late = F.col(T) >= lookback
    bull = late & (F.col("roll_mean") > edge) & (F.col("roll_vol") < F.col("cut"))
    return out.withColumn("regime", F.when(bull, "BULL").when(late & (F.col("roll_mean") < -edge), "BEAR").otherwise("SIDEWAYS")).drop("cut")


def regime_ic(ic: DataFrame, labels: DataFrame) -> DataFrame:
    """(regime, n, ic_abs_mean, icir) of an IC series under regime labels."""
    s = F.stddev_samp("ic")
    return ic.join(labels.select(T, "regime"), T).groupBy("regime").agg(F.count("ic").alias("n"), F.coalesce(F.avg(F.abs("ic")), F.lit(0.0)).alias("ic_abs_mean"), F.coalesce(F.when((F.count("ic") >= 3) & (s >= TINY), F.avg("ic") / s), F.lit(0.0)).alias("icir"))
