"""How a factor's information coefficient fades after admission, and what its family says of crowding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import T

#: Observations that a trend needs, those averaged at each end, and the shares of the first edge that count as stable and as gone.
LEAST_SEEN, EDGE, STABLE, GONE = 4, 3, 0.8, 0.2
#: Mechanisms that many trade alike, and the half-life below which decay is fast.
CROWDED = ("Trend/Momentum", "Reversal/Mean-Reversion")
FAST = 20.0
TINY = 1e-9


def life_curve(ic: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, ic_first, ic_last, slope, half_life, state) of each series (keys, ``t_idx``, ``ic``); unknown values are left out.

    ``ic_first`` and ``ic_last`` are means over an edge of the series; the half-life is that of a straight line. With
    too few values they are single values and the state is ``insufficient_data``.
    """
    rows = ic.where("ic IS NOT NULL AND NOT isnan(ic)")
    by = Window.partitionBy(*keys)
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(by), "up": F.row_number().over(by.orderBy(T)), "down": F.row_number().over(by.orderBy(F.desc(T)))})
    edge = F.when(F.col("n") < LEAST_SEEN, 1).otherwise(F.least(F.lit(EDGE), F.floor(F.col("n") / 2)))
    first, last = (F.avg(F.when(F.col(c) <= edge, F.col("ic"))) for c in ("up", "down"))
    got = rows.groupBy(*keys).agg(F.max("n").alias("n"), first.alias("ic_first"), last.alias("ic_last"), F.regr_slope("ic", T).alias("slope"))
    few = F.col("n") < LEAST_SEEN
    a, b = F.col("ic_first"), F.col("ic_last")
    slope = F.when(few, 0.0).otherwise(F.col("slope"))
    ratio = F.when(F.abs(a) > TINY, F.abs(b) / F.abs(a)).otherwise(F.when(F.abs(b) <= TINY, 1.0).otherwise(0.0))
    state = F.when(few, "insufficient_data").when((slope >= 0) | (ratio >= STABLE), "stable").when((ratio <= GONE) | (a > 0) & (b <= 0), "decayed").otherwise("decaying")
    half = F.when(~few & (slope < -TINY) & (F.abs(a) > TINY), F.abs(a) / (2 * F.abs(slope)))
    return got.select(*keys, "n", "ic_first", "ic_last", slope.alias("slope"), half.alias("half_life"), state.alias("state"))


def hyperbolic_fit(ic: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, k, rate, half_life, r2) of |ic| = k / (1 + rate t), by a straight line through 1 / |ic|; the rate is never negative.

    Values of nearly nought are left out of the fit; with too few left it is flat.
    """
    rows = ic.where("ic IS NOT NULL AND NOT isnan(ic)").select(*keys, F.col(T).cast("double").alias("t"), F.abs("ic").alias("y"))
    use = F.col("y") > TINY
    inverse, at = F.when(use, 1 / F.col("y")), F.when(use, F.col("t"))
    fit = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(at).alias("m"), F.avg("y").alias("mean"), F.avg(F.when(use, F.col("y"))).alias("mean_used"), F.regr_slope(inverse, at).alias("s"), F.regr_intercept(inverse, at).alias("i")
    )
    flat = F.col("i") <= 1e-12
    k = F.when(F.col("n") < LEAST_SEEN, 0.0).when(F.col("m") < LEAST_SEEN, F.col("mean")).when(flat, F.col("mean_used")).otherwise(1 / F.col("i"))
    rate = F.when((F.col("m") < LEAST_SEEN) | flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("s") / F.col("i")))
    fit = fit.select(*keys, "n", "m", "mean_used", k.alias("k"), rate.alias("rate"))
    both = rows.where(use).join(F.broadcast(fit), list(keys)) if keys else rows.where(use).join(F.broadcast(fit))
    left, total = F.col("y") - F.col("k") / (1 + F.col("rate") * F.col("t")), F.col("y") - F.col("mean_used")
    error = both.groupBy(*keys).agg(F.sum(left * left).alias("left"), F.sum(total * total).alias("total"))
    out = fit.join(error, list(keys), "left") if keys else fit.join(error)
    r2 = F.when((F.col("m") >= LEAST_SEEN) & (F.col("total") > 1e-18), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("left") / F.col("total")))).otherwise(0.0)
    return out.select(*keys, "n", "k", "rate", F.when(F.col("rate") > 1e-12, 1 / F.col("rate")).alias("half_life"), r2.alias("r2"))


def crowding_risk(mechanism: Column, half_life: Column) -> Column:
    """A label for research, from the mechanism's kind and whether decay is fast."""
    crowded, fast = mechanism.isin(*CROWDED), F.coalesce(half_life < FAST, F.lit(False))
    return F.when(crowded & fast, "high_crowding_decay_risk").when(crowded, "elevated_crowding_decay_risk").when(fast, "decay_watch").otherwise("low_crowding_decay_risk")
