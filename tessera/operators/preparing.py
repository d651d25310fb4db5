"""Operators on raw panels: targets, resampling, halts, filling, winsorising, as-of joins, roll adjustment, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSET, TIME = "asset_id", "datetime"
PRICES = ("open", "high", "low", "close")


def _rows(asset: str = ASSET):
    return Window.partitionBy(asset).orderBy(TIME)


@dataclass(frozen=True)
class Target:
    """A forward return: from one price ``delay`` rows ahead to another ``holding`` rows on."""

    name: str = "paper"
    delay: int = 1
    holding: int = 1
    pair: str = "open_to_close"
    log: bool = False

    @property
    def ends(self) -> tuple[str, str, int, int]:
        start, _, end = self.pair.partition("_to_")
        if {start, end} - {"open", "close"} or self.delay < 0 or self.holding < 1:
            raise ValueError(f"{self} is no target")
        return start, end, self.delay, self.delay + self.holding - (self.pair == "open_to_close")


def with_targets(panel: DataFrame, targets: list[Target] | None = None) -> DataFrame:
    """``target_<name>`` columns. Offsets count the asset's rows, so this runs before the panel is made dense."""
    out = {}
    for t in targets or [Target()]:
        start, end, i, j = t.ends
        a, b = (F.lead(c, k).over(_rows()) for c, k in ((start, i), (end, j)))
        ratio = F.try_divide(b, a)
        out[f"target_{t.name}"] = F.when(ratio > 0, F.log(ratio)) if t.log else ratio - 1
    return panel.withColumns(out)


def resample(panel: DataFrame, rule: str) -> DataFrame:
    """Bars of a longer interval (such as ``"30 days"``): first open, highest high, lowest low, last close, sums; vwap and returns anew."""
    bucket = F.window(F.col(TIME).cast("timestamp"), rule).getField("start").cast("timestamp_ntz")
    out = panel.groupBy(ASSET, bucket.alias("bucket")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col(TIME))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col(TIME))).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    ).withColumnRenamed("bucket", TIME)
    before = F.lag("close").over(_rows())
    return out.withColumns({"vwap": F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")).otherwise(F.col("close")), "returns": F.try_divide(F.col("close"), before) - 1})


def flag_halts(panel: DataFrame, least_volume: float = 0.0) -> DataFrame:
    """``is_halt``: no more volume than ``least_volume`` and one price."""
    same = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return panel.withColumn("is_halt", F.coalesce((F.col("volume") <= least_volume) & same, F.lit(False)))


def mask_halts(panel: DataFrame) -> DataFrame:
    held = [c for c in (*PRICES, "volume", "amount", "vwap", "returns") if c in panel.columns]
    return panel.withColumns({c: F.when(~F.col("is_halt"), F.col(c)) for c in held})


def fill(panel: DataFrame, columns: list[str], limit: int | None = None, method: str = "median") -> DataFrame:
    """Carry values forward within an asset's day, ``limit`` rows at most; then the bar's median or mean."""
    if method not in ("median", "mean"):
        raise ValueError("method is median or mean")
    day = Window.partitionBy(ASSET, F.to_date(TIME)).orderBy(TIME)
    row = F.row_number().over(day)
    carried = {}
    for c in columns:
        seen = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col("__row").alias("r"), F.col(c).alias("v"))), ignorenulls=True).over(day)
        ok = F.lit(True) if limit is None else F.col("__row") - seen["r"] <= limit
        carried[c] = F.coalesce(F.col(c), F.when(ok, seen["v"]))
    out = panel.withColumn("__row", row).withColumns(carried).drop("__row")
    bar = Window.partitionBy(TIME)
    return out.withColumns({c: F.coalesce(c, (F.percentile(c, 0.5) if method == "median" else F.avg(c)).over(bar)) for c in columns})


def complete_bars(panel: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """Only bars at which the share of assets (of all in the panel) with all columns present reaches ``least``."""
    whole = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        whole = whole & F.col(c).isNotNull()
    assets = panel.agg(F.countDistinct(ASSET).alias("m"))
    good = panel.where(whole).groupBy(TIME).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(assets)).where(F.col("n") >= least * F.col("m")).select(TIME)
    return panel.join(good, TIME, "left_semi")


def winsorise(panel: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values held within the bar's quantiles; both come from one percentile pass for each column."""
    bar = Window.partitionBy(TIME)
    edges = {f"__e_{c}": F.percentile(c, F.array(F.lit(low), F.lit(high))).over(bar) for c in columns}
    out = panel.withColumns(edges)
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"__e_{c}")[0], F.least(F.col(c), F.col(f"__e_{c}")[1]))) for c in columns}
    return out.withColumns(clipped).drop(*edges)


def standardise(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Bar-wise z-scores (sample deviation); 0 where there is no deviation or no value."""
    bar = Window.partitionBy(TIME)

    def z(c: str) -> Column:
        s = F.stddev_samp(c).over(bar)
        return F.coalesce(F.when(s > 0, (F.col(c) - F.avg(c).over(bar)) / s), F.lit(0.0))

    return panel.withColumns({c: z(c) for c in columns})


def preprocess(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Derive, mask halts, fill, keep complete bars, winsorise, standardise: the order that evaluation on prepared inputs uses."""
    from tessera.sources.panels import with_vwap_returns

    columns = columns or [*PRICES, "volume", "amount", "vwap", "returns"]
    out = mask_halts(flag_halts(with_vwap_returns(panel))).drop("is_halt")
    return standardise(winsorise(complete_bars(fill(out, columns), columns), columns), columns)


def as_of(bars: DataFrame, facts: DataFrame, value: str, filed: str = "filed", order: str | None = None) -> DataFrame:
    """``bars`` with the latest ``value`` filed by then. One shuffle by asset: bars and facts interleave in time, facts first at a tie.

    ``order`` breaks ties among facts filed at once: the greatest wins.
    """
    tie = F.col(order) if order else F.lit(0)
    left = bars.select(ASSET, F.col(TIME).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(tie_type(facts, order)).alias("__tie"), F.lit(None).cast("double").alias("__v"), F.struct(*bars.columns).alias("__bar"))
    right = facts.select(ASSET, F.col(filed).alias("__t"), F.lit(0).alias("__kind"), tie.cast(tie_type(facts, order)).alias("__tie"), F.col(value).cast("double").alias("__v"), F.lit(None).cast(left.schema["__bar"].dataType).alias("__bar"))
    line = Window.partitionBy(ASSET).orderBy("__t", "__kind", "__tie")
    out = left.unionByName(right).withColumn(value, F.last("__v", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where("__kind = 1").select(*[F.col(f"__bar.`{c}`").alias(c) for c in bars.columns], value)


def tie_type(facts: DataFrame, order: str | None) -> str:
    return facts.schema[order].dataType.simpleString() if order else "int"


def roll_adjust(panel: DataFrame, factor: str = "adjustment_factor") -> DataFrame:
    """Prices and amount scaled so that the newest row keeps its level: a backward running product of factor ratios."""
    own = F.coalesce(F.col(factor), F.lit(1.0))
    after = F.lead(own).over(_rows())
    step = F.when((own > 0) & (after > 0), F.log(after / own)).otherwise(0.0)
    back = Window.partitionBy(ASSET).orderBy(F.desc(TIME)).rowsBetween(Window.unboundedPreceding, 0)
    out = panel.withColumn("__step", step).withColumn(factor, F.exp(F.sum("__step").over(back))).drop("__step")
    return out.withColumns({c: F.col(c) * F.col(factor) for c in (*PRICES, "amount") if c in panel.columns})


def basis(futures: DataFrame, spot: DataFrame) -> DataFrame:
    """Futures with ``spot``, ``basis`` (future less spot), ``premium`` (ratio less 1) and ``roll_yield`` (the factor's change)."""
    out = futures.join(spot.select(ASSET, TIME, F.col("close").alias("spot")), [ASSET, TIME], "left")
    before = F.lag("adjustment_factor").over(_rows())
    return out.withColumns({"basis": F.col("close") - F.col("spot"), "premium": F.when(F.col("spot") > 0, F.col("close") / F.col("spot") - 1), "roll_yield": F.when(before > 0, F.col("adjustment_factor") / before - 1).otherwise(0.0)})


def validation_report(panel: DataFrame) -> DataFrame:
    """One row of counts: rows, assets, bars, repeated keys, coverage, missing cells, broken bars, negatives, zero-volume halts."""
    o, h, low, c = (F.col(x) for x in PRICES)
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    keyed = panel.groupBy(ASSET, TIME).agg(
        F.count(F.lit(1)).alias("k"), *[n(F.col(x).isNull()).alias(f"m_{x}") for x in (*PRICES, "volume", "amount")],
        n((h < F.greatest(o, c)) | (low > F.least(o, c)) | (h < low)).alias("bad"), n((F.least(o, h, low, c) < 0) | (F.col("volume") < 0)).alias("neg"),
        n((F.col("volume") <= 0) & (o == h) & (h == low) & (low == c)).alias("halts"),
    )
    total = keyed.agg(
        F.sum("k").alias("n_rows"), F.countDistinct(ASSET).alias("n_assets"), F.countDistinct(TIME).alias("n_bars"), n(F.col("k") > 1).alias("repeated_keys"), F.count(F.lit(1)).alias("pairs"),
        *[F.sum(f"m_{x}").alias(f"missing_{x}") for x in (*PRICES, "volume", "amount")], F.sum("bad").alias("broken_bars"), F.sum("neg").alias("negatives"), F.sum("halts").alias("halts"),
    )
    return total.withColumn("coverage", F.try_divide(F.col("pairs"), F.col("n_assets") * F.col("n_bars"))).drop("pairs")


def leaky_columns(panel: DataFrame) -> list[str]:
    """Columns whose names say that they look ahead."""
    words = ("future", "forward", "fwd", "lead", "next_", "target", "label")
    return [c for c in panel.columns if any(w in c.lower() for w in words)]
