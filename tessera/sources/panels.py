"""Panels: long tables of (datetime, asset_id, measures), read, made canonical, made dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.store import stored

#: Columns that every market panel has.
REQUIRED = ("datetime", "asset_id", "open", "high", "low", "close", "volume", "amount")
#: Other names of those columns, in lower case.
ALIASES = {
    "timestamp": "datetime", "date": "datetime", "time": "datetime", "trade_date": "datetime", "ticker": "asset_id", "symbol": "asset_id", "code": "asset_id",
    "asset": "asset_id", "vol": "volume", "amt": "amount", "turnover": "amount", "o": "open", "h": "high", "l": "low", "c": "close",
}


def canonical(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Names by the alias table, types by lenient casts; NaN becomes null. A required column that is absent raises."""
    taken: dict[str, str] = {}
    for c in df.columns:
        name = c.lower().strip()
        name = ALIASES.get(name, name)
        if name not in taken.values():
            taken[c] = name
    missing = [c for c in required if c not in taken.values()]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    cols = []
    for c, name in taken.items():
        x = F.col(f"`{c}`")
        if name == "datetime":
            x = x.try_cast("timestamp_ntz")
        elif name == "asset_id":
            x = x.cast("string")
        elif name in required or df.schema[c].dataType.typeName() not in ("string", "boolean"):
            x = F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))
        cols.append(x.alias(name))
    return df.select(*cols)


def load(spark: SparkSession, path: str | list[str], kind: str | None = None, assets: list[str] | None = None, start: str | None = None, end: str | None = None, universe: str | None = None) -> DataFrame:
    """A panel from CSV or Parquet files; asset and time filters reach the Parquet scan. Several paths are put together."""
    paths = [path] if isinstance(path, str) else path
    kind = kind or ("csv" if paths[0].rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    raw = spark.read.csv(paths, header=True) if kind == "csv" else spark.read.parquet(*paths)
    df = canonical(raw)
    if assets is not None:
        df = df.where(F.col("asset_id").isin(list(assets)))
    if universe is not None and "universe" in df.columns:
        df = df.where(F.col("universe") == universe)
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end).cast("timestamp_ntz"))
    return df


def dense(panel: DataFrame, asset: str = "asset_id", time: str = "datetime", unique: bool = False) -> DataFrame:
    """Every asset with every bar: ``t_idx`` counts bars from 0. Of rows with one key the last by value of the other columns stays,
    unless the caller knows that keys are ``unique``.

    The calendar has one row a bar, however many assets there are, and is broadcast up to a million bars. Each row makes
    the missing bars up to its asset's next one, the first row also those before it: one shuffle by asset, no join of grids.
    """
    others = [c for c in panel.columns if c not in (asset, time)]
    last = panel if unique else panel.groupBy(asset, time).agg(F.max(F.struct(*others)).alias("__v")).select(asset, time, *[F.col(f"__v.`{c}`").alias(c) for c in others])
    calendar = bars(panel, time)
    count = calendar.count()
    small = F.broadcast if count <= 1_000_000 else lambda df: df
    line = Window.partitionBy(asset).orderBy("__t")
    # a row without a time or an asset has no values in the grid; its asset is there
    own = last.join(small(calendar.withColumnRenamed("t_idx", "__t")), time, "left").withColumn("__t", F.coalesce("__t", F.lit(-1)))
    end = F.greatest(F.coalesce(F.lead("__t").over(line), F.lit(count)) - 1, F.col("__t"))
    own = own.withColumns({"__from": F.when(F.row_number().over(line) == 1, F.least(F.lit(0), F.col("__t"))).otherwise(F.col("__t")), "__to": end}).drop(time)
    grid = own.select("*", F.explode(F.sequence("__from", "__to")).alias("t_idx")).where("t_idx >= 0")
    here = (F.col("t_idx") == F.col("__t")) & F.col(asset).isNotNull()
    grid = grid.select(asset, "t_idx", *[F.when(here, F.col(f"`{c}`")).alias(c) for c in others])
    return grid.join(small(calendar), "t_idx").select(asset, time, "t_idx", *others)


def bars(panel: DataFrame, time: str = "datetime") -> DataFrame:
    """(time, ``t_idx``): the distinct times in order."""
    times = panel.select(time).where(F.col(time).isNotNull()).distinct()
    return times.withColumn("t_idx", (F.row_number().over(Window.orderBy(time)) - 1).cast("int"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by month of shipping: unit prices as prices, quantity as volume, extended price as amount. Stored once in an application."""

    def bars_of(li: DataFrame) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        return ohlcv(li, F.lpad(F.col("l_suppkey").cast("string"), 8, "0"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz"), price, order, F.sum("l_quantity"), F.sum("l_extendedprice"))

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return stored(spark, "monthly", li, bars_of)


def dense_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense form of ``monthly``, stored once in an application."""
    return stored(spark, "dense_monthly", monthly(spark, sf_dir), lambda p: dense(p, unique=True))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day: event values as prices, their number as volume, their sum as amount. Stored once in an application."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value", "event_id")
    return stored(spark, "daily", ev, lambda ev: ohlcv(ev, F.lpad(F.col("user_id").cast("string"), 8, "0"), F.date_trunc("day", "ts").cast("timestamp_ntz"), F.col("value"), F.struct("ts", "event_id"), F.count("value").cast("double"), F.sum("value")))


def ohlcv(df: DataFrame, asset: Column, time: Column, price: Column, order: Column, volume: Column, amount: Column) -> DataFrame:
    return df.groupBy(asset.alias("asset_id"), time.alias("datetime")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        volume.cast("double").alias("volume"), amount.alias("amount"),
    )


def with_vwap_returns(panel: DataFrame, asset: str = "asset_id", time: str = "datetime") -> DataFrame:
    """``vwap`` (null without volume) and ``returns`` on the asset's previous row, without filling gaps."""
    before = F.lag("close").over(Window.partitionBy(asset).orderBy(time))
    return panel.withColumns({"vwap": F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")), "returns": F.try_divide(F.col("close"), before) - 1})
