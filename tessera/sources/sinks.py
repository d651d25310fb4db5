"""Mock panels, facts, and library files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mock_panel(spark: SparkSession, assets: int = 50, bars: int = 1000, seed: int = 42, halts: float = 0.0) -> DataFrame:
    """Prices from a market factor, own noise with clustered volatility, and (in a fifth of the assets) drift after volume."""
    u = lambda k, *c: (F.pmod(F.xxhash64(*c, F.lit(seed * 1000 + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda k, *c: F.sqrt(-2 * F.log(u(k, *c))) * F.cos(6.283185307179586 * u(k + 1, *c))
    grid = spark.range(assets).select(F.format_string("A%05d", "id").alias("asset_id"), F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("t"))
    from pyspark.sql import Window

    line = Window.partitionBy("asset_id").orderBy("t")
    calm = 0.01 * (1 + 0.5 * F.sin(F.col("t") / 40.0))
    volume = F.exp(F.lit(8.0) + 0.5 * normal(3, "a", "t"))
    rows = grid.withColumns({"volume": volume, "r": calm * (0.6 * normal(5, "t") + 0.8 * normal(7, "a", "t"))})
    planted = F.when(F.col("a") % 5 == 0, 0.002 * (F.log(F.lag("volume", 1).over(line)) - 8)).otherwise(0.0)
    rows = rows.withColumn("r", F.col("r") + F.coalesce(planted, F.lit(0.0)))
    rows = rows.withColumn("close", 100 * F.exp(F.sum("r").over(line.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(line), F.lit(100.0)))
    wide = 0.002 * (1 + u(9, "a", "t"))
    rows = rows.withColumns({"high": F.greatest("open", "close") * (1 + wide), "low": F.least("open", "close") * (1 - wide)})
    if halts > 0:
        stop = u(11, "a", "t") < halts
        rows = rows.withColumns({c: F.when(stop, F.col("open")).otherwise(F.col(c)) for c in ("high", "low", "close")}).withColumn("volume", F.when(stop, 0.0).otherwise(F.col("volume")))
    start = F.lit("2020-01-01 09:30:00").cast("timestamp_ntz")
    return rows.select((start + F.make_interval(mins=F.col("t") * 10)).alias("datetime"), "asset_id", "open", "high", "low", "close", "volume", (F.col("volume") * (F.col("open") + F.col("close")) / 2).alias("amount"))


def company_facts(spark: SparkSession, path: str, unit: str = "USD") -> DataFrame:
    """(cik, concept, value, filed, end, form) from stored company-facts JSON documents, one to a file."""
    item = "struct<val:double,filed:string,end:string,form:string>"
    kind = f"struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,array<{item}>>>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    flat = raw.select("d.cik", F.explode("d.facts").alias("taxonomy", "concepts")).select("cik", F.explode("concepts").alias("concept", "u"))
    facts = flat.select("cik", "concept", F.explode(F.try_element_at("u.units", F.lit(unit))).alias("f"))
    return facts.select("cik", "concept", F.col("f.val").alias("value"), F.to_date("f.filed").alias("filed"), F.to_date("f.end").alias("end"), "f.form")


def save_library(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Factor rows as parquet, json or csv."""
    df.write.mode("overwrite").format(kind).save(folder)


def training_rows(df: DataFrame) -> DataFrame:
    """(prompt, completion) JSON lines of admitted factors with name, formula and ic."""
    return df.select(F.to_json(F.struct(F.format_string("Propose a factor of family %s.", "family").alias("prompt"), F.col("formula").alias("completion"), F.col("ic").alias("reward"))).alias("value"))


def describe_library(names: dict[str, str]) -> str:
    """Formulas as text, one a line."""
    return json.dumps(names, indent=1, sort_keys=True)
