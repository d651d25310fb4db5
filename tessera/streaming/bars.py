"""Bars from an event stream: tumbling windows with a watermark; late events beyond it are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, interval: str = "1 day", late: str = "1 hour", asset: str = "user_id", time: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """(asset_id, datetime, open..close, volume, amount) of a stream or a table; a stream gives a bar when the watermark passes its end."""
    at = F.col(time).cast("timestamp")
    rows = events.select(F.col(asset).alias("asset_id"), at.alias("ts"), F.col(value).alias("v"), F.struct(at.alias("t"), F.col(order).alias("o")).alias("k"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    got = rows.groupBy("asset_id", F.window("ts", interval).alias("w")).agg(
        F.min_by("v", "k").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "k").alias("close"), F.count("v").cast("double").alias("volume"), F.sum("v").alias("amount")
    )
    return got.select("asset_id", F.col("w.start").cast("timestamp_ntz").alias("datetime"), "open", "high", "low", "close", "volume", "amount")
