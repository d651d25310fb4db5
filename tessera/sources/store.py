"""Tables that several queries or passes read are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders of what ``stored`` has written, by application, name and the files that it was made from.
_KEPT: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, in this machine's temporary folder in local mode and in the warehouse on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` from a new table in the shared folder: later passes read it, and lineage ends there."""
    folder, schema = shared_folder(df.sparkSession), df.schema
    df.write.parquet(folder)
    return df.sparkSession.read.schema(schema).parquet(folder)


def stored(spark: SparkSession, name: str, source: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(source)``, written once in an application for a name and the source's files."""
    key = spark.sparkContext.applicationId, name, tuple(sorted(source.inputFiles()))
    if key not in _KEPT:
        made = make(source)
        folder = shared_folder(spark)
        made.write.parquet(folder)
        _KEPT[key] = folder
    return spark.read.parquet(_KEPT[key])
