"""Labelled rows for the two classifiers: which rows teach, and sums over partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most about this many labelled rows teach a classifier; more are thinned by a hash of the id.
MOST_TEACHING_ROWS = 400_000


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def teaching(labels: DataFrame, label: str, id_col: str = "doc_id", most: int = MOST_TEACHING_ROWS) -> DataFrame:
    """(``__id``, ``y``) of the labelled rows that teach. An id with both labels teaches with the mean of them."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{label}`").cast("double").alias("y")).where("__id IS NOT NULL AND y IS NOT NULL")
    rows = rows.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.avg("y").alias("y"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows


def summed(df: DataFrame, to_sum, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of ``to_sum(batch)``, an array of ``shape``: by partition, then in a few tasks, then here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += to_sum(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = df.mapInArrow(each, "m binary").repartition(8).mapInArrow(again, "m binary").collect()
    return sum((np.frombuffer(bytes(r.m)).reshape(shape) for r in parts), np.zeros(shape))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of points in ascending x: knots of the non-decreasing fit."""
    blocks: list[list[float]] = []  # first x, last x, weighted sum, weight
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        if c <= 0:
            continue
        blocks.append([a, a, b * c, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    xs = np.array([v for b in blocks for v in (b[0], b[1])])
    ys = np.array([b[2] / b[3] for b in blocks for _ in (0, 1)])
    return xs, ys
