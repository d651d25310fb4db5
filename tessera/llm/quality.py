"""Document quality: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

A document is described by statistics of its whole text. cos(Wx + b) with Gaussian W
approximates a Gaussian kernel over them. Each partition sums its part of the normal
equations, so fitting moves one small matrix a partition, whatever the number of rows.
The ridge score is calibrated by an isotonic fit to labels of the rows that taught.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import carried, materialize, restored, tidy
from tessera.llm.labelled import held_out, isotonic, summed, teaching
from tessera.llm.words import SPACE, U, chunks, find_words, window_hash

#: Scores are calibrated in BINS bins from -0.5 to 1.5; the outer ones have all beyond.
FEATURES, RIDGE, SEED, BINS = 256, 1e-3, 20240607, 512
_CLASSES = np.zeros(256, np.int64)
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:", b"!?", b"|", b"#$%&*", b"<>{}[]()/\\=+_~^@\"'-`"), 1):
    _CLASSES[list(_bytes)] = _i
_CLASSES[128:] = 9
STATISTICS = 26


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the number of different values, and how often the most frequent one occurs."""
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    if not len(d):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1]))))
    runs = np.diff(np.append(first, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[first], runs)
    return np.bincount(d[first], minlength=n).astype(float), most


def statistics(texts: Sequence[bytes | None]) -> np.ndarray:
    """One row of STATISTICS numbers for each text; a text without words has zeros but for its length."""
    n = len(texts)
    w = find_words(texts, SPACE)
    h, doc, count = w.hashes(), w.doc_of_word(), w.counts().astype(float)
    size = np.array([len(t or b"") for t in texts], float)
    of_byte = np.repeat(np.arange(n), size.astype(np.int64) + 1)
    by_class = np.bincount(of_byte * 10 + _CLASSES[w.buf], minlength=10 * n).reshape(n, 10).astype(float)
    words, total = np.maximum(count, 1), np.maximum(size, 1)
    length = (w.ends - w.starts).astype(float)
    mean = np.bincount(doc, length, n) / words
    deviation = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / words - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    kinds, top = _distinct(doc, h, n)
    pair = window_hash(h, 2, 1)
    inside = doc[:-1] == doc[1:] if len(doc) > 1 else np.zeros(0, bool)
    pairs = np.bincount(doc[:-1][inside], minlength=n) if len(doc) > 1 else np.zeros(n)
    pair_kinds, pair_top = _distinct(doc[:-1][inside], pair[inside], n) if len(doc) > 1 else (np.zeros(n), np.zeros(n))
    same = np.bincount(doc[1:][inside & (h[1:] == h[:-1])], minlength=n) if len(doc) > 1 else np.zeros(n)
    # lines: runs of bytes between line feeds
    at_line = np.zeros(256, bool)
    at_line[10] = True
    lines = find_words(texts, at_line)
    line_n = np.maximum(lines.counts().astype(float), 1)
    line_kinds, _ = _distinct(lines.doc_of_word(), lines.hashes(), n)
    capital = np.bincount(doc[(w.buf[w.starts] >= 65) & (w.buf[w.starts] <= 90)], minlength=n) if len(doc) else np.zeros(n)
    short = np.bincount(doc[length <= 2], minlength=n)
    letters = np.maximum(by_class[:, 1] + by_class[:, 2] + by_class[:, 9], 1)
    columns = [
        np.log1p(size), np.log1p(count), mean / 10, deviation / 10, np.log1p(longest), kinds / words, top / words,
        np.where(pairs > 0, pair_kinds / np.maximum(pairs, 1), 1.0), pair_top / np.maximum(pairs, 1), same / words,
        np.log1p(line_n), line_kinds / line_n, np.log1p(size / line_n), by_class[:, 1] / letters, by_class[:, 9] / total, by_class[:, 3] / total,
        by_class[:, 4] / words, by_class[:, 5] / words, by_class[:, 6] / words, by_class[:, 7] / words, by_class[:, 8] / words,
        capital / words, short / words, np.log1p(kinds), np.log1p(top), kinds / np.maximum(np.sqrt(words), 1) / 10,
    ]
    return np.minimum(np.stack(columns, axis=1), 20.0)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for a, b in chunks(texts, 1 << 20):
            x = statistics(texts[a:b]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["__id", "x"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([np.ones((len(x), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.weights + self.phases)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a trace of the raw score so that it keeps its order within a level."""
        r = self.raw(x)
        return np.clip(0.998 * np.interp(r, self.knots, self.levels) + 0.002 / (1 + np.exp(-np.clip(4 * (r - 0.5), -30, 30))), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, STATISTICS).astype(float)


def fit(described: DataFrame, taught: DataFrame) -> Model:
    """A model from rows (``__id``, ``x``) and labels (``__id``, ``y``). Without labels every score is one half."""
    rows = materialize(described.select("__id", "x").join(taught, "__id").select("x", "y"))
    d = STATISTICS

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(0))
        return np.stack([np.full(d, float(len(x))), x.sum(0), (x**2).sum(0)])

    n, s, q = summed(rows, moments, (3, d))
    n = max(n[0], 1.0)
    mean = s / n
    scale = np.maximum(np.sqrt(np.maximum(q / n - mean**2, 0)), 1e-3)
    rng = np.random.default_rng(SEED)
    size = 1 + d + FEATURES
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(size), np.array([0.0]), np.array([0.5]))

    def normal(b: pa.RecordBatch) -> np.ndarray:
        y = b.column(1).to_numpy(zero_copy_only=False)
        f = model.features(_matrix(b.column(0)))
        return np.concatenate([f.T @ f, (f.T @ y)[:, None]], axis=1)

    a = summed(rows, normal, (size, size + 1))
    penalty = RIDGE * n * np.eye(size)
    penalty[0, 0] = 1e-9
    model.beta = np.linalg.solve(a[:, :size] + penalty, a[:, size])

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        y = b.column(1).to_numpy(zero_copy_only=False)
        r = model.raw(_matrix(b.column(0)))
        k = np.clip(((r + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(k, minlength=BINS), np.bincount(k, y, BINS), np.bincount(k, r, BINS)])

    count, hits, place = summed(rows, histogram, (3, BINS))
    some = count > 0
    if some.any():
        x = place[some] / count[some]
        model.knots, model.levels = isotonic(x, hits[some] / count[some], count[some])
    return model


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            score = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["__id", "score"])

    return run


def _scores_of_texts(shared):
    """The same from the texts, which go on with their rows: one pass, in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts, 1 << 20):
                x = statistics(texts[a:b]).astype(np.float32).astype(float)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(model.score(x), pa.float64()), *own.columns[1:]], ["__id", "score", *batch.schema.names[1:]])

    return run


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """Per row: ``__id``, ``held_out``, ``score``, ``predicted`` and, with carry, ``__text`` and ``__row``.

    Only the text makes a score. Null and empty texts are scored by their (zero) statistics;
    rows with equal ids stay apart; a row with a null id counts as held out.
    """
    spark = docs.sparkSession
    rows = carried(docs, id_col, text_col, carry)
    kind = T.StructType().add("__id", "long").add("x", "binary")
    x = materialize(rows.select("__id", "__text").mapInArrow(tidy("quality", _describe), kind))
    model = spark.sparkContext.broadcast(fit(x, teaching(labels, label)))
    out = T.StructType().add("__id", "long").add("score", "double")
    if carry:
        out = out.add("__text", "string").add("__row", rows.schema["__row"].dataType)
        found = rows.mapInArrow(tidy("quality", _scores_of_texts(model)), out)
    else:
        found = x.mapInArrow(_scores(model), out)
    return found.withColumns({"held_out": held_out(F.col("__id")), "predicted": (F.col("score") >= threshold).cast("int")})


def without_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    found = scored(docs, labels, id_col, text_col, threshold=threshold, carry=True)
    return restored(found.where("predicted = 1"), docs, text_col, F.col("__text"))
