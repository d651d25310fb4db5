"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration.

Each word and its beginnings of 4, 5 and 6 bytes are units, so that inflected forms of a
stem are known too. A unit's log-odds between toxic and other documents has a Dirichlet
prior proportional to the unit's frequency in both; units whose log-odds are significant
make the model. A token scores the best log-odds of its units less a drift; others score
minus the drift. All maximal segments (Ruzzo and Tompa) are found in one scan. By
extreme-value theory a segment of score s is expected K n exp(-lambda s) times in n
tokens of clean text; lambda solves the moment equation of clean token scores and K is
fitted to the best segments of clean documents. A document's statistic is the sum of
-log E over its significant segments, calibrated to [0, 1] by an isotonic fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import carried, materialize, tidy
from tessera.llm.labelled import held_out, isotonic, summed, teaching
from tessera.llm.words import PUNCT, U, Words, chunks, find_words, mix

PREFIXES = (4, 5, 6)
#: Strength of the prior as a share of the documents; least z-score and log-odds of a unit; documents a unit needs.
PRIOR, LEAST_Z, LEAST_ODDS, LEAST_DOCS = 0.125, 2.5, 1.5, 4
DRIFT = 1.0
#: A segment is significant if fewer are expected in clean text of this length.
MOST_EXPECTED = 0.5
#: Statistics are calibrated in bins; the last one has all from BINS * BIN = 100 on, where E is below 1e-43.
BINS, BIN = 400, 0.25


def units(w: Words) -> list[np.ndarray]:
    """Hashes of each word's units: the word, then its beginnings (of the word itself, if it is shorter)."""
    out = [mix(w.hashes() ^ U(0x51ED270B))]
    for k in PREFIXES:
        part = Words(w.buf, w.starts, np.minimum(w.ends, w.starts + k), w.bounds)
        out.append(mix(part.hashes() ^ U(0x51ED270B + k)))
    return out


def maximal_segments(at: Sequence[int], scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a text whose tokens at ``at`` have ``scores`` and whose others have -DRIFT.

    Ruzzo and Tompa's scan with the runs of other tokens taken at once. Each is (first, last, score).
    """
    total, before = 0.0, -1
    found: list[list[float]] = []  # first, last, total before it, total after it
    for i, s in zip(at, scores, strict=True):
        total -= DRIFT * (i - before - 1)
        before = i
        if s <= 0:
            total += s
            continue
        new = [i, i, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in found]


@dataclass
class Model:
    hashes: np.ndarray
    odds: np.ndarray
    rate: float = 1.0  # lambda
    k: float = 1.0
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def token_scores(self, w: Words) -> np.ndarray:
        best = np.full(len(w.starts), 0.0)
        if len(self.hashes):
            for h in units(w):
                i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                np.maximum(best, np.where(self.hashes[i] == h, self.odds[i], 0.0), out=best)
        return best - DRIFT

    def segments(self, texts: Sequence[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Number of tokens and maximal segments of each text."""
        w = find_words(texts, PUNCT, lower=True)
        s = self.token_scores(w)
        hit = np.flatnonzero(s > 0)
        cut = np.searchsorted(hit, w.bounds)
        for i, n in enumerate(w.counts().tolist()):
            own = hit[cut[i] : cut[i + 1]]
            yield n, maximal_segments((own - w.bounds[i]).tolist(), s[own].tolist()) if len(own) else []

    def expected(self, n: int, score: float) -> float:
        return self.k * max(n, 1) * float(np.exp(-min(self.rate * score, 700.0)))

    def statistic(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of -log E over significant segments, and those with their E."""
        kept = [(a, b, e) for a, b, s in segments if (e := self.expected(n, s)) < MOST_EXPECTED]
        return float(sum(-np.log(max(e, 1e-300)) for _, _, e in kept)), kept

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(0.998 * np.interp(x, self.knots, self.levels) + 0.002 * x / (1 + x), 0, 1)


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each unit, as toxic and other ones, summed over a batch."""
    for batch in batches:
        texts, y = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_numpy()
        for a, b in chunks(texts, 4 << 20):
            w = find_words(texts[a:b], PUNCT, lower=True)
            doc = w.doc_of_word()
            h, d = np.concatenate(units(w)), np.tile(doc, 1 + len(PREFIXES))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            if not len(h):
                continue
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
            h, d = h[new], d[new]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            toxic = np.add.reduceat(y[a:b][d], first)
            n = np.diff(np.append(first, len(h))).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(toxic), pa.array(n - toxic)], ["u", "t", "c"])


def fit(rows: DataFrame) -> Model:
    """A model from rows (``__id``, ``__text``, ``y``). Without labels of both kinds every score is near nought."""
    n, toxic_n = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    toxic_n = float(toxic_n or 0)
    clean_n = n - toxic_n
    blank = Model(np.zeros(0, U), np.zeros(0), knots=np.array([0.0]), levels=np.array([toxic_n / n if n else 0.0]))
    if not toxic_n or not clean_n:
        return blank
    counts = rows.mapInArrow(tidy("toxicity", _count_units), "u long, t double, c double").groupBy("u").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    prior = PRIOR * n
    p = prior * (F.col("t") + F.col("c")) / n
    a, b = F.col("t") + p, F.col("c") + p
    odds = F.log(a / (toxic_n + prior - a)) - F.log(b / (clean_n + prior - b))
    kept = counts.where((F.col("t") >= LEAST_DOCS) & (F.col("t") + F.col("c") < n)).select("u", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where(f"z >= {LEAST_Z} AND odds >= {LEAST_ODDS}")
    # all of them: their number is bounded by the teaching rows, LEAST_DOCS of which hold each unit
    table = kept.select("u", "odds").toArrow()
    h = table.column("u").to_numpy().astype(np.int64).view(U)
    order = np.argsort(h)
    model = Model(h[order], table.column("odds").to_numpy().astype(float)[order])
    if not len(h):
        return blank
    _calibrate(model, rows, clean_n)
    return model


def _calibrate(model: Model, rows: DataFrame, clean_n: float) -> None:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def null(batch: pa.RecordBatch) -> np.ndarray:
        """Of clean documents: tokens by score, and documents by their best segment's score; then tokens in all."""
        texts, y = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_numpy()
        out = np.zeros((3, BINS))
        for a, b in chunks(texts, 4 << 20):
            own = [t for t, v in zip(texts[a:b], y[a:b], strict=True) if v < 0.5]
            s = shared.value.token_scores(find_words(own, PUNCT, lower=True))
            s = s[s > 0]
            out[0] += np.bincount(np.minimum((s / BIN).astype(int), BINS - 1), minlength=BINS)
            for n, found in shared.value.segments(own):
                out[2, 0] += n
                if found:
                    out[1, min(int(max(f[2] for f in found) / BIN), BINS - 1)] += 1
        return out

    tokens, best, total = summed(rows, null, (3, BINS))
    total = max(total[0], 1.0)
    values = (np.arange(BINS) + 0.5) * BIN
    # a pseudo-token of the mean score keeps lambda finite when clean text has no positive token
    p = tokens.copy()
    p[min(int(max(model.odds.mean() - DRIFT, BIN) / BIN), BINS - 1)] += 1
    p /= total + 1

    def excess(rate: float) -> float:
        return float((p * np.expm1(np.minimum(rate * values, 700))).sum() + (1 - p.sum()) * np.expm1(-rate * DRIFT))

    lo, hi = 1e-6, 1e-3
    while excess(hi) < 0 and hi < 100:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    model.rate = (lo + hi) / 2
    some = (best.sum() + 1) / (clean_n + 1)  # share of clean documents with a segment, and its mean score
    low = float((best * values).sum() + values[0]) / (best.sum() + 1)
    model.k = float(-np.log1p(-min(some, 0.999)) / max(total / max(clean_n, 1), 1) * np.exp(min(model.rate * low, 50.0)))
    fitted = spark.sparkContext.broadcast(Model(model.hashes, model.odds, model.rate, model.k))

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        texts, y = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_numpy()
        out = np.zeros((2, BINS))
        for a, b in chunks(texts, 4 << 20):
            x = np.array([fitted.value.statistic(n, f)[0] for n, f in fitted.value.segments(texts[a:b])])
            k = np.minimum(np.ceil(x / BIN).astype(int), BINS - 1)
            out[0] += np.bincount(k, minlength=BINS)
            out[1] += np.bincount(k, y[a:b], BINS)
        return out

    n, toxic = summed(rows, histogram, (2, BINS))
    some_bins = n > 0
    model.knots, model.levels = isotonic(np.arange(BINS)[some_bins] * BIN, toxic[some_bins] / n[some_bins], n[some_bins])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts, 4 << 20):
                found = [model.statistic(n, f) for n, f in model.segments(texts[a:b])]
                spans = pa.array([[{"first": f, "last": last, "expected": e} for f, last, e in kept] for _, kept in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("expected", pa.float64())])))
                score = model.score(np.array([x for x, _ in found]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(score, pa.float64()), spans, *[c[a:b] for c in batch.columns[2:]]], ["__id", "score", "passages", *batch.schema.names[2:]])

    return run


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """Per row: ``__id``, ``held_out``, ``score``, ``predicted``, ``passages`` (first and last token, E) and, with carry, ``__row``.

    Only the text makes a score. Null and empty texts have no tokens and score as clean text
    does; rows with equal ids stay apart; a row with a null id counts as held out.
    """
    rows = carried(docs, id_col, text_col, carry)
    # at most MOST_TEACHING_ROWS labels; their texts are read again for each of the fit's sums
    taught = materialize(rows.select("__id", "__text").join(F.broadcast(teaching(labels, label)), "__id"))
    model = docs.sparkSession.sparkContext.broadcast(fit(taught))
    span = T.StructType().add("first", "long").add("last", "long").add("expected", "double")
    out = T.StructType().add("__id", "long").add("score", "double").add("passages", T.ArrayType(span))
    if carry:
        out = out.add("__row", rows.schema["__row"].dataType)
    found = rows.mapInArrow(tidy("toxicity", _scores(model)), out)
    return found.withColumns({"held_out": held_out(F.col("__id")), "predicted": (F.col("score") >= threshold).cast("int")})
