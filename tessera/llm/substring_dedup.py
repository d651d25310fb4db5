"""Exact removal of word passages that repeat across documents, by difference-cover anchors.

A window is ``window`` consecutive words of one document. A word is removed if a window
that covers it has the same words as a window of a document with a smaller id. All
windows are judged on the input.

Method. Positions p with p mod 7 in {0, 1, 3} are a difference cover: for any two
starts i and j there is a shift h < 7 that puts both i+h and j+h on the cover. So two
equal windows of 13 words share an anchor, the hash of the 7 words from such a position.
Only these 3/7 of the positions are hashed and exchanged. An anchor that only one
document holds can't be part of a match; the windows around the others are extended to
the full width, hashed with 96 bits and exchanged to find the smallest document.

Both exchanges carry packed arrays between blocks of documents and buckets of hashes:
a block sends each hash once, however many of its documents hold it, and gets one bit
back for each. A passage that a third of all documents hold therefore costs one entry a
block, and no list of the documents with a passage is ever made.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import carried, restored, scaled_parts, tidy_group
from tessera.llm.words import SPACE, U, chunks, find_words, window_hash

#: A perfect difference cover modulo 7: every difference occurs.
PERIOD, COVER = 7, (0, 1, 3)
NO_ID = np.iinfo(np.int64).max
_PACKED = "bucket int, block int, data binary"
_REPLY = "block int, bucket int, bits binary"


@dataclass
class Block:
    """Word hashes of the documents of a block; what both exchanges derive from it is the same each time."""

    ids: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    window: int

    @classmethod
    def of(cls, table: pa.Table, window: int) -> tuple[Block, list[bytes], pa.Table]:
        """The block in an order that depends on its rows alone."""
        texts = table.column("__text").combine_chunks().cast(pa.binary()).to_pylist()
        ids = pc.fill_null(table.column("__id"), NO_ID).to_numpy()
        counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        for a, b in chunks(texts):
            w = find_words(texts[a:b], SPACE)
            counts.append(w.counts())
            hashes.append(w.hashes())
        return cls(ids, np.concatenate(counts), np.concatenate(hashes), window), texts, table

    def word_ids(self) -> np.ndarray:
        return np.repeat(self.ids, self.counts)

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word: its place in its document, and the number of words from it to the end."""
        ends = np.cumsum(self.counts)
        here = np.arange(len(self.hashes))
        return here - np.repeat(ends - self.counts, self.counts), np.repeat(ends, self.counts) - here

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors."""
        width = self.window - PERIOD + 1
        place, left = self.place()
        h = window_hash(self.hashes, width, 0x5851F42D)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        n = len(h)
        ids = self.word_ids()
        long_enough = np.repeat(self.counts >= self.window, self.counts)
        at = np.flatnonzero(cover[place[:n] % PERIOD] & (left[:n] >= width) & long_enough[:n] & (ids[:n] != NO_ID))
        return at, h[at]

    def windows(self, shared_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and 96-bit hashes of the windows that hold a shared anchor."""
        n = max(0, len(self.hashes) - self.window + 1)
        mark = np.zeros(len(self.hashes) + 1, np.int64)
        mark[shared_at + 1] = 1
        np.cumsum(mark, out=mark)
        _, left = self.place()
        i = np.arange(n)
        at = i[(mark[np.minimum(i + PERIOD, len(mark) - 1)] > mark[:n]) & (left[:n] >= self.window)]
        a = window_hash(self.hashes, self.window, 0x14057B7E)[at]
        b = (window_hash(self.hashes, self.window, 0x2545F491)[at] >> U(32)).astype(np.uint32)
        return at, a, b


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the top bits, so buckets are slices of sorted hashes."""
    return (((h >> U(40)) * U(n)) >> U(24)).astype(np.int64)


def _slices(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(_bucket(sorted_hashes, n), np.arange(n + 1))


def _low48(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _distinct_anchors(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, starts of the runs of equal hashes in it, and whether a run has two documents."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    d = ids[order]
    many = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) if len(s) else np.zeros(0, bool)
    return order, first, many


def _distinct_windows(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, starts of the runs of equal windows in it, and the smallest document of each."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    if not len(x):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    return order, first, np.minimum.reduceat(ids[order], first)


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _replies(blocks: list[int], bucket: int, bits: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": pa.array(blocks, pa.int32()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _bits(replies: pa.Table, cut: np.ndarray) -> np.ndarray:
    """The bits of a block's sorted hashes, put together from the buckets' replies."""
    out = np.zeros(cut[-1], bool)
    for k, data in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True):
        n = cut[k + 1] - cut[k]
        out[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    return out


def _send_anchors(n: int, window: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        block, _, _ = Block.of(table, window)
        at, h = block.anchors()
        order, first, many = _distinct_anchors(h, block.word_ids()[at])
        distinct = h[order[first]]
        cut, low = _slices(distinct, n), _low48(distinct)
        rows = []
        for k in np.flatnonzero(np.diff(cut)):
            s = slice(cut[k], cut[k + 1])
            rows.append((int(k), key[0].as_py(), np.packbits(many[s]).tobytes() + low[s].tobytes()))
        return _packed(rows)

    return send


def _shared_anchors(key: tuple, table: pa.Table) -> pa.Table:
    blocks, h, many, sizes = table.column("block").to_pylist(), [], [], []
    for data in table.column("data").to_pylist():
        # x hashes of 6 bytes follow ceil(x / 8) bytes of flags
        x = len(data) * 8 // 49
        while (x + 7) // 8 + 6 * x < len(data):
            x += 1
        k = (x + 7) // 8
        raw = np.frombuffer(data, np.uint8)
        wide = np.zeros((x, 8), np.uint8)
        wide[:, :6] = raw[k:].reshape(x, 6)
        h.append(wide.view("<u8").ravel())
        many.append(np.unpackbits(raw[:k], count=x).astype(bool))
        sizes.append(x)
    all_h, all_many = np.concatenate(h), np.concatenate(many)
    order = np.argsort(all_h)
    s = all_h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    shared = all_many
    shared[order] |= twice
    return _replies(blocks, key[0].as_py(), np.split(shared, np.cumsum(sizes)[:-1]))


def _send_windows(n: int, window: int):
    def send(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _packed([])
        block, _, _ = Block.of(docs, window)
        at, a, b = _candidates(block, replies, n)
        order, first, least = _distinct_windows(a, b, block.word_ids()[at])
        x, y = a[order[first]], b[order[first]]
        cut, rows = _slices(x, n), []
        for k in np.flatnonzero(np.diff(cut)):
            s = slice(cut[k], cut[k + 1])
            rows.append((int(k), key[0].as_py(), x[s].tobytes() + least[s].tobytes() + y[s].tobytes()))
        return _packed(rows)

    return send


def _candidates(block: Block, replies: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, h = block.anchors()
    order, first, _ = _distinct_anchors(h, block.word_ids()[at])
    shared = _bits(replies, _slices(h[order[first]], n))
    runs = np.diff(np.append(first, len(order)))
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat(shared, runs)
    return block.windows(at[hit])


def _smaller_elsewhere(key: tuple, table: pa.Table) -> pa.Table:
    """For each entry of a block, whether a document smaller than the block's smallest holds the window."""
    parts, sizes = [], []
    for data in table.column("data").to_pylist():
        x = len(data) // 20
        parts.append((np.frombuffer(data, U, x), np.frombuffer(data, np.int64, x, 8 * x), np.frombuffer(data, np.uint32, x, 16 * x)))
        sizes.append(x)
    a, ids, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order, first, least = _distinct_windows(a, b, ids)
    smaller = np.zeros(len(a), bool)
    smaller[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < ids[order]
    return _replies(table.column("block").to_pylist(), key[0].as_py(), np.split(smaller, np.cumsum(sizes)[:-1]))


def _finish(n: int, window: int, carry: bool, with_text: bool):
    def finish(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        anchor_bits = replies.filter(pc.equal(replies.column("step"), 1))
        window_bits = replies.filter(pc.equal(replies.column("step"), 2))
        block, texts, docs = Block.of(docs, window)
        at, a, b = _candidates(block, anchor_bits, n)
        ids = block.word_ids()[at]
        order, first, least = _distinct_windows(a, b, ids)
        smaller = _bits(window_bits, _slices(a[order[first]], n))
        runs = np.diff(np.append(first, len(order)))
        gone = np.zeros(len(at), bool)
        gone[order] = np.repeat(smaller, runs) | (np.repeat(least, runs) < ids[order])
        gone &= ids != NO_ID
        cover = np.zeros(len(block.hashes) + 1, np.int64)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + window, -1)
        keep = np.cumsum(cover[:-1]) == 0
        ends = np.cumsum(block.counts)
        kept_n = np.diff(np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], ends))])
        digests, out = [], []
        for i, t in enumerate(texts):
            words = (t or b"").split()
            if kept_n[i] != block.counts[i]:
                words = compress(words, keep[ends[i] - block.counts[i] : ends[i]].tolist())
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out.append(t if t is None or kept_n[i] == block.counts[i] else kept)
        cols = {"__id": docs.column("__id"), "n_words": pa.array(block.counts, pa.int64()), "n_removed": pa.array(block.counts - kept_n, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            cols["kept_text"] = pa.array(out, pa.binary()).cast(pa.string())
        if carry:
            cols["__row"] = docs.column("__row")
        return pa.table(cols)

    return finish


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True, carry: bool = False) -> DataFrame:
    """Per row: ``__id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text`` and ``__row``.

    A null text has no words. Rows with equal ids are one document's: they don't remove
    each other. A null id is not smaller or larger than any: such a row loses nothing and
    removes nothing. A text from which nothing is removed comes back as it was; otherwise
    its kept words are joined by one space. Texts shorter than a window lose nothing.
    """
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a window has {2 * PERIOD - 1} words at least")
    rows = carried(docs, id_col, text_col, carry)
    n = scaled_parts(docs)
    # rows of one id may lie in any block: a document doesn't remove what only it has, wherever its rows are
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("__id", "__text"), F.lit(n)).cast("int")).repartition(n, "block")
    by_block = blocks.groupBy("block")
    sent = by_block.applyInArrow(tidy_group("substring", _send_anchors(n, window)), _PACKED)
    shared = sent.groupBy("bucket").applyInArrow(tidy_group("substring", _shared_anchors), _REPLY)
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(tidy_group("substring", _send_windows(n, window)), _PACKED)
    smaller = windows.groupBy("bucket").applyInArrow(tidy_group("substring", _smaller_elsewhere), _REPLY)
    replies = shared.withColumn("step", F.lit(1)).unionByName(smaller.withColumn("step", F.lit(2)))
    out = T.StructType().add("__id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        out = out.add("kept_text", "string")
    if carry:
        out = out.add("__row", rows.schema["__row"].dataType)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(tidy_group("substring", _finish(n, window, carry, with_text)), out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """The rows and columns of ``docs``, with repeated passages cut from the text column."""
    found = repeated_words(docs, id_col, text_col, window, carry=True)
    return restored(found, docs, text_col, F.col("kept_text"))
