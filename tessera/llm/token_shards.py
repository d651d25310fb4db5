"""Token sequences in training order, as fixed-stride shards.

Every document's tokens are cut into sequences of ``length`` tokens, the last one padded.
Sequences are numbered densely: a first pass counts them by scan partition, so a
sequence's number is its partition's offset plus its place. A keyed Feistel network over
the smallest even power of two permutes the numbers, and walks along its cycle until the
image is below their count: a bijection of the numbers onto global slots that any reader
can compute and invert from the key alone.

Slots are dealt by range: each shard holds consecutive slots in fixed strides, so slot s
begins at byte (s mod per_shard) * stride of shard s // per_shard. Readers go on from any
slot without an index. Beside each shard lies a table of the same kind that names each
slot's document.

Ids take as many bytes as the vocabulary asks for. The query uses a BPE file; without one ids are the bytes of
UTF-8 with two that UTF-8 never uses, for the end of a document and for padding.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import bound_batches, materialize, shared_dir, tidy
from tessera.llm.warc import _store
from tessera.llm.words import U, mix

END, PAD = 0xFF, 0xFE
ROUNDS = 6
#: Bytes of a shard, about; more for inputs that would make over MOST_SHARDS.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1_000_000
#: How hard what a shard is made of is compressed on its way: disk is scarcer than the time that this takes.
PIECE_LEVEL = 6
STORED = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20), "parquet.enable.dictionary": "false"}
#: A slot's entry in the table beside a shard.
ENTRY = np.dtype([("doc", "<i8"), ("chunk", "<i4"), ("tokens", "<i4")])


class Permutation:
    """A keyed bijection of 0 .. n-1."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self._half, self._mask = U(half), U((1 << half) - 1)
        seed = int.from_bytes(hashlib.sha256(f"{key}".encode()).digest()[:8], "little")
        self._keys = mix((np.arange(1, ROUNDS + 1).astype(U) * U(0x9E3779B97F4A7C15)) ^ U(seed))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self._half, x & self._mask
        for k in keys:
            if back:
                left, right = right ^ (mix(left + k) & self._mask), left
            else:
                left, right = right, left ^ (mix(right + k) & self._mask)
        return left << self._half | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        y = self._once(np.asarray(x, U), keys, back)
        out = np.flatnonzero(y >= U(self.n))
        while len(out):
            y[out] = self._once(y[out], keys, back)
            out = out[y[out] >= U(self.n)]
        return y.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self._keys, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._keys[::-1], True)


def _byte_tokens(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode() + bytes([END]), np.uint8)


def _tokens(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for x in batch.column(1).to_pylist():
        yield _byte_tokens(x) if width == 1 else np.frombuffer(x, f"<u{width}")


def _packer(spec, width: int, end: int):
    """(doc, text): each text's ids and ``end``, in ``width`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(spec.value)
        for b in batches:
            kind, last = np.dtype(f"<u{width}"), np.array(end, f"<u{width}").tobytes()
            runs = (codec.encode_packed(part) for part in bpe.text_runs(b.column(1).to_pylist()))
            ids = [(x if codec.kind == kind else np.frombuffer(x, codec.kind).astype(kind).tobytes()) + last for run in runs for x in run]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc", "text"])

    return run


def _packed(slot: np.ndarray, entry: np.ndarray, data: np.ndarray, zstd) -> bytes:
    return zstd.compress(b"".join([slot.astype("<i8").tobytes(), entry.tobytes(), data.tobytes()]))


def _slots(length: int, width: int, pad: int, offsets, permutation: Permutation, per_shard: int):
    """(shard, n, data): a batch's sequences by shard, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        at, stop = offsets.value.get(pid, (0, 0))
        zstd = zstandard.ZstdCompressor(level=PIECE_LEVEL)
        for batch in batches:
            tokens = list(_tokens(batch, width))
            sizes = np.array([len(x) for x in tokens], np.int64)
            counts = -(-sizes // length)
            total = int(counts.sum())
            if not total:
                continue
            full = np.full((total, length), pad, f"<u{width}")
            flat = full.reshape(-1)
            ends = np.cumsum(counts)
            for x, row in zip(tokens, (ends - counts).tolist(), strict=True):
                flat[row * length : row * length + len(x)] = x
            entry = np.empty(total, ENTRY)
            entry["doc"] = np.repeat(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), counts)
            entry["chunk"] = np.arange(total) - np.repeat(ends - counts, counts)
            entry["tokens"] = np.minimum(np.repeat(sizes, counts) - entry["chunk"] * length, length)
            slot = permutation.slot(np.arange(at, at + total))
            at += total
            shard = slot // per_shard
            order = np.argsort(shard, kind="stable")
            cut = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), total)
            parts = [order[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([_packed(slot[p], entry[p], full[p], zstd) for p in parts], pa.binary())], ["shard", "n", "data"])
        if at != stop:
            raise RuntimeError(f"partition {pid} has other rows than when they were counted")

    return run


def _write(folder: str, total: int, length: int, width: int, per_shard: int):
    """Fill each shard from its parts, which come one after the other, and write it with its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = _store(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, filled, data, entry = -1, 0, None, None

        def close() -> int:
            """Under the attempt's own names first, then renamed: a task that runs again leaves the same files."""
            if shard < 0:
                return 0
            if filled != len(entry):
                raise RuntimeError(f"shard {shard} has {filled} of {len(entry)} sequences")
            for end, content in (("bin", data), ("idx", entry)):
                name = f"{path}/shard-{shard:08d}.{end}"
                with fs.open_output_stream(f"{name}.{attempt}") as out:
                    out.write(memoryview(content).cast("B"))
                fs.move(f"{name}.{attempt}", name)
            return filled

        done = 0
        for batch in batches:
            for s, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    done += close()
                    shard, filled = s, 0
                    size = min(per_shard, total - s * per_shard)
                    data, entry = np.empty((size, length * width), np.uint8), np.empty(size, ENTRY)
                raw = zstandard.ZstdDecompressor().decompress(packed)
                at = np.frombuffer(raw, "<i8", n) - s * per_shard
                entry[at] = np.frombuffer(raw, ENTRY, n, 8 * n)
                data[at] = np.frombuffer(raw, np.uint8, offset=(8 + ENTRY.itemsize) * n).reshape(n, -1)
                filled += n
        done += close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["count"])

    return run


def write_shards(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 512, key: int = 1, vocabulary: str | None = None) -> str:
    """Write the documents' sequences in training order; returns the folder.

    Without a vocabulary ids are bytes and each text ends in END, so null and empty texts
    have one token. With a BPE vocabulary file ids take 2 bytes (4 beyond 65,534 ids), and
    the ids are written once to the shared folder, not encoded twice. No documents make
    no shards. Rows with equal ids stay apart; a null id is -1 in the table of slots.
    """
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    folder = folder or shared_dir(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    width, pad = 1, PAD
    n_tokens = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    if vocabulary is not None:
        spec = bpe.vocabulary_file(vocabulary)
        most = max(json.loads(spec)["model"]["vocab"].values()) + 4
        width = 2 if most < 1 << 16 else 4
        pad = (1 << 8 * width) - 1
        rows = materialize(rows.mapInArrow(tidy("bpe", _packer(spark.sparkContext.broadcast(spec), width, pad - 1)), "doc long, text binary"), "zstd", STORED)
        n_tokens = F.octet_length("text") / width
    elif "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = materialize(rows)  # what a shuffle deals out may be dealt otherwise the second time
    # the same scan is read twice; the second pass checks that each partition counts alike
    counted = rows.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum(F.ceil(n_tokens / length)).alias("n")).orderBy("pid").collect()
    offsets, total = {}, 0
    for r in counted:
        offsets[r.pid] = (total, total + int(r.n))
        total += int(r.n)
    stride = length * width
    per_shard = max(1, SHARD_BYTES // stride, math.ceil(total / MOST_SHARDS))
    shards = math.ceil(total / per_shard)
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    meta = {"sequences": total, "length": length, "width": width, "per_shard": per_shard, "shards": shards, "key": key, "pad": pad}
    if total:
        parts = rows.mapInArrow(tidy("shards", _slots(length, width, pad, spark.sparkContext.broadcast(offsets), Permutation(total, key), per_shard)), "shard long, n long, data binary")
        placed = parts.repartition(shards, "shard").sortWithinPartitions("shard")
        written = placed.mapInArrow(tidy("shards", _write(folder, total, length, width, per_shard)), "count long").agg(F.sum("count")).first()[0]
        if written != total:
            raise RuntimeError(f"{written} of {total} sequences were written")
    with fs.open_output_stream(f"{path}/meta.json") as out:
        out.write(json.dumps(meta).encode())
    return folder


def meta_of(folder: str) -> dict:
    fs, path = _store(folder)
    with fs.open_input_stream(f"{path}/meta.json") as f:
        return json.loads(f.read())


def sequences(folder: str, start: int = 0) -> Iterator[np.ndarray]:
    """Sequences from slot ``start`` on, in training order, by sequential reads."""
    m = meta_of(folder)
    fs, path = _store(folder)
    stride = m["length"] * m["width"]
    for shard in range(start // m["per_shard"], m["shards"]):
        with fs.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(max(0, start - shard * m["per_shard"]) * stride)
            while data := f.read(stride):
                yield np.frombuffer(data, f"<u{m['width']}")


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """(``slot``, ``shard``, ``at``, ``doc_id``, ``chunk``, ``n_tokens``, ``sha256``) of every slot, read from the shards."""
    m = meta_of(folder)
    kind = "slot long, shard long, at long, doc_id long, chunk int, n_tokens int, sha256 string"
    if not m["shards"]:
        return spark.createDataFrame([], kind)
    stride = m["length"] * m["width"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/shard-{shard:08d}.idx") as index, fs.open_input_file(f"{path}/shard-{shard:08d}.bin") as data:
                    first = shard * m["per_shard"]
                    while block := index.read(ENTRY.itemsize * 4096):
                        e = np.frombuffer(block, ENTRY)
                        raw = data.read(stride * len(e))
                        if len(raw) != stride * len(e):
                            raise ValueError(f"shard {shard} is shorter than its table")
                        slot = np.arange(first, first + len(e))
                        sha = [hashlib.sha256(raw[i * stride : (i + 1) * stride]).hexdigest() for i in range(len(e))]
                        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(e), shard)), pa.array((slot - shard * m["per_shard"]) * stride), pa.array(e["doc"], mask=e["doc"] == -1), pa.array(e["chunk"]), pa.array(e["tokens"]), pa.array(sha)], ["slot", "shard", "at", "doc_id", "chunk", "n_tokens", "sha256"])
                        first += len(e)

    return spark.range(0, m["shards"], 1, min(m["shards"], 10_000)).mapInArrow(read, kind)
