"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records. A
skippable frame with the map from record id to (frame, offset inside it, length) follows,
then the seek table of the public seekable format: compressed and decompressed size of
each frame, and a footer with their number. A reader of one record fetches the footer, the
table and one frame; a reader of all goes frame by frame. Tools that know only Zstandard
skip both frames.

Payloads that occur again are written once: the record with the smallest id is a
response, the others are revisits without a payload that name it. Only digests meet by
payload; a payload itself travels under its own record's key, so copies never gather.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bound_batches, materialize, shared_dir

#: Fixed values of the seekable format: skippable frame numbers, footer mark.
INDEX_FRAME, TABLE_FRAME, FOOTER_MARK = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Records are added to a frame, and frames to a bundle, until these many bytes (before and after compression).
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
LEVEL = 3


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(rid: str, kind: str, url: str, payload: bytes, payload_bytes: int, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit's block is empty."""
    clean = " ".join(url.split())
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{rid}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case) and block of the record at an offset, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than its header says")
    return head, data[start:stop], stop + 4


class Bundle:
    """Writes records into frames; ``finish`` gives the whole file."""

    def __init__(self) -> None:
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._open: list[bytes] = []
        self._open_size = 0
        self._index: list[tuple[str, int, int, int]] = []
        self.size = 0

    def add(self, rid: str, data: bytes) -> None:
        self._index.append((rid, len(self._frames), self._open_size, len(data)))
        self._open.append(data)
        self._open_size += len(data)
        if self._open_size >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self._open:
            frame = self._zstd.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._open_size))
            self.size += len(frame)
            self._open, self._open_size = [], 0

    def finish(self) -> bytes:
        self._close()
        index = self._zstd.compress(json.dumps(self._index, separators=(",", ":")).encode())
        table = b"".join(struct.pack("<II", *x) for x in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, FOOTER_MARK)
        return b"".join([*self._frames, struct.pack("<II", INDEX_FRAME, len(index)), index, struct.pack("<II", TABLE_FRAME, len(table)), table])


class BundleReader:
    """Random and sequential access to a bundle (bytes, or an open file) by ranges of bytes only.

    ``index`` has the places of each record id: records of one id, or without one (''), are all there.
    """

    def __init__(self, source) -> None:
        self._file = io.BytesIO(source) if isinstance(source, bytes) else source
        size = self._file.seek(0, 2) if isinstance(source, bytes) else self._file.size()
        n, _, mark = struct.unpack("<IBI", self._range(size - 9, 9))
        if mark != FOOTER_MARK:
            raise ValueError("no seek table at the end")
        table = self._range(size - 9 - 8 * n, 8 * n)
        self.frames: list[tuple[int, int, int]] = []  # place, compressed size, size
        at = 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        kind, length = struct.unpack("<II", self._range(at, 8))
        if kind != INDEX_FRAME:
            raise ValueError("no record map after the frames")
        self.index: dict[str, list[tuple[int, int, int]]] = {}
        for r, f, o, n in json.loads(zstandard.ZstdDecompressor().decompress(self._range(at + 8, length))):
            self.index.setdefault(r, []).append((f, o, n))

    def _range(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        data = self._file.read(size)
        if len(data) != size:
            raise ValueError("the bundle is shorter than its tables say")
        return data

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self._range(at, packed), max_output_size=max(plain, 1))

    def get_all(self, rid: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records of an id: each costs one frame."""
        for f, offset, _ in self.index[rid]:
            head, block, _ = parse(self.frame(f), offset)
            yield head, block

    def get(self, rid: str) -> tuple[dict[str, str], bytes]:
        """The first record of an id."""
        return next(self.get_all(rid))

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.frames)):
            data, at = self.frame(i), 0
            while at < len(data):
                head, block, at = parse(data, at)
                yield head, block


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, with the path in it."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(folder).path
    return pafs.FileSystem.from_uri(folder)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = _store(folder)
        bundle, number = Bundle(), 0

        def flush() -> pa.RecordBatch:
            """Write under the attempt's own name, then rename: a task that runs again leaves the same file."""
            nonlocal bundle, number
            name = f"part-{context.partitionId():06d}-{number:04d}.warc.zst"
            own = f"{path}/_{name}.{context.taskAttemptId()}"
            data, n = bundle.finish(), len(bundle._index)
            with fs.open_output_stream(own) as out:
                out.write(data)
            fs.move(own, f"{path}/{name}")
            bundle, number = Bundle(), number + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([len(data)], pa.int64())], ["name", "records", "bytes"])

        for batch in batches:
            for pid, url, html, kind, refers_to, size, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                rid = "" if pid is None else str(pid)
                target = "" if refers_to is None else str(refers_to)
                bundle.add(rid, record(rid, kind, url or "", html or b"", size, sha, target))
                if bundle.size >= BUNDLE_BYTES:
                    yield flush()
        if bundle._index:
            yield flush()

    return run


#: Copies from which on a payload's smallest id is sent to all tasks, if there are no more than so many payloads of the kind.
COPIES, PAYLOADS, SALTS = 200, 100_000, 64


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(``pid``, ``url``, ``html``, ``kind``, ``refers_to``, ``size``, ``sha``): which record is a response, which a revisit (its html is null).

    Payloads are equal if their SHA-256 and length are; a null one is empty. Those of fewer than ``least`` bytes
    are always responses. Records with equal payloads and equal smallest ids are all responses. A null id comes
    after all others: such a record revisits, if there is another.
    """
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.encode(F.col(f"`{html_col}`"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("pid"), F.col(f"`{url_col}`").alias("url"), payload.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("h"), F.sha1("html").alias("sha"))
    slim = materialize(rows.select("pid", "url", "size", "h", "sha"))
    first = slim.where(F.col("size") >= least).groupBy("h", "size").agg(F.min("pid").alias("least_pid"), F.count(F.lit(1)).alias("n"))
    again = materialize(first.where("n > 1"))
    many = max(COPIES, (slim.count() if again.limit(1).count() else 0) // PAYLOADS)
    hot = F.broadcast(again.where(F.col("n") >= many).select(F.col("h").alias("hot_h"), F.col("size").alias("hot_size"), F.col("least_pid").alias("hot_pid")))
    asked = slim.join(hot, (F.col("h") == F.col("hot_h")) & (F.col("size") == F.col("hot_size")), "left")
    copies = asked.where("hot_h IS NOT NULL").withColumn("least_pid", F.col("hot_pid"))
    others = asked.where("hot_h IS NULL").join(again.where(F.col("n") < many), ["h", "size"])
    names = ["pid", "url", "size", "sha", "least_pid"]
    copies = copies.select(*names).unionAll(others.select(*names)).where(F.col("least_pid").isNotNull() & ~F.col("pid").eqNullSafe(F.col("least_pid")))
    revisits = copies.select("pid", "url", F.lit(None).cast("binary").alias("html"), F.lit("revisit").alias("kind"), F.col("least_pid").alias("refers_to"), "size", "sha")
    # of a payload that occurs again only the first record keeps it; what occurs once stays where it is read
    mark = again.where("least_pid IS NOT NULL").select(F.col("h").alias("fh"), F.col("size").alias("fs"), F.col("least_pid").alias("keep"))
    same = (F.col("h") == F.col("fh")) & (F.col("size") == F.col("fs"))
    if mark.count() <= PAYLOADS:
        kept = rows.join(F.broadcast(mark), same, "left")
    else:  # copies are spread over salts of their payload
        salted = mark.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = rows.withColumn("own", F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own") == F.col("salt")), "left")
    kept = kept.where(F.col("keep").isNull() | F.col("pid").eqNullSafe(F.col("keep")))
    return kept.select("pid", "url", "html", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to"), "size", "sha").unionAll(revisits)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write bundles of what ``planned`` gives to a folder that all executors reach; (``name``, ``records``, ``bytes``) of each."""
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    # in one order, so that a task that runs again writes the same bundles under the same names
    ordered = records.select("pid", "url", "html", "kind", "refers_to", "size", "sha").sortWithinPartitions("pid", "sha", "url")
    return ordered.mapInArrow(_writer(folder), "name string, records long, bytes long")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(x: str) -> int | None:
        x = x.rpartition(":")[2].rstrip(">")
        return int(x) if x else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows: list[tuple] = []
            held = 0
            fs, path = _store(uri)
            for head, block in BundleReader(fs.open_input_file(path)):
                kind = head["warc-type"]
                if kind == "response" and (digest(block) != head["warc-payload-digest"].removeprefix("sha1:") or len(block) != int(head["x-payload-length"])):
                    raise ValueError("a payload differs from its digest")
                refers = number(head["warc-refers-to"]) if kind == "revisit" else None
                rows.append((number(head["warc-record-id"]), head["warc-target-uri"], int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), kind, refers, block if kind == "response" else None))
                held += len(block)
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of a folder's bundles: ``record_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``payload`` (null for revisits)."""
    kind = "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    # only the names are read here; the reader fetches tables and frames by ranges
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    return files.select("path").mapInArrow(_reader, kind)


def archived(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Write the pages as bundles, then read them back. The folder is a new one in the shared place if none is given.

    No pages make no bundles and no rows. Null payloads are empty ones; extra columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    written = write_archives(planned(pages, **names), folder).agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return read_archives(spark, folder)


def remove(folder: str) -> None:
    """Delete a folder of bundles."""
    fs, path = _store(folder)
    if os.path.basename(path):
        fs.delete_dir(path)
