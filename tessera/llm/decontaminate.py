"""Benchmark decontamination with a stored, distributed positional inverted index.

``write_index`` reads the documents once and writes, for each term and segment (a run of
documents), the list of the term's positions. The table is dealt by term, so a search
reads the lists of its own terms; a frequent term's lists are dealt over several
partitions by segment. Positions number the words of a segment, with a gap after each
document; the gaps, and what is known of the documents, are postings of terms of their own.

``search`` turns a benchmark into windows, joins their terms with the stored lists, and
brings what was found together by segment. There a window is answered from its rarest
terms: the positions of the rarest, less its offset in the window, are the candidate
starts; the list of the next rarest, adjusted by its own offset, is intersected with
them, and so on, until all terms have been used or no start is left. A proximity search
asks that the terms of a window lie in a run of ``span`` words, in any order.

Nothing of the documents or of the benchmark passes through the driver. Windows are
written to the shared folder in blocks of bounded size; a task reads the block that it
answers. One index serves any number of searches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import CACHES, bound_batches, materialize, restored, scaled_parts, shared_dir, stable, tidy, tidy_group
from tessera.llm.warc import _store
from tessera.llm.words import PUNCT, Words, chunks, find_words

#: Windows in a block, which one task holds with the postings of one segment.
BLOCK_WINDOWS = 50_000
#: Text in a segment of the index.
SEGMENT_BYTES = 4 << 20
#: Terms of a search, and contaminated documents, up to these numbers are sent to all tasks; more are merge-joined.
SMALL_TERMS, SMALL_DOCS = 1_000_000, 1_000_000
#: The terms whose positions are the gaps after documents, and whose list has the documents themselves.
GAP, DOCS = 0, 1
_INDEX = "term long, segment long, n int, at binary"
#: A document in the list of DOCS.
_DOC = np.dtype([("id", "<i8"), ("h", "<i8"), ("n_words", "<i8"), ("null", "<i8")])


def packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Ascending numbers below 2^28, one list after the other, as differences of seven bits a byte; ``cut`` has where each list begins."""
    d = np.diff(values, prepend=0)
    d[cut[:-1]] = values[cut[:-1]]
    size = 1 + (d >= 1 << 7) + (d >= 1 << 14) + (d >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        some = size > k
        out[(ends - size)[some] + k] = (d[some] >> (7 * k) & 127) | np.where(size[some] > k + 1, 128, 0)
    offsets = np.concatenate(([0], ends))[cut].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(lists: Sequence[bytes], sizes: np.ndarray) -> np.ndarray:
    """The numbers of all lists, one list after the other."""
    raw = np.frombuffer(b"".join(lists), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], raw[:-1] < 128)))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    d = np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)
    total = np.cumsum(d)
    begins = np.cumsum(sizes) - sizes
    return total - np.repeat(total[begins] - d[begins], sizes)


class Postings:
    """Positional postings of one segment for the terms of a search."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, at: np.ndarray, gaps: np.ndarray) -> None:
        """terms: ascending hashes; at: their positions, one list of ``sizes`` after the other; gaps: positions after each document."""
        self.terms, self._at = terms, at
        self._cut = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.first = np.concatenate(([0], gaps[:-1] + 1)).astype(np.int64) if len(gaps) else np.zeros(0, np.int64)
        self.counts = gaps - self.first

    @classmethod
    def of_texts(cls, texts: Sequence[bytes | None]) -> Postings:
        terms, sizes, at, gaps = posted(texts)
        return cls(terms, sizes, at, gaps)

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Term numbers of hashes; -1 for those that the segment lacks."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def of(self, term: int) -> np.ndarray:
        """Ascending positions of a term."""
        return self._at[self._cut[term] : self._cut[term + 1]]

    def df(self, term: int) -> int:
        return int(self._cut[term + 1] - self._cut[term])

    def phrase(self, terms: Sequence[int]) -> np.ndarray:
        """Starts of exact occurrences of consecutive terms."""
        by_rarity = sorted(range(len(terms)), key=lambda o: self.df(terms[o]))
        starts = self.of(terms[by_rarity[0]]) - by_rarity[0]
        for o in by_rarity[1:]:
            if not len(starts):
                break
            other = self.of(terms[o])
            i = np.searchsorted(other, starts + o)
            i[i == len(other)] = 0
            starts = starts[other[i] == starts + o] if len(other) else starts[:0]
        return starts

    def spans(self, terms: Sequence[int], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of at most ``span`` words of one document that hold all the terms: begin, end, and a position of the rarest term."""
        by_rarity = sorted(set(terms), key=self.df)
        near = self.of(by_rarity[0])
        doc = np.searchsorted(self.first, near, "right") - 1
        rest = [self.of(t) for t in by_rarity[1:]]
        for other in rest:  # what is far from any one term is far from all
            if not len(near) or not len(other):
                return near[:0], near[:0], near[:0]
            i = np.searchsorted(other, near)
            ok = np.zeros(len(near), bool)
            for j in (np.maximum(i - 1, 0), np.minimum(i, len(other) - 1)):
                ok |= np.abs(other[j] - near) < span
            near, doc = near[ok], doc[ok]
        begins, ends, at = [near[:0]], [near[:0]], [near[:0]]
        for back in range(span):
            begin = np.maximum(near - back, self.first[doc])
            end = np.minimum(near - back + span, self.first[doc] + self.counts[doc])
            ok = np.ones(len(near), bool)
            for other in rest:
                i = np.searchsorted(other, begin)
                ok &= (i < len(other)) & (other[np.minimum(i, len(other) - 1)] < end)
            begins.append(begin[ok])
            ends.append(end[ok])
            at.append(near[ok])
        return np.concatenate(begins), np.concatenate(ends), np.concatenate(at)

    def within(self, terms: Sequence[int], span: int) -> np.ndarray:
        """Positions of the rarest term that lie in a run of ``span`` words of one document with all the terms."""
        return np.unique(self.spans(terms, span)[2])


def hashed(words: Words) -> np.ndarray:
    """The term of each word; no word has that of GAP or DOCS."""
    h = words.hashes().view(np.int64)
    return np.where((h == GAP) | (h == DOCS), h + 2, h)


def posted(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment: its terms ascending, the size of each list, all positions, and the gaps after documents."""
    words = find_words(texts, PUNCT, lower=True)
    h, counts = hashed(words), words.counts()
    at = np.arange(len(h)) + words.doc_of_word()
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s))), at[order], np.cumsum(counts + 1) - 1


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    segment = TaskContext.get().partitionId() << 32
    names = ["term", "segment", "n", "at"]
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for a, b in chunks(texts, SEGMENT_BYTES):
            terms, sizes, at, gaps = posted(texts[a:b])
            terms, sizes, at = np.append(terms, GAP), np.append(sizes, len(gaps)), np.append(at, gaps)
            lists = packed(at, np.concatenate(([0], np.cumsum(sizes))))
            for i in range(0, len(terms), 50_000):
                own = lists[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 50_000]), pa.repeat(segment, len(own)), pa.array(sizes[i : i + 50_000], pa.int32()), own], names)
            docs = np.zeros(b - a, _DOC)
            docs["id"], docs["h"] = batch.column(0)[a:b].fill_null(0).to_numpy(), batch.column(1)[a:b].to_numpy()
            docs["n_words"], docs["null"] = np.diff(gaps, prepend=-1) - 1, np.asarray(batch.column(0)[a:b].is_null())
            yield pa.RecordBatch.from_arrays([pa.array([DOCS]), pa.array([segment]), pa.array([b - a], pa.int32()), pa.array([docs.tobytes()], pa.binary())], names)
            segment += 1


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> str:
    """Write the index of ``docs`` and return its folder, a table of ``term``, ``segment``, ``n`` (positions) and ``at``.

    Null texts have no words. Rows with equal ids stay apart. A segment is of at most SEGMENT_BYTES or one text, which
    may have up to 2^28 words.
    """
    bound_batches(docs.sparkSession)
    folder = folder or shared_dir(docs.sparkSession)
    rows = stable(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text")))
    n = scaled_parts(docs)
    found = rows.mapInArrow(tidy("decontaminate", _post), _INDEX)
    # a frequent term has a list a segment: they go to about the root of the partitions
    spread = F.pmod("segment", F.lit(max(1, round(n**0.5))))
    found.repartition(n, "term", spread).sortWithinPartitions("term").write.parquet(folder)
    return folder


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            d = np.frombuffer(data, _DOC)
            cols = [pa.repeat(segment, len(d)), pa.array(np.arange(len(d)), pa.int32()), pa.array(d["id"], mask=d["null"] > 0), pa.array(d["h"]), pa.array(d["n_words"])]
            yield pa.RecordBatch.from_arrays(cols, ["segment", "doc", "id", "h", "n_words"])


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of an index: ``segment``, ``doc`` (their number in it), ``id``, ``h`` (a hash of the text) and ``n_words``."""
    rows = spark.read.schema(_INDEX).parquet(folder).where(F.col("term") == DOCS).select("segment", "at")
    return rows.mapInArrow(_documents, "segment long, doc int, id long, h long, n_words long")


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            names = batch.column(0).fill_null("").to_pylist()
            for a, b in chunks(texts, 1 << 20):
                words = find_words(texts[a:b], PUNCT, lower=True)
                h = hashed(words)
                for i, name in enumerate(names[a:b]):
                    own = h[words.bounds[i] : words.bounds[i + 1]]
                    width = min(window, len(own))
                    n = len(own) - width + 1 if width else 0
                    for at in range(0, n, 20_000):
                        m = min(20_000, n - at)
                        flat = np.lib.stride_tricks.sliding_window_view(own[at : at + m + width - 1], width).ravel()
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * width, pa.int32()), pa.array(flat))
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, m), lists], ["item", "terms"])

    return run


@dataclass
class Block:
    """Distinct windows of a search: hashes, their terms (rows padded with the last one) and lengths."""

    ids: np.ndarray
    terms: np.ndarray
    sizes: np.ndarray


_blocks: dict[tuple[str, int], Block] = {}
CACHES["decontaminate"] = _blocks.clear


def _block(folder: str, number: int) -> Block:
    """A block of windows from the shared folder, kept by the worker until it is asked for another."""
    key = folder, number
    if key not in _blocks:
        fs, path = _store(f"{folder}/block={number}")
        table = pq.read_table(path, columns=["wid", "terms"], filesystem=fs, partitioning=None)
        order = np.argsort(table.column("wid").to_numpy(), kind="stable")
        lists = table.column("terms").combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        begins, flat = np.cumsum(sizes) - sizes, lists.flatten().to_numpy()
        width = int(sizes.max(initial=1))
        terms = flat[begins[:, None] + np.minimum(np.arange(width), sizes[:, None] - 1)]
        _blocks.clear()
        _blocks[key] = Block(table.column("wid").to_numpy()[order], terms[order], sizes[order])
    return _blocks[key]


def answered(index: Postings, block: Block, span: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each document with an occurrence: its number, its hit words' positions and the windows that occur."""
    numbers = index.number(block.terms)
    edge = np.zeros(int(np.sum(index.counts)) + len(index.counts) + 1, np.int32)
    occur: list[tuple[np.ndarray, int]] = []
    for i in np.flatnonzero((numbers >= 0).all(axis=1)).tolist():
        w = numbers[i, : block.sizes[i]].tolist()
        if span is None:
            starts = index.phrase(w)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + len(w), -1)
        else:
            starts, ends, _ = index.spans(w, span)
            if len(starts):
                order = np.argsort(starts, kind="stable")
                begins, reach = starts[order], np.maximum.accumulate(ends[order])
                for t in set(w):
                    at = index.of(t)
                    k = np.searchsorted(begins, at, "right") - 1
                    at = at[(k >= 0) & (at < reach[k])]
                    edge[at] += 1
                    edge[at + 1] -= 1
        if len(starts):
            occur.append((np.unique(np.searchsorted(index.first, starts, "right") - 1), int(block.ids[i])))
    if not occur:
        return
    docs = np.concatenate([d for d, _ in occur])
    windows = np.repeat(np.array([w for _, w in occur]), [len(d) for d, _ in occur])
    hit = np.cumsum(edge[:-1]) > 0
    order = np.argsort(docs, kind="stable")
    docs, windows = docs[order], windows[order]
    for own in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1):
        d = int(docs[own[0]])
        yield d, np.flatnonzero(hit[index.first[d] : index.first[d] + index.counts[d]]), windows[own]


def _answer(folder: str, span: int | None):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        segment, block = key[0].as_py(), key[1].as_py()
        rows: list[tuple] = []
        if table.num_rows > 1:
            table = table.sort_by("term")
            terms, sizes = table.column("term").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            at = unpacked(table.column("at").to_pylist(), sizes)
            cut = np.concatenate(([0], np.cumsum(sizes)))
            gap = int(np.flatnonzero(terms == GAP)[0])
            own = np.ones(len(at), bool)
            own[cut[gap] : cut[gap + 1]] = False
            index = Postings(np.delete(terms, gap), np.delete(sizes, gap), at[own], at[~own])
            rows = list(answered(index, _block(folder, block), span))
        return pa.table({
            "segment": pa.array([segment] * len(rows), pa.int64()), "doc": pa.array([r[0] for r in rows], pa.int32()),
            "hits": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "windows": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
        })

    return run


def search(spark: SparkSession, folder: str, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13, span: int | None = None) -> DataFrame:
    """Per row of the index's documents: ``id``, ``h``, ``n_words``, ``hits`` (positions of hit words) and ``items`` (names, sorted).

    A word is hit if it lies inside an occurrence of a window of an item: ``window`` consecutive words, or all of an
    item that has fewer. Items without words have none; a null item id is named ''. With ``span`` the words of a
    window may come in any order, among others: hit are those that lie in a run of ``span`` words of the document
    that holds all of the window's.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    asked = materialize(items.mapInArrow(tidy("decontaminate", _windows(window)), "item string, terms array<long>").withColumn("wid", F.xxhash64("terms")).dropDuplicates(["item", "wid"]))
    number = asked.select(F.approx_count_distinct("wid")).first()[0]
    blocks = max(1, -(-int(number * 1.1) // BLOCK_WINDOWS))
    windows = asked.dropDuplicates(["wid"]).select("wid", "terms", F.pmod(F.xxhash64("wid", F.lit(11)), F.lit(blocks)).cast("int").alias("block"))
    stored = shared_dir(spark)
    windows.repartition(blocks, "block").write.partitionBy("block").parquet(stored)
    windows = spark.read.schema("wid long, terms array<long>, block int").parquet(stored)
    terms = materialize(windows.select("block", F.explode("terms").alias("term")).union(windows.select("block", F.lit(GAP).cast("long"))).distinct())
    postings = spark.read.schema(_INDEX).parquet(folder)
    small = terms.count() <= SMALL_TERMS
    found = postings.join(F.broadcast(terms) if small else terms.hint("merge"), "term").groupBy("segment", "block").applyInArrow(tidy_group("decontaminate", _answer(stored, span)), "segment long, doc int, hits array<int>, windows array<long>")
    found = materialize(found)
    names = asked.select("wid", "item")
    named = found.select("segment", "doc", F.explode("windows").alias("wid")).join(F.broadcast(names) if small else names, "wid").groupBy("segment", "doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = found.groupBy("segment", "doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    out = indexed(spark, folder).join(hits.join(named, ["segment", "doc"]), ["segment", "doc"], "left")
    return out.select("id", "h", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, span: int | None = None) -> DataFrame:
    """What ``search`` finds in a new index of ``docs``: one row for each of its rows."""
    return search(docs.sparkSession, write_index(docs, id_col, text_col), benchmark, item_col, item_text_col, window, span)


def judged(found: DataFrame) -> DataFrame:
    """``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` (a twentieth of the words or more) beside what ``search`` returns."""
    n_hit = F.size("hits").cast("long")
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.0, **names: str) -> DataFrame:
    """The rows of ``docs`` without those that hold a window of an item and of whose words ``share`` or more are hit.

    With the default a row with any occurrence goes. Rows with equal ids stay apart, but for those with equal texts;
    null ids are ids like others.
    """
    found = overlaps(docs, benchmark, id_col, text_col, **names)
    bad = materialize(found.where((F.size("hits") > 0) & (F.size("hits") >= share * F.col("n_words"))).select(F.col("id").alias("__bad"), F.col("h").alias("__h")).distinct())
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__id"), F.xxhash64(f"`{text_col}`").alias("__own"))
    kept = kept.join(F.broadcast(bad) if bad.count() <= SMALL_DOCS else bad, F.col("__id").eqNullSafe(F.col("__bad")) & (F.col("__own") == F.col("__h")), "left_anti")
    return restored(kept, docs, text_col, F.col(f"__row.`{text_col}`"))
