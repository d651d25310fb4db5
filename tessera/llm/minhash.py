"""Near-duplicate groups of documents by min-max hashing, with exact confirmation.

A document's set is its distinct shingles of ``width`` lower-cased words. Under each of
PERMUTATIONS hashes both the smallest and the largest value are kept: each of the two
agrees between two documents with a probability that is their Jaccard similarity, so a
signature of 2k values costs k hash evaluations a shingle. Some values in a row make a
band; two documents that share a band are candidates. Bands are as long as a pair at the
threshold allows if it is to share none with a probability of 1e-8 at most: five values
at a similarity of 0.85 (7e-9), four at 0.8 (7e-10).

Documents with equal sets are one class from the start, and only the class's smallest
document goes on, so thousands of copies cost no more than one. Candidates are joined to
coarse clusters; each cluster's texts meet once, and links within it are confirmed on
the full sets. Members compare in the order of how typical their shingles are of the
cluster, and only with members that they share a band with and aren't connected to yet:
the original of a thousand edited copies comes first and connects them all. Larger
clusters are dealt over pairs of their parts. What is sent on is a spanning forest, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bound_batches, materialize, scaled_parts, tidy, tidy_group
from tessera.llm.components import connected
from tessera.llm.words import SPACE, U, chunks, find_words, mix, window_hash

PERMUTATIONS = 80
#: Most likely loss of a pair at the threshold.
MOST_LOSS = 1e-8
#: Members of a cluster, and shingles of theirs, that one task compares with each other or with as many others.
PART_MEMBERS, PART_SHINGLES = 3000, 2_000_000
_ODD = mix(np.arange(1, 2 * PERMUTATIONS + 1).astype(U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(texts: Sequence[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin.

    A text of fewer words than ``width`` has one shingle, its words; one without words has none.
    """
    w = find_words(texts, SPACE, lower=True)
    h, n = w.hashes(), w.counts()
    doc = w.doc_of_word()
    left = w.ends_of_docs() - np.arange(len(h))
    full = window_hash(h, width, 0x3C6EF372)
    at = np.flatnonzero(left[: len(full)] >= width)
    parts, docs = [full[at]], [doc[at]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            parts.append(window_hash(h, k, 0x1F83D9AB + k)[w.bounds[short]])
            docs.append(short)
    s, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    if len(s):
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])))
        s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(texts) + 1))


def signatures(s: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Min and max of each permutation, side by side; rows of texts without shingles are zero."""
    out = np.zeros((len(cut) - 1, 2 * PERMUTATIONS), np.uint32)
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        at = cut[some]
        for k in range(PERMUTATIONS):
            v = s * _ODD[2 * k]
            v ^= v >> U(31)
            v *= _ODD[2 * k + 1]
            v = (v >> U(32)).astype(np.uint32)
            out[some, 2 * k] = np.minimum.reduceat(v, at)
            out[some, 2 * k + 1] = np.maximum.reduceat(v, at)
    return out


def band_rows(percent: int) -> int:
    """Values in a band."""
    fit = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MOST_LOSS]
    return max(fit, default=1)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band, different for different bands."""
    n = 2 * PERMUTATIONS // rows
    x = signature[:, : n * rows].reshape(len(signature), n, rows).astype(U)
    h = np.broadcast_to(np.arange(1, n + 1).astype(U), x.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * U(0xD1342543DE82EF95) + x[:, :, r])
    return h


def _profile(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts, 1 << 20):
                s, cut = shingle_sets(texts[a:b], width)
                n = np.diff(cut)
                digest = []
                for seed in (U(0x6A09E667F3BCC908), U(0xBB67AE8584CAA73B)):
                    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(s ^ seed))))
                    digest.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                h = bands(signatures(s, cut), rows).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), *map(pa.array, digest), listed], ["id", "n", "s1", "s2", "bands"])

    return run


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _links(s: np.ndarray, sizes: np.ndarray, band: np.ndarray, side: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one cluster's members. across: only from side 0 to side 1.

    s: the members' sets one after the other. Sizes ascend, so that members of a possible
    size are neighbours.
    """
    m = len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, number = np.unique(s, return_inverse=True)
    often = np.bincount(number)
    typical = np.add.reduceat(often[number], begins) / sizes
    comp = np.arange(m)
    mark = np.zeros(len(often), bool)
    forest = []
    for p in np.argsort(-typical, kind="stable").tolist():
        if across and side[p]:
            continue
        # size(other) * 100 >= percent * size(p), and the other way round
        lo = int(np.searchsorted(sizes, -(-sizes[p] * percent // 100)))
        hi = int(np.searchsorted(sizes, sizes[p] * 100 // percent, "right"))
        near = comp[lo:hi] != comp[p]
        if across:
            near &= side[lo:hi] == 1
        others = np.flatnonzero(near) + lo
        if not len(others):
            if not across and (comp == comp[p]).all():
                break
            continue
        others = others[(band[others] == band[p]).any(axis=1)]
        if not len(others):
            continue
        own = number[begins[p] : ends[p]]
        mark[own] = True
        n = sizes[others]
        at = np.repeat(begins[others] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        common = np.add.reduceat(mark[number[at]].astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
        mark[own] = False
        linked = others[100 * common >= percent * (n + sizes[p] - common)]
        for o in linked.tolist():
            if comp[o] != comp[p]:
                forest.append((p, o))
                comp[comp == comp[o]] = comp[p]
    return forest


def _confirm(width: int, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        groups: dict[tuple[int, int, int], list[int]] = {}
        for i, k in enumerate(zip(*(table.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True)):
            groups.setdefault(k, []).append(i)
        texts = table.column("text").combine_chunks().cast(pa.binary())
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        left: list[int] = []
        right: list[int] = []
        for (_, i, j), rows in groups.items():
            own = [texts[r].as_py() for r in rows]
            sets, sigs = [], []
            for a, b in chunks(own, 1 << 20):
                s, cut = shingle_sets(own[a:b], width)
                sets += np.split(s, cut[1:-1])
                sigs.append(bands(signatures(s, cut), band_rows(percent)))
            order = sorted((k for k in range(len(rows)) if len(sets[k])), key=lambda k: (len(sets[k]), ids[rows[k]]))
            if len(order) < 2:
                continue
            at = np.array(rows)[order]
            found = _links(np.concatenate([sets[k] for k in order]), np.array([len(sets[k]) for k in order]), np.concatenate(sigs)[order], (part[at] != i).astype(np.int8), i != j, percent)
            left += [int(ids[at[p]]) for p, _ in found]
            right += [int(ids[at[o]]) for _, o in found]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets.
    ``component_id`` is the smallest id that links lead to. Texts that are null or without
    words have empty sets and no links. Rows with equal ids are one document: a link of
    one holds for all. A row with a null id is linked with nothing; its component is null
    and it is kept.
    """
    bound_batches(docs.sparkSession)
    n = scaled_parts(docs)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = T.StructType().add("id", "long").add("n", "long").add("s1", "long").add("s2", "long").add("bands", T.ArrayType(T.LongType()))
    profile = materialize(rows.mapInArrow(tidy("minhash", _profile(width, band_rows(percent))), kind))
    some = profile.where("n > 0 AND id IS NOT NULL")

    # one class for equal sets; its smallest document stands for it
    classes = materialize(some.groupBy("n", "s1", "s2").agg(F.min("id").alias("class_id")))
    first = some.join(classes.withColumnRenamed("class_id", "id"), ["n", "s1", "s2", "id"], "left_semi")
    keyed = first.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select("band", "m")
    coarse = connected(keyed.join(shared, "band").where("id > m").select("id", "m"))

    # the clusters' texts meet once; a large cluster is dealt over pairs of its parts
    sizes = coarse.join(first.select(F.col("id").alias("node"), "n"), "node").groupBy("root").agg(F.count_distinct("node").alias("members"), F.sum("n").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("members") / PART_MEMBERS, F.col("shingles") / PART_SHINGLES)).cast("int")
    placed = coarse.join(sizes, "root").select(F.col("node").alias("id"), F.col("root").alias("cluster"), parts.alias("g"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    task = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(4 * n)).cast("int")
    # the clusters' members grow with the documents, so they are never broadcast to the texts
    dealt = rows.join(placed.hint("merge"), "id").select("id", "text", "cluster", "part", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))).alias("ij")).select("id", "text", "cluster", "part", "ij.i", "ij.j").withColumn("task", task)
    links = dealt.groupBy("task").applyInArrow(tidy_group("minhash", _confirm(width, percent)), "a long, b long")
    found = connected(links).withColumnRenamed("node", "class_id")

    labelled = classes.join(found, "class_id", "left").select("n", "s1", "s2", F.coalesce("root", "class_id").alias("own"))
    # rows of one id may have different texts: the smallest component of any holds for all
    known = profile.select("id", "n", "s1", "s2")
    out = known.join(labelled, ["n", "s1", "s2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("own", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component; of rows with equal ids all stay or none does."""
    found = near_duplicates(docs, id_col, text_col, width, percent).where("kept AND id IS NOT NULL").select("id").distinct()
    names = docs.columns
    key = F.col(f"__d.`{id_col}`").cast("long")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__d"))
    joined = d.join(found, key == F.col("id"), "left_semi").unionAll(d.where(F.col(f"__d.`{id_col}`").isNull()))
    return joined.select(*[F.col(f"__d.`{c}`").alias(c) for c in names])
