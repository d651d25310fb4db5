"""Retrieval over text and vectors: BM25, cosine, fusion, overlap; and graphs of related items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.store import written


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents with a query term.

    Texts are read once: lengths and counts of the query's terms, a few numbers a document, are written to the shared
    folder, and both the totals and the scores come from there.
    """
    terms = sorted({t for t in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in query.lower()).split()})
    own = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("x"))
    word = lambda t: F.regexp_count("x", F.lit(rf"(?<![a-z0-9_]){t}(?![a-z0-9_])"))
    counted = written(own.select("id", F.regexp_count("x", F.lit("[a-z0-9_]+")).alias("len"), *[word(t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return counted.join(F.broadcast(total)).select("id", score.alias("score")).where("score > 0")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the k vectors of highest cosine with one query; ties to the smaller id. Every task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    n = float(sum(x * x for x in query)) ** 0.5
    score = F.try_divide(dot(F.col(vector_col), q), norm(F.col(vector_col)) * n)
    return vectors.select(F.col(id_col).alias("id"), score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


#: Vectors of a block of pairs, and rows of one that are multiplied at once; fewer blocks than LEAST_BLOCKS leave cores idle.
PAIR_VECTORS, PAIR_ROWS, LEAST_BLOCKS = 1 << 14, 1 << 10, 8


def semantic_duplicates(vectors: DataFrame, least: float = 0.92, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, score): pairs of vectors with a cosine of ``least`` or more.

    Blocks of vectors meet in pairs, as products of matrices: work is that of all pairs, as nothing bounds how many are
    close; a task holds two blocks and a strip of their products. Vectors of unlike lengths, or with a missing part, are in no pair.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    n = v.count()
    blocks = max(1, min(LEAST_BLOCKS, n), -(-n // PAIR_VECTORS))
    v = v.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = v.select("id", "v", "i", F.explode(F.sequence("i", F.lit(blocks - 1))).alias("j"))
    right = v.select(F.col("id").alias("b"), F.col("v").alias("w"), F.col("i").alias("k"), F.explode(F.sequence(F.lit(0), "i")).alias("h"))
    kind = v.schema["id"].dataType
    types = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind)), ("score", pa.float64())])

    def close(key: tuple, one: pa.Table, two: pa.Table) -> Iterator[pa.RecordBatch]:
        if not one.num_rows or not two.num_rows:
            return
        same = key[0].as_py() == key[1].as_py()
        (p, x, m), (q, y, n) = _unit(one), _unit(two)
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        for at in range(0, len(x), PAIR_ROWS):
            score = x[at : at + PAIR_ROWS] @ y.T
            r, c = np.nonzero(~(score < least) & (m[at : at + PAIR_ROWS, None] == n))
            a, b = p.take(pa.array(r + at)), q.take(pa.array(c))
            keep = pc.less(a, b) if same else pc.not_equal(a, b)
            score = pa.array(score[r, c]).filter(keep)
            a, b = a.filter(keep), b.filter(keep)
            first = pc.less(a, b)
            yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), score], schema=types)

    def whole(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(close(key, one, two)), types)

    return left.groupBy("i", "j").cogroup(right.groupBy("h", "k")).applyInArrow(whole, f"a {kind.simpleString()}, b {kind.simpleString()}, score double")


def _unit(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, unit vectors as rows and their lengths; vectors without a direction are left out."""
    ids, v = t.column(0).combine_chunks(), t.column(1).combine_chunks()
    n, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
    m = np.zeros((len(n), int(n.max(initial=0))))
    m[np.arange(m.shape[1]) < n[:, None]] = flat
    size = np.sqrt((m * m).sum(1))
    ok = size != 0
    return ids.filter(pa.array(ok)), m[ok] / size[ok, None], n[ok]


def ranked(ranking: DataFrame, parts: int = 64) -> DataFrame:
    """(id, score, place) of a whole (id, score) table, best first and ties by id, without a single-task sort.

    Scores are cut into ranges, ranked within each, and each range begins after the rows of those above it.
    """
    cuts = ranking.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 10_000).alias("c"))
    part = ranking.join(F.broadcast(cuts)).select("id", "score", F.size(F.filter(F.coalesce("c", F.array().cast("array<double>")), lambda c: c > F.col("score"))).alias("part"))
    part = written(part)
    before = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "id"))
    return part.withColumn("own", place).join(F.broadcast(before), "part").select("id", "score", (F.col("own") + F.col("before")).alias("place"))


def fuse(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion of (id, score) tables, ties within one by id."""
    out = None
    for r in rankings:
        own = ranked(r).select("id", (1.0 / (k + F.col("place"))).alias("s"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("id").agg(F.sum("s").alias("score"))


def rerank(hits: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """``hits`` (id, text, bm25) scored .45 Jaccard + .40 relative BM25 + .15 shared share of the query's tokens, best first.

    Of a text three numbers are written to the shared folder; the greatest score and the sort come from there.
    """
    q = F.array_distinct(tokens(F.lit(query)))
    counted = hits.withColumn("t", F.array_distinct(tokens(F.col(text_col))))
    counted = written(counted.select("id", "bm25", F.size(F.array_intersect(q, "t")).alias("shared"), F.size(F.array_union(q, "t")).alias("all"), F.size(q).alias("asked")))
    top = counted.agg(F.max("bm25").alias("top"))
    shared = F.col("shared")
    score = 0.45 * F.coalesce(F.try_divide(shared, F.col("all")), F.lit(0.0)) + 0.40 * F.coalesce(F.try_divide(F.col("bm25"), F.col("top")), F.lit(0.0)) + 0.15 * F.coalesce(F.try_divide(shared, F.col("asked")), F.lit(0.0))
    return counted.join(F.broadcast(top)).select("id", score.alias("score")).orderBy(F.desc("score"), "id")


def pattern_score(success: Column, tried: Column, saturated: Column) -> Column:
    """Success rate raised by experience, (1 + ln(1 + n)), and lowered by saturation (.2 of it, or .6 if complete)."""
    return success * (1 + F.log1p(tried)) * F.when(saturated >= 1, 0.4).when(saturated > 0, 1 - 0.2 * saturated).otherwise(1.0)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): components of an edge table (a, b) by the smallest label, with pointer jumping, until no label changes.

    Rounds are written to the shared folder. Labels only fall, so rounds end.
    """
    # the ends of an edge meet before repeats go: a hash table of nearly all edges would be no smaller than they are
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.repartition("a").distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    before = None
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("m"))
        label = label.join(near, label.node == near.a, "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = label.select(F.col("node").alias("j"), F.col("root").alias("r"))
        label = written(label.join(jump, label.root == jump.j, "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root")))
        now = label.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return label
        before = now


def neighbours(edges: DataFrame, start, hops: int = 2) -> DataFrame:
    """(node, hop): nodes that are reached from ``start`` in at most ``hops`` steps.

    Each step takes the edges that touch the nodes found last; the edge table itself is neither doubled nor made distinct.
    """
    # a written table has a size, so that few nodes are sent to the edges, which stay where they are
    seen = written(edges.sparkSession.createDataFrame([(start, 0)], f"node {edges.schema['a'].dataType.simpleString()}, hop int"))
    for h in range(1, hops + 1):
        last = seen.where(F.col("hop") == h - 1).select("node")
        reached = [edges.join(last, F.col(x) == F.col("node")).select(F.col(y).alias("node")) for x, y in (("a", "b"), ("b", "a"))]
        found = reached[0].unionAll(reached[1]).distinct().withColumn("hop", F.lit(h))
        seen = written(seen.unionByName(found).groupBy("node").agg(F.min("hop").alias("hop")))
    return seen


def co_occurrence(items: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): pairs of distinct items of one group, counted over groups; groups are small sets (operators of a formula)."""
    own = items.select(group, F.col(item).alias("a")).distinct()
    return own.join(own.withColumnRenamed("a", "b"), group).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
