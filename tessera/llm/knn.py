"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are grouped by their nearest pivot, the pivots being a bounded sample. A first
pass summarises every group: its size, and how far from the pivot its vectors lie. For a
query q and a group with pivot p and radius r, q.x lies within q.p -+ |q| r for every x in
the group. From the summaries alone each query group gets a score that k of the groups'
vectors are sure to reach, and the data groups whose bound stays below it are not
replicated to that query group. Each query group then meets the groups it needs in blocks
of bounded size, and keeps its best k in each block; the k best of those are the answer.

Scores are integers: components are floor(scale * x). Bounds are computed on the same
integers with a margin for rounding, so pruning never loses an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize

#: Pivots are half the root of the rows, and so many at most; with the summaries they are all that is broadcast.
PIVOTS = 1024
#: Vectors of a group that meet a query group in one task.
BLOCK_ROWS = 20_000
#: Queries of a group that are scored together.
QUERY_ROWS = 4_000
#: Components and scores are 64-bit integers; what doesn't fit is an error.
MOST = 1 << 63


def _integers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter vectors are filled with zeros."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        whole = np.floor(flat * scale)
        if not ((whole >= -MOST) & (whole < MOST)).all():
            raise OverflowError("a scaled component doesn't fit 64 bits")
        out[row, place] = whole.astype(np.int64)
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Products of all rows, and None if they are exact integers; else a bound on each row's errors.

    Floating point is used where it is exact, 64-bit integers where sums fit.
    """
    width = max(a.shape[1], 1)
    f, g = a.astype(np.float64), b.astype(np.float64)
    top = float(np.abs(f).max(initial=0)) * float(np.abs(g).max(initial=0)) * width
    if top < 2**52:
        return (f @ g.T).astype(np.int64), None
    if top < 2**62:
        return a @ b.T, None
    return f @ g.T, np.abs(f).sum(1) * np.abs(g).max(initial=0) * ((width + 4) * 2.0**-52)


def _settled(q: np.ndarray, x: np.ndarray, at: np.ndarray) -> list[int]:
    """Exact products of ``q`` with the rows ``at`` of ``x``, in Python's integers."""
    own = q.tolist()
    return [sum(map(int.__mul__, own, v)) for v in x[at].tolist()]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest pivot, and the distance to it."""
    f = x.astype(np.float64)
    d = (f**2).sum(1)[:, None] - 2 * f @ pivots.T + (pivots**2).sum(1)[None]
    g = d.argmin(1)
    return g, np.sqrt(((f - pivots[g]) ** 2).sum(1))


def _placer(shared, scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = _integers(part.column(1), scale, width)
                g, r = _nearest(x, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(g, pa.int32()), pa.array(r), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "query", "cell", "r", "v"])

    return run


def needed(pivots: np.ndarray, cells: dict[int, tuple[int, float]], queries: dict[int, float], k: int, own: int = 1) -> dict[int, list[int]]:
    """For each query cell the data cells that may hold one of its k best.

    cells: rows and radius of each data cell; queries: radius of each query cell. ``own``
    rows may have the query's id, so k + own must be sure.
    """
    out = {}
    names = sorted(cells)
    p = pivots[names]
    size = np.array([cells[c][0] for c in names])
    radius = np.array([cells[c][1] for c in names])
    norm = np.sqrt((p**2).sum(1))
    for c, u in queries.items():
        centre = pivots[c]
        length = np.sqrt((centre**2).sum()) + u
        # any q of the cell, any x of a data cell: |q.x - centre.p| <= |q| r + u |p|
        middle = p @ centre
        slack = length * radius + u * norm
        margin = 1 + 1e-9 * (np.abs(middle) + slack + length * norm)
        low, high = middle - slack - margin, middle + slack + margin
        order = np.argsort(-low)
        sure = np.searchsorted(np.cumsum(size[order]), k + own)
        floor = low[order[sure]] if sure < len(order) else -np.inf
        out[c] = [names[i] for i in np.flatnonzero(high >= floor)]
    return out


def together(plan: dict[int, list[int]], queries: dict[int, int]) -> list[tuple[list[int], set[int]]]:
    """Query cells in groups of at most QUERY_ROWS queries (or one cell), each with the data cells that it needs.

    A group begins with the cell that has most queries and takes those that add least to its data.
    """
    left = set(plan)
    out = []
    while left:
        first = max(left, key=lambda c: (queries[c], c))
        left.discard(first)
        cells, need, n = [first], set(plan[first]), queries[first]
        while left:
            best = min(left, key=lambda c: (len(set(plan[c]) - need), c))
            if n + queries[best] > QUERY_ROWS:
                break
            left.discard(best)
            cells.append(best)
            need |= set(plan[best])
            n += queries[best]
        out.append((cells, need))
    return out


def _local(k: int, width: int):
    def run(key: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not data.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})

        def matrix(t: pa.Table) -> np.ndarray:
            return np.frombuffer(b"".join(t.column(1).to_pylist()), np.int64).reshape(t.num_rows, width)

        q, x = matrix(queries), matrix(data)
        qid, xid = queries.column(0).to_numpy(), data.column(0).to_numpy()
        order = np.argsort(xid, kind="stable")
        x, xid = x[order], xid[order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), 512):
            s, error = _exact(q[at : at + 512], x)
            for i, row in enumerate(s):
                own = qid[at + i]
                take = min(len(row), k + int((xid == own).sum()))
                floor = np.partition(row, len(row) - take)[len(row) - take]
                best = np.flatnonzero(row >= (floor if error is None else floor - 2 * error[i]))
                best = best[xid[best] != own]
                if error is None:
                    best = best[np.lexsort((xid[best], -row[best]))][:k]
                    score = row[best]
                else:
                    exact = sorted((-p, j) for p, j in zip(_settled(q[at + i], x, best), best.tolist(), strict=True))[:k]  # data are in order of ids
                    if any(not -MOST <= -p < MOST for p, _ in exact):
                        raise OverflowError(f"a score of query {own} doesn't fit 64 bits")
                    best = np.array([j for _, j in exact], np.int64)
                    score = np.array([-p for p, _ in exact], np.int64)
                out.append((np.full(len(best), own), xid[best], score))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i, n in enumerate(names)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): each query's k best rows of ``vectors`` but its own.

    Queries are the rows for which the column ``is_query`` holds. Vectors that are null or
    hold a null, infinite or NaN component take no part, nor do rows with a null id. A
    shorter vector counts as filled with zeros; an empty one scores 0 with all. Rows with
    one id are one query, and never candidates of it; repeated rows are ranked one by one. Components
    or answers' scores beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("e")), F.lit(0))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    width = max(width, 1)
    # pivots: a bounded sample by hash, alike at every size
    want = max(1, min(PIVOTS, int(n**0.5) // 2))
    sample = rows.select("e", F.xxhash64("id", F.lit(5)).alias("h")).orderBy("h").limit(want).select("e").toArrow().column(0).combine_chunks()
    pivots = np.unique(_integers(sample, scale, width), axis=0).astype(np.float64)
    kind = T.StructType().add("id", "long").add("query", "boolean").add("cell", "integer").add("r", "double").add("v", "binary")
    placed = materialize(rows.mapInArrow(_placer(spark.sparkContext.broadcast(pivots), scale, width), kind))

    # at most one row for each pivot
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max(F.when(F.col("query"), F.col("r"))).alias("u"), F.count(F.when(F.col("query"), 1)).alias("q")).collect()
    # candidates are rows, and a query's own are all rows of its id
    own = placed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("query").alias("q")).where("q").agg(F.max("n")).first()[0]
    plan = needed(pivots, {s.cell: (s.n, s.r) for s in summary}, {s.cell: s.u for s in summary if s.q}, k, own or 1)
    chunk = {s.cell: max(1, -(-s.n // BLOCK_ROWS)) for s in summary}
    groups = {s.cell: max(1, -(-s.q // QUERY_ROWS)) for s in summary if s.q}
    # which (query cell, part) meets which (data cell, part): sent to data and queries as small tables by cell
    if not plan:
        return spark.createDataFrame([], out)
    # query cells that need much the same data go together, so that data is replicated to few groups
    to_data, to_query, block = [], [], 0
    size = {s.cell: s.n for s in summary}
    for cells, cs in together(plan, {s.cell: s.q for s in summary}):
        here: list[int] = []
        blocks: list[tuple[int, int]] = []  # first block and number of blocks
        for c in [*sorted(cs), None]:
            if here and (c is None or chunk[c] > 1 or sum(size[h] for h in here) + size[c] > BLOCK_ROWS):
                to_data += [(h, 1, block) for h in here]
                blocks.append((block, 1))
                block += 1
                here = []
            if c is not None and chunk[c] > 1:
                to_data.append((c, chunk[c], block))
                blocks.append((block, chunk[c]))
                block += chunk[c]
            elif c is not None:
                here.append(c)
        parts = max(groups[c] for c in cells)
        to_query += [(c, b + i, parts) for c in cells for b, m in blocks for i in range(m)]
    data_to = F.broadcast(spark.createDataFrame(to_data, "cell int, parts int, block long"))
    query_to = F.broadcast(spark.createDataFrame(to_query, "cell int, block long, groups int"))
    data = placed.join(data_to, "cell").select("id", "v", (F.col("block") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    every = query_to.select("block", "groups").distinct().select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    asked = placed.where("query").join(query_to, "cell").select(F.col("id").alias("qid"), F.col("v").alias("qv"), "block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")).cast("int").alias("part"))
    met = asked.groupBy("block", "part").cogroup(data.join(F.broadcast(every), "block").select(F.col("id").alias("did"), F.col("v").alias("dv"), F.col("block").alias("dblock"), F.col("part").alias("dpart")).groupBy("dblock", "dpart")).applyInArrow(_local(k, width), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a query row and a data row meet once, so repeats of a row come out as often as they are there
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
