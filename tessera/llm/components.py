"""Connected components of an edge table, by alternating star contractions.

Every round turns each node's neighbourhood into a star around its smallest member, first
towards larger neighbours, then towards smaller ones, until a round changes nothing.
Rounds are written to the shared folder, so that a lost executor costs one round at most.
Nothing is collected but a count and a checksum a round.

A hub's edges stay where they are: nodes with many neighbours are few, as edges bound
their number, so their minima are sent to the edges; other edges are joined by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Hubs have so many neighbours at least, and are HUBS at most.
HUB, HUBS = 200, 500_000


def _checksum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """(a, b, m): edges with the least of ``a``'s neighbours; ``n`` edges at most."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    many = max(HUB, n // HUBS)
    hubs = least.where(F.col("n") >= many).select(F.col("a").alias("h"), F.col("m").alias("hm"))
    asked = edges.join(F.broadcast(hubs), F.col("a") == F.col("h"), "left")
    others = asked.where("h IS NULL").select("a", "b").join(least.where(F.col("n") < many).select("a", "m"), "a")
    return asked.where("h IS NOT NULL").select("a", "b", F.col("hm").alias("m")).unionAll(others.select("a", "b", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    each = _with_least(down, n)
    moved = each.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(each.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node that has an edge to another; ``root`` is its component's smallest node.

    ``edges`` has two columns of longs, in any direction, with repeats; edges with a null end
    and loops are left out. Each round but the last lowers the end of an edge, so rounds end.
    """
    x, y = edges.columns
    now = edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now = materialize(now)
    before, after = None, _checksum(now)
    while after[0] and after != before:
        before = after
        # a star's edges are no more than those of the graph it is made of
        now = materialize(_small_star(materialize(_large_star(now, before[0])), before[0]))
        after = _checksum(now)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
