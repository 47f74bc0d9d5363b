"""Connected components of an edge table, by alternating stars.

Large-star links every larger neighbour of a node to the least of its
neighbourhood, small-star the smaller ones; when neither changes an edge, each
component is a star around its least node (Kiveris et al., "Connected components
in MapReduce and beyond", 2014). All state stays in tables: each step is
written to the shared folder, so that its lineage ends and lost executors cost
one step at most. A step is an aggregate with a map-side part and a join of
edges with one row for each node; the rows of hubs, of which there are few, go
to the edges instead, so a hub's edges stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Scratch, written


def _with_least(rows: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """``rows (u, v)``, ``total`` at most, with ``m``: the least ``v`` of the ``u``."""
    least = scratch.written(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hubs = least.where(F.col("n") * HOT > total).select("u", "m").collect()
    if not hubs:
        return rows.join(least.select("u", "m"), "u")
    # At most HOT rows can have more than 1 / HOT of all: a proven bound.
    hub = F.broadcast(rows.sparkSession.createDataFrame(hubs, least.select("u", "m").schema))
    return rows.join(hub, "u").unionByName(rows.join(hub.select("u"), "u", "left_anti").join(least.select("u", "m"), "u"))


def _large_star(edges: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_least(both, 2 * total, scratch).where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Every edge has v < u here."""
    joined = _with_least(edges, total, scratch)
    return joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """``node, component`` for each node of ``edges (u, v)``: the least node that it reaches.

    Edges with a null end and loops link nothing; a node that is in no edge is
    not returned. Repeated edges count once. An empty table gives an empty one.
    The table that the result reads goes with ``scratch``, else it stays.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, path = written(e, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            if scratch:
                scratch.paths.append(path)
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = mark
        steps = Scratch(spark)
        large = steps.written(_large_star(e, mark[0], steps), "large")
        e, new = written(_small_star(large, mark[0], steps), "edges")
        steps.paths.append(path)
        steps.clear()
        path = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
