"""Connected components of an edge table, by alternating large-star and
small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond"). Every step is a join and an aggregate of the written edges, a node
with very many neighbours stays balanced, and the number of steps grows with the
logarithm of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, written


def _star(edges: DataFrame, folder: str, name: str, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v. Large: each node links its larger
    neighbours to the smallest of itself and its neighbours. Small: each node
    links its smaller neighbours, and itself, to the smallest of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = written(both, folder, f"{name}_near") if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w"))
    least = written(least, folder, f"{name}_least")
    joined = attach(near, least, "u", "w", near.count())
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return written(out.where("u <> v").distinct(), folder, name)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, of every node of
    the edges (a, b)."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), folder, "edges")
    state, step = None, 0
    while True:  # ends: every step that changes an edge brings its larger end nearer to the smallest
        edges = _star(edges, folder, f"large_{step}", True)
        edges = _star(edges, folder, f"small_{step}", False)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state, step = now, step + 1
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
