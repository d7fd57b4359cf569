"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round keeps at most as many edges as the one before, needs O(log n) rounds in practice, and writes its edges to
the shared folder in place of the round before, so lineage stays short and a lost executor costs one round at most. Only a count and a
checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges (src, dst) of any orderable type. Returns node, component for every node but the components' own.

    `component` is the smallest node reachable; a node that is not returned is its own component. Edges with a null
    end and self-loops are left out; repeated edges count once.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = edges.where(edges[src].isNotNull() & edges[dst].isNotNull() & (edges[src] != edges[dst]))
    tables, k = Tables(edges.sparkSession), 0
    e = tables.put("0", e.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct())
    seen, now = None, state(e)
    while now != seen and now[0]:
        seen = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = tables.put(str(k + 1), small.union(root.select("a", F.col("m").alias("b"))).distinct())
        tables.drop(str(k))
        k, now = k + 1, state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
