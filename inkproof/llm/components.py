"""Connected components by alternating large and small stars, one shuffled round at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of undirected ``edges`` (columns a, b of one orderable type).

    Returns ``node, component`` for each node of an edge that isn't a self-loop; the component is
    its smallest node. Edges with a null end are ignored; repeated edges count once; no edges
    give no rows. No neighbour list is ever collected: a round is a minimum per node (combined
    before the shuffle) joined back to the edges. Each round is written to the shared folder.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(a, b).distinct())
    mark = _mark(now)
    while mark[0]:
        # Large star: every larger neighbour of u is linked to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours are linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(moved.unionByName(least.withColumnRenamed("m", "b")).distinct())
        discard(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
