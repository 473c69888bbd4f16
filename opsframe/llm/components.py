"""Connected components of a table of links, without gathering a component or its links anywhere.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond") by joins: each round
is one table in the shared folder, so lineage stays short and nothing is lost with an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Each node's larger (or not larger) neighbours move to its smallest neighbour."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = pairs.join(least, "u")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (u, v) but the roots: the smallest node that links reach."""
    both = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, seen = settle(both.distinct(), "links"), None
    while True:
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(row)
        edges = settle(_star(_star(edges, large=True), large=False), "links")
