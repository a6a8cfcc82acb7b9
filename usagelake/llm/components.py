"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, merged, stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the component's smallest node.

    Alternates two rewrites until nothing changes: every edge's larger end is tied to the smallest
    neighbour of its smaller end, then the smaller neighbours of a node are tied to the smallest of
    them. Each round is a few aggregations and joins over as many edges as before at most, and the
    edges of a node that has very many are dealt over tasks. Its result is written to the shared
    folder, and only a count and a checksum reach the driver. The number of rounds grows with the
    logarithm of a component's width.
    """
    edge = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stage(edges.where("u <> v").select(*edge).distinct())
    mark = _mark(now)
    while mark[0]:
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        tied = lookup(now, least, "v", "u").select("u", F.least("v", "m").alias("v")).distinct()
        lowest = tied.groupBy("u").agg(F.min("v").alias("m"))
        both = tied.join(merged(lowest), "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*").where("u <> v").distinct()
        now = stage(both)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select("v", F.col("v").alias("root")).distinct().toDF("node", "root"))
