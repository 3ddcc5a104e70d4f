"""Connected components of an edge table, in a few rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import dropped, written

MOST_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long, not null) to a written table (node, component): the smallest node that can be reached.

    Alternates the large-star and small-star steps of the public map-reduce algorithm until every node has one smaller
    neighbour, a root. Minima come from aggregations with map-side combine and are written to the shared folder, so that
    the join with the edges has a plain exchange on both sides and a node of very many edges is split by adaptive skew
    handling. What a step has read is deleted when its result is written.
    """
    up = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    up = written(up.distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if done(up):
            break
        both = up.unionByName(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "edges")
        dropped(up, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        dropped(large, least)
    else:
        raise RuntimeError("components did not settle")
    nodes = up.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = up.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(nodes.unionByName(roots), "components")
    dropped(up)
    return out


def done(up: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, and none of those has one."""
    twice = up.groupBy("u").count().filter("count > 1").limit(1).count()
    return not twice and not up.join(up.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
