"""Connected components of a graph held as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import cut


def _size(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node that has an edge.

    Alternates two steps until nothing changes: every node tells its larger neighbours its smallest
    one, then its smaller neighbours. Paths halve with each round. The smallest neighbour comes from
    an aggregate that combines before the shuffle and returns by a join that Spark may split, so a
    node with very many edges fills no single task. Loops and edges with a null end count for nothing.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    known = _size(now)
    while known[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, known = known, _size(now)
        if before == known:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
