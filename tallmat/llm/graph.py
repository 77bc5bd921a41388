"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least of the node and its neighbours; a > b in all edges, also after."""
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = edges.select(turned).select("e.a", "e.b")
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the least of them; a > b in all edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    ends = F.explode(F.array("a", "b")).alias("a")
    return edges.join(least, "a").select(ends, F.col("low").alias("b")).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that has an edge (a, b); root is the smallest id of the component.

    Alternates large-star and small-star steps until the edges are stars. Each step is an aggregation and a join;
    no component is ever gathered.
    """
    current = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        current = cut_lineage(_small_star(_large_star(current)))
    leaves = current.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return leaves.unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
