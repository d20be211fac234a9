"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


#: Nodes that are sent to every task if they are counted to be no more, so that edges needn't be shuffled to meet them.
BROADCAST_NODES = 400_000


def sent(nodes: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(nodes) if rows <= BROADCAST_NODES else nodes


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): each node takes its smallest neighbour's label, then the label of the label, until nothing changes. The edges between
    labels that are left are a smaller graph, of half the nodes at most, and its components join the labels: so all edges are read in the first round alone."""
    edges = cut(edges.select("src", "dst"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    state = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    while True:
        then = state.select(F.col("node").alias("c"), F.col("component").alias("next"))
        moved = cut(state.join(then, F.col("component") == F.col("c")).select("node", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("changed")))
        state = moved.drop("changed")
        if moved.where("changed").isEmpty():
            break
    n = state.count()
    ends = [sent(state.select(F.col("node").alias(end), F.col("component").alias(label)), n) for end, label in (("src", "a"), ("dst", "z"))]
    left = edges.join(ends[0], "src").join(ends[1], "dst").where("a <> z").select(F.least("a", "z").alias("src"), F.greatest("a", "z").alias("dst"))
    left = cut(left.distinct())
    if left.isEmpty():
        return state
    more = components(left).select(F.col("node").alias("c"), F.col("component").alias("least"))
    return cut(state.join(more, F.col("component") == F.col("c"), "left").select("node", F.coalesce("least", "component").alias("component")))
