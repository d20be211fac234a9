"""Distributed union-find: connected components of a table of links, by alternating stars, on DataFrame operations alone.

Each round joins links with the smallest neighbour of each node, which is an aggregate with partial sums, so a node with
very many links isn't gathered anywhere. What a round leaves is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: Links that a task takes on, about, where there are few of them.
EACH = 200_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more parts than its rows ask for: a round of a few links is else hundreds of empty tasks, whose files take more disk than the links."""
    return df.coalesce(max(1, -(-rows // EACH)))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, rows: int) -> bool:
    """Whether each node has one link up, to a node without any."""
    up = _few(edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")), rows)
    tops = _few(edges.select(F.col("v").alias("top")).distinct(), rows)
    found = up.join(tops, F.col("u") == F.col("top"), "left").agg(F.max("c"), F.count("top")).first()
    return tuple(found) == (1, 0)


def labels(links: DataFrame, steps: int = 2, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: for each node of a link, a node that it is connected with, some steps towards the smallest. Equal roots mean one component; unequal ones may."""
    both = links.select(F.col(u).alias("u"), F.col(v).alias("v")).unionByName(links.select(F.col(v).alias("u"), F.col(u).alias("v")))
    found = both.select(F.col("u").alias("node"), F.least("u", "v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
    for step in range(steps):
        if step:
            near = both.join(found, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
            found = found.join(near, F.col("node") == F.col("u")).select("node", F.least("root", "near").alias("root"))
        then = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = shared.keep(found.join(then, "root").select("node", F.col("next").alias("root")), "labels")
    return found


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: for each node of a link, the smallest node it is connected with. Self-links and repeated links change nothing; null ends are dropped."""
    a, b = F.col(u), F.col(v)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a.isNotNull().alias("x"), b.isNotNull().alias("y")).where("x AND y AND u <> v").select("u", "v").distinct()
    edges = shared.keep(edges, "links")
    before = _state(edges)
    while before[0]:
        # Each node's larger neighbours move to its smallest one; then its smaller neighbours do.
        n = before[0]
        both = _few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        least = _few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        edges = _few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), n)
        least = _few(edges.groupBy("u").agg(F.min("v").alias("m")), n)
        moved = _few(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), n)
        edges = shared.keep(_few(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n), "links")
        after = _state(edges)
        if after == before or not after[0] or _stars(edges, after[0]):
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
