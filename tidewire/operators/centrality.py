"""Betweenness of graphs of any size: breadth-first searches from batches of sources, as joins, a level at a time.

A row of a search is (source, node, shortest paths). A level is the one before joined with the edges and summed by source and node,
without what the last two levels hold: in an undirected graph a level's neighbours lie in no other. Back from the last level,
a node passes (1 + its own share) / paths on to the level before, where it is summed and multiplied by the paths there.

Nodes are numbers. The edges of a node of very many are dealt over parts by their other end, and its rows of a search are
repeated for each part, so no task holds all of a hub. A batch has so many sources that its rows stay near ROWS.

Shortest paths stay within a component. One whose edges are counted to be few is dealt to tasks instead, by a shuffle: each task has the component's
edges and searches from a share of its nodes. Both ways have equal results.

Nodes of the same neighbours, each other left out, carry the same of all others, so a task searches from one of them. A component of few nodes and
many edges is a matrix there, and searches from many sources are products of matrices.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .connected import components, sent

#: Edges of a component that a task holds.
SMALL = 3_000_000
#: Nodes times edges, both ways, that are searched as one graph, and those of one task at least.
ALONE, WORK = 1_000_000_000, 100_000_000
#: A level is summed over all edges at once if it has more than this share of them; else its edges are looked up.
PULL = 1 / 8
#: Nodes of a component that a task holds as a matrix, if it has this share of all edges, and the sources of a product.
DENSE, SHARE, SOURCES = 3_000, 1 / 20, 256
#: How much less a product costs than the same searches alone, at least.
CHEAPER = 10
#: Rows of a batch's searches, and edges of a node in one part.
ROWS, PART = 20_000_000, 20_000
#: A level that a task would expand to more rows than this, on average, is dealt anew: levels are small beside what they lead to.
EXPANDED = 1_000_000
#: Edges, and rows of a level, that are sent to every task if they are counted to be no more.
BROADCAST_EDGES, BROADCAST_ROWS = 1_000_000, 100_000


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (node, id, parts), both directions of edges (src, part, dst, parts: of dst), and their number."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    parts = F.ceil(F.count(F.lit(1)) / PART).cast("int")
    nodes = cut(ends.groupBy("node").agg(parts.alias("parts")).withColumn("id", F.monotonically_increasing_id()))
    a = nodes.select(F.col("node").alias("src"), F.col("id").alias("a"), F.col("parts").alias("a_parts"))
    z = nodes.select(F.col("node").alias("dst"), F.col("id").alias("z"), F.col("parts").alias("z_parts"))
    n = nodes.count()
    one = edges.select("src", "dst").join(sent(a, n), "src").join(sent(z, n), "dst")
    both = one.select("a", "a_parts", "z", "z_parts").union(one.select("z", "z_parts", "a", "a_parts")).toDF("src", "src_parts", "dst", "parts")
    part = F.pmod(F.xxhash64("dst"), F.col("src_parts")).cast("int")
    if nodes.where("parts > 1").isEmpty():
        both = both.select("src", "dst")  # no hub: nothing is spread
    else:
        both = both.select("src", part.alias("part"), "dst", "parts")
    both = cut(both)
    return nodes, both, both.count()


def _along(rows: DataFrame, n: float, both: DataFrame, value: str) -> DataFrame:
    """rows (s, v, parts, value) moved to all neighbours, about n, and summed there: s, v, parts, value."""
    if n > EXPANDED:
        rows = rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n // EXPANDED // 10)), "s", "v")
    if "part" not in both.columns:
        sums = rows.select("s", F.col("v").alias("src"), value).join(both, "src").groupBy("s", F.col("dst").alias("v")).agg(F.sum(value).alias(value))
        return sums.withColumn("parts", F.lit(1))
    spread = rows.select("s", F.col("v").alias("src"), value, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return spread.join(both, ["src", "part"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum(value).alias(value), F.first("parts").alias("parts"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _batch(sources: DataFrame, both: DataFrame, per_source: int, degree: float) -> DataFrame:
    """v, x: what the nodes, of such a mean degree, carry of the shortest paths from the sources (v, parts)."""
    levels = [cut(sources.select(F.col("v").alias("s"), "v", "parts", F.lit(1.0).alias("paths")))]
    sizes = [levels[0].count()]
    while sum(sizes) < sizes[0] * per_source:  # else every node is found: no further level
        reached = _along(levels[-1], sizes[-1] * degree, both, "paths")
        for before, n in zip(levels[-2:], sizes[-2:]):
            reached = reached.join(_small(before.select("s", "v"), n), ["s", "v"], "left_anti")
        level = cut(reached)
        if not (n := level.count()):
            break
        levels.append(level)
        sizes.append(n)
    carried, done = [], None
    for k in range(len(levels) - 1, 0, -1):
        level = levels[k]
        if done is not None:
            # Neighbours of a level lie in it or in the ones beside it.
            given = _along(done, sizes[k + 1] * degree, both, "share").select("s", "v", F.col("share").alias("given"))
            level = level.join(_small(given, sum(sizes[k : k + 3])), ["s", "v"], "left")
        else:
            level = level.withColumn("given", F.lit(0.0))
        own = F.col("paths") * F.coalesce("given", F.lit(0.0))
        done = cut(level.select("s", "v", "parts", own.alias("x"), ((1 + own) / F.col("paths")).alias("share")))
        carried.append(done.groupBy("v").agg(F.sum("x").alias("x")))
    none = levels[0].select("v", F.lit(0.0).alias("x")).limit(0)
    return cut(reduce(DataFrame.unionByName, carried, none).groupBy("v").agg(F.sum("x").alias("x")))


def _expanded(first: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the edges of some nodes."""
    size = first[nodes + 1] - first[nodes]
    return np.repeat(nodes, size), to[np.arange(size.sum()) + np.repeat(first[nodes] - np.cumsum(size) + size, size)]


def _dependencies(first: np.ndarray, to: np.ndarray, source: int) -> np.ndarray:
    """What each node carries of the shortest paths from one source, a level at a time. Node v's neighbours are to[first[v]:first[v + 1]]; each has some."""
    n = len(first) - 1
    far, paths, carried = np.full(n, -1), np.zeros(n), np.zeros(n)
    far[source], paths[source] = 0, 1.0
    levels, left, many = [np.array([source])], n - 1, PULL * len(to)
    edges = lambda nodes: (first[nodes + 1] - first[nodes]).sum()
    summed = lambda x: np.add.reduceat(x[to], first[:-1])
    while left and len(levels[-1]):
        level = levels[-1]
        if edges(level) > many:
            x = np.zeros(n)
            x[level] = paths[level]
            sums = summed(x)
            reached = np.flatnonzero((sums > 0) & (far < 0))
            paths[reached] = sums[reached]
        else:
            u, w = _expanded(first, to, level)
            new = far[w] < 0
            w = w[new]
            paths += np.bincount(w, paths[u[new]], n)
            reached = np.unique(w)
        far[reached] = len(levels)
        levels.append(reached)
        left -= len(reached)
    for k in range(len(levels) - 1, 1, -1):
        level, near = levels[k], levels[k - 1]
        share = np.zeros(n)
        share[level] = (1 + carried[level]) / paths[level]
        fewer = min(level, near, key=edges)
        if edges(fewer) > many:
            given = summed(share)
        else:
            u, w = _expanded(first, to, fewer)
            given = np.bincount(u, share[w], n) if fewer is near else np.bincount(w, share[u], n)
        carried[near] = paths[near] * given[near]
    return carried


def _products(first: np.ndarray, to: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """_dependencies() from some sources, a column each, by products with the matrix of the edges."""
    n, each = len(first) - 1, np.arange(len(sources))
    linked = np.zeros((n, n))
    linked[np.repeat(np.arange(n), np.diff(first)), to] = 1.0
    far, paths, carried = np.full((n, len(sources)), -1), np.zeros((n, len(sources))), np.zeros((n, len(sources)))
    far[sources, each], paths[sources, each] = 0, 1.0
    level, last = paths, 0
    while (far < 0).any():
        sums = linked @ level
        reached = (sums > 0) & (far < 0)
        if not reached.any():
            break
        last += 1
        far[reached] = last
        level = np.where(reached, sums, 0.0)
        paths = paths + level
    for k in range(last, 1, -1):
        share = np.divide(1 + carried, paths, out=np.zeros_like(paths), where=far == k)
        carried = np.where(far == k - 1, paths * (linked @ share), carried)
    return carried


def _twins(first: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """All nodes, those together that have the same neighbours, with each other or without, by 128 bits of hashes."""
    n = len(first) - 1
    own = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, (n, 2), np.uint64)
    near = np.stack([np.add.reduceat(own[to, k], first[:-1]) for k in (0, 1)], 1)
    _, apart, many = np.unique(near, axis=0, return_inverse=True, return_counts=True)
    apart = apart.ravel()
    _, linked = np.unique(near + own, axis=0, return_inverse=True)
    # No node has twins of both kinds.
    kind = np.where(many[apart] > 1, apart, n + linked.ravel())
    order = np.argsort(kind, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(kind[order])) + 1)


def _carried(first: np.ndarray, to: np.ndarray, slice_: int, slices: int) -> np.ndarray:
    """What each node carries of the shortest paths from a slice of all sources."""
    n = len(first) - 1
    sums, groups = np.zeros(n), _twins(first, to)[slice_::slices]
    dense = n <= DENSE and len(to) >= SHARE * n * n
    for i in range(0, len(groups), SOURCES if dense else 1):
        some = groups[i : i + SOURCES] if dense else groups[i : i + 1]
        one = np.array([g[0] for g in some])
        x = _products(first, to, one) if dense else _dependencies(first, to, int(one[0]))[:, None]
        if len(some) < sum(map(len, some)):
            of_twin = [x[g[1], j] if len(g) > 1 else 0.0 for j, g in enumerate(some)]
            x = x * [len(g) for g in some]
            for j, g in enumerate(some):
                x[g, j] = (len(g) - 1) * of_twin[j]  # of the paths from its twins
        sums += x.sum(1)
    return sums


def _in_tasks(both: DataFrame, deal: DataFrame, tasks: int) -> DataFrame:
    """v, x: of components (component, slices) whose edges (component, src, dst) a task can hold. Its sources are dealt over so many slices."""

    def run(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        src, dst = edges["src"].to_numpy(), edges["dst"].to_numpy()
        ids, src = np.unique(src, return_inverse=True)  # all its nodes: each edge is there both ways
        order = np.argsort(src, kind="stable")
        first, to = np.concatenate([[0], np.cumsum(np.bincount(src))]), np.searchsorted(ids, dst[order])
        sums = _carried(first, to, key[1], int(edges["slices"].iloc[0]))
        some = np.flatnonzero(sums)
        return pd.DataFrame({"v": ids[some], "x": sums[some]})

    dealt = both.join(deal, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "slices", "src", "dst")
    return dealt.repartition(tasks, "component", "slice").groupBy("component", "slice").applyInPandas(run, "v long, x double")


def _by_components(nodes: DataFrame, both: DataFrame, n: int, directed: int, rows: int, small: int) -> DataFrame:
    """v, x: small components in tasks, all others by joins."""
    if n * directed <= ALONE and directed <= 2 * small:
        placed = nodes.select("id", "parts", F.lit(0).cast("long").alias("component"))
    else:
        placed = cut(nodes.select("id", "parts").join(components(both.where("src < dst")).select(F.col("node").alias("id"), "component"), "id"))
    both = both.join(sent(placed.select(F.col("id").alias("src"), "component"), n), "src")
    sizes = both.groupBy("component").agg(F.count(F.lit(1)).alias("m")).join(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    sizes = cut(sizes.where("m > 0"))
    few = F.col("m") <= 2 * small
    dense = (F.col("n") <= DENSE) & (F.col("m") >= SHARE * F.col("n") * F.col("n"))
    cost = F.col("m").cast("double") * F.col("n") / F.when(dense, CHEAPER).otherwise(1)
    work, parts, m, k = sizes.agg(F.sum(F.when(few, cost)), F.count_if(few), F.sum(F.when(~few, F.col("m"))), F.sum(F.when(~few, F.col("n")))).first()
    found = []
    if parts:
        # A slice costs a copy of its component's edges, so there are no more than keep all cores busy.
        cores = 3 * both.sparkSession.sparkContext.defaultParallelism
        slices = F.least(F.col("n"), F.ceil(cost / F.lit(max(float(WORK), work / cores)))).cast("int")
        deal = sent(sizes.where(few).select("component", slices.alias("slices")), parts)
        found.append(_in_tasks(both, deal, min(parts, 1000) + cores))
    if m:
        big = sizes.where(~few).select("component")
        held = cut(both.join(big, "component", "left_semi").drop("component"))
        found.append(_by_joins(placed.join(big, "component", "left_semi"), held, k, m, rows))
    return reduce(DataFrame.unionByName, found)


def _by_joins(nodes: DataFrame, both: DataFrame, n: int, directed: int, rows: int) -> DataFrame:
    """v, x: by searches that are joins, in batches of sources."""
    both = F.broadcast(both) if directed <= BROADCAST_EDGES else both
    batches = -(-n * n // rows) or 1
    sources = nodes.select(F.col("id").alias("v"), "parts", F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch"))
    sums = [_batch(sources.where(F.col("batch") == k).drop("batch"), both, n, directed / n) for k in range(batches)]
    return reduce(DataFrame.unionByName, sums)


def betweenness(edges: DataFrame, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """node, betweenness: unweighted, ends left out, divided by (n - 1)(n - 2); 0 where n <= 2. Edges (src, dst), each once; loops don't count."""
    nodes, both, directed = _numbered(edges.where("src <> dst"))
    n = nodes.count()
    if n <= 2:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    sums = _by_components(nodes, both, n, directed, rows, small) if small else _by_joins(nodes, both, n, directed, rows)
    total = sums.groupBy("v").agg((F.sum("x") * (1.0 / ((n - 1) * (n - 2)))).alias("x"))
    return nodes.join(total, F.col("id") == F.col("v"), "left").select("node", F.coalesce("x", F.lit(0.0)).alias("betweenness"))
