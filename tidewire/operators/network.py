"""Entity co-occurrence graphs: edges, degree, betweenness, components, and the table behind a network figure."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..lineage import cut
from .centrality import SMALL, betweenness
from .connected import components
from .quantiles import quantile

#: Names of a document that meet in one task, about.
BLOCK = 500
#: Rows that a task sorts, and pairs that it counts, about.
ROWS, PAIRS = 250_000, 500_000


def capitalised_spans(text: Column) -> Column:
    """Runs of capitalised words, two or more: a plain stand-in for named_entities()."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}\p{N}'-]+(?: \p{Lu}[\p{L}\p{N}'-]+)+)"), F.lit(1)))


def gazetteer(names: Iterable[str]) -> Callable[[Column], Column]:
    """An extractor of the given names, as whole words."""
    listed = sorted(set(names), key=lambda n: (-len(n), n))
    quoted = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in listed)
    return lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<![\\p{{L}}\\p{{N}}])({quoted})(?![\\p{{L}}\\p{{N}}])"), F.lit(1)))


def _dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df by its keys in so many parts that a task's memory doesn't grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), *keys)


def _named(docs: DataFrame, min_cooccurrences: int, doc: str, entities: str) -> DataFrame:
    """d, e: each document's names, once. They are found once, and kept. Names in fewer documents than an edge needs are dropped: none of their edges can have the weight."""
    if docs.schema[entities].dataType == StringType():
        # Dealt before repeats go: no task holds the names of more rows than it should, neither as lists nor before the shuffle.
        each = docs.select(F.col(doc).alias("d"), F.trim(entities).alias("e")).where("e <> ''")
        each = cut(_dealt(each, docs.count(), ROWS, "d").distinct())
    else:
        each = cut(docs.select(F.col(doc).alias("d"), F.explode(F.array_distinct(F.transform(entities, lambda e: F.trim(e)))).alias("e")).where("e <> ''"))
    if min_cooccurrences < 2:
        return each
    # Counted within tasks first: where every name is in documents enough, rows aren't shuffled by name.
    least = each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).agg(F.min("df")).first()[0]
    if least is None or least >= min_cooccurrences:
        return each
    each = _dealt(each, each.count(), ROWS, "e")
    often = each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_cooccurrences).select("e")
    return cut(each.join(often, "e", "left_semi").select("d", "e"))


def _pairs(each: DataFrame) -> DataFrame:
    """src, dst: a row for each pair of names of a document, src < dst. A document of very many is cut into blocks of about BLOCK, and two blocks meet in a task."""
    own = F.count(F.lit(1)).alias("n")
    rows, copies, pairs = each.groupBy("d").agg(own).agg(F.sum("n"), F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")).first()
    each = _dealt(each, rows or 0, ROWS, "d")
    if rows == copies:
        # No document has more names than a block: they meet where they are.
        met = each.withColumnRenamed("e", "x").join(each.withColumnRenamed("e", "y"), "d").where("x < y")
        return _dealt(met.select(F.col("x").alias("src"), F.col("y").alias("dst")), pairs or 0, PAIRS, "src", "dst")
    blocks = each.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = each.join(blocks, "d").withColumn("k", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
    left = placed.select("d", F.col("e").alias("x"), F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("j"))
    right = placed.select("d", F.col("e").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"))
    left, right = (_dealt(x, copies or 0, ROWS, "d", "i", "j") for x in (left, right))
    met = left.join(right, ["d", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return _dealt(met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")), pairs or 0, PAIRS, "src", "dst")


def cooccurrence_edges(docs: DataFrame, min_cooccurrences: int = 2, doc: str = "doc_id", entities: str = "entities") -> DataFrame:
    """src, dst, weight: documents that hold both, src < dst, at least so many. entities is a list of names, or one name in each of a document's rows. Pairs are dealt to as many tasks as their number asks for."""
    pairs = _pairs(_named(docs, min_cooccurrences, doc, entities))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_cooccurrences)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: of nodes with an edge."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _near(c: str) -> Column:
    """Rounded, so that sums taken in another order are ties still."""
    return F.round(c, 12)


def network_summary(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, degree, betweenness; most central first. small: up to how many edges of a component betweenness() sends it to tasks."""
    return degrees(edges).join(betweenness(edges, small=small), "node").select("node", "degree", "betweenness").orderBy(F.desc(_near("betweenness")), F.desc("degree"), "node")


def eda_network(df: DataFrame, sample_n: int | None = 2000, min_cooccurrences: int = 2, extractor: Callable[[Column], Column] = capitalised_spans, text_col: str = "ARTICLE_TEXT_CLEAN", order: str = "_ord", chars: int | None = 2000) -> tuple[DataFrame, DataFrame]:
    """Edges and summary of the first sample_n articles, by what the extractor finds in their first characters; None for all."""
    some = df if sample_n is None else df.orderBy(order).limit(sample_n)
    text = F.col(text_col) if chars is None else F.substring(F.col(text_col), 1, chars)
    some = some.select(F.col(order).alias("doc_id"), extractor(text).alias("entities"))
    edges = cut(cooccurrence_edges(some, min_cooccurrences))
    return edges, network_summary(edges)


def network_view(edges: DataFrame, summary: DataFrame, top_n: int = 40, label_top: int = 12, edge_keep_pct: float = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, betweenness, rank, size, label) and edges (src, dst, weight, width) of a figure.

    The top_n nodes of the summary, the largest component among them (by its smallest node on a tie), the heaviest
    edge_keep_pct percent of its edges. Sizes go from 400 for the most central to 2200, as figures of this kind have had them.
    At most top_n nodes are left after the first step, so its tables are small."""
    top = cut(summary.orderBy(F.desc(_near("betweenness")), F.desc("degree"), "node").limit(top_n).select("node"))
    both_in = lambda e, n: e.join(F.broadcast(n.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(n.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst", "weight")
    inner = cut(both_in(edges, top))
    comp = components(inner)
    largest = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inner = both_in(inner, comp.join(F.broadcast(largest), "component", "left_semi").select("node"))
    # How figures of this kind have drawn widths, and below sizes.
    kept = inner.where(F.col("weight") >= F.lit(quantile(inner, "weight", 1 - edge_keep_pct / 100))).select("src", "dst", "weight", (0.6 + F.log1p("weight")).alias("width"))
    kept = cut(kept)
    order = Window.orderBy(F.desc(_near("betweenness")), "node")
    nodes = betweenness(kept).select("node", "betweenness", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    size = F.when(F.col("n") > 1, 400 + (F.col("rank") - 1) * 1800.0 / (F.col("n") - 1)).otherwise(400.0)
    return nodes.select("node", "betweenness", "rank", size.alias("size"), (F.col("rank") <= label_top).alias("label")), kept
