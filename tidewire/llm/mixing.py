"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+`. Sources in code point order, null last, weigh 5, 2, 1 in
turn and share `share` of all sizes; no target is over `cap` times its source's size, and what is cut off goes to the others
by weight. Each document of a source expects target / source size copies. Within a source the documents stand in order of size
and id; the copies expected so far, plus one offset of the source drawn from the seed, are summed along that order, and a
document is emitted once for each integer that its sum crosses. As the order runs from short to long, every stretch of sizes gets
its share and the words taken come near the target.

Defined results: a null or empty text has size 0 and is never taken into account for targets; it still has a row. A source
without words has target 0. Repeated rows count each. An empty table gives no rows. Other columns aren't looked at.
The sums are formed in two steps, within ranges of rows and over the ranges' totals, so no source meets in one task.
All of it is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"
#: Sources up to this number are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> and weight, target: the level at which min(cap, level * weight) add up to the share.

    Over sources in order of cap / weight, the first k are at their cap; the level for each k comes from running sums.
    A window over all sources sees a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    rows = sources.withColumns({"weight": weight, "cap": CAP * F.col("source_size")})
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    whole = SHARE * F.sum("source_size").over(every)
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return rows.withColumn("at", first).select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """A row for each document: id, source, size, source_size, target, copies."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    sized = shared.keep(rows, "sizes")
    sources = shared.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    few = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)
    keys = [F.col("source").asc_nulls_first(), F.col("size"), F.col("id").asc_nulls_first(), F.col("n")]
    # Ranges of rows in order; the number of a row's range is written with it.
    dealt = sized.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*keys)
    ranged = shared.keep(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    rates = sources.select(F.col("source").alias("source_"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("expected"))
    totals = ranged.groupBy("source", "range").agg(F.count(F.lit(1)).alias("rows"))  # a row for each source and range
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    joined = ranged.join(F.broadcast(totals) if few else totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")), "left").drop("s", "r")
    joined = joined.join(hint(rates), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    place = F.row_number().over(Window.partitionBy("range", "source").orderBy("size", F.col("id").asc_nulls_first(), "n")) + F.col("ahead")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    crossed = F.floor(F.col("place") * F.col("expected") + F.col("drawn")) - F.floor((F.col("place") - 1) * F.col("expected") + F.col("drawn"))
    return joined.withColumns({"place": place, "drawn": drawn}).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents as often as plan() says, with their own columns.

    Rows of one id, source and size are matched with their copies in an order of their own."""
    keys = ["id_", "source_", "size_"]
    each = Window.partitionBy(*keys)
    wanted = plan(docs, id_col, text_col, source_col, seed).select(F.col(id_col).alias("id_"), F.col("source").alias("source_"), F.col("size").alias("size_"), "copies")
    wanted = wanted.withColumn("n_", F.row_number().over(each.orderBy(F.desc("copies")))).where("copies > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).alias("id_"), F.col(source_col).alias("source_"), size_of(F.col(text_col)).alias("size_"), F.xxhash64(text_col).alias("h_"))
    rows = rows.withColumn("n_", F.row_number().over(each.orderBy("h_"))).alias("a")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "n_"]]
    both = rows.join(wanted.alias("b"), same, "inner")
    return both.select("a.row", F.explode(F.sequence(F.lit(1), F.col("b.copies")))).select("row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    p = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s0
), s2 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1
), s3 AS (
  SELECT min(level) FILTER (WHERE level <= cap / weight AND cap / weight = (SELECT min(cap / weight) FROM s2 WHERE level <= cap / weight)) AS lv FROM s2
), s4 AS (
  SELECT source, source_size, least(cap, coalesce(lv * weight, cap)) AS target,
    CASE WHEN source_size > 0 THEN least(cap, coalesce(lv * weight, cap)) / source_size ELSE 0 END AS expected,
    CAST('0x' || substr(md5('mix-1/' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS drawn
  FROM s2, s3
), p AS (
  SELECT d.doc_id, d.size, s4.source_size, s4.target, s4.expected, s4.drawn,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS place
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source
), c AS (
  SELECT *, CAST(floor(place * expected + drawn) - floor((place - 1) * expected + drawn) AS BIGINT) AS copies FROM p
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
