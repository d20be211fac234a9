"""How a narrative spreads: each mention's likeliest predecessor, and the trees that these make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .paths import bucket

#: A window is cut into so many stretches of time; a task holds one stretch of a narrative.
STRETCHES = 8


def predecessors(mentions: DataFrame, window_days: float = 7, narrative: str = "narrative", actor: str = "actor") -> DataFrame:
    """narrative, mention_id, actor, ts, parent: the latest mention of the narrative by another actor before this one, and not longer ago than the window; else null.

    Mentions stand by ts, then mention_id. An as-of join in two steps: within a stretch of time, the mention before the
    present run of one actor's mentions; where the stretch has none, the last of an earlier stretch by another actor. Of a stretch
    only its last mention and the last by another actor than that are carried on, to as many stretches as a window has."""
    seconds = window_days * 86400.0 / STRETCHES
    rows = mentions.select(F.col(narrative).alias("g"), "mention_id", F.col(actor).alias("a"), "ts", bucket(mentions, "ts", seconds).alias("b"))
    point = F.struct("ts", "mention_id", "a")
    order = Window.partitionBy("g", "b").orderBy("ts", "mention_id")
    rows = rows.withColumn("before", F.lag(point).over(order))
    begins = F.when(F.col("before").isNotNull() & ~F.col("before.a").eqNullSafe(F.col("a")), F.col("before"))  # where a run of one actor's begins
    rows = rows.withColumn("near", F.last(begins, ignorenulls=True).over(order)).drop("before")
    by_actor = rows.groupBy("g", "b", "a").agg(F.max(point).alias("p"))
    rank = Window.partitionBy("g", "b").orderBy(F.desc("p"))
    ends = by_actor.withColumn("r", F.row_number().over(rank)).where("r <= 2").select(F.col("g").alias("g_"), "p", F.explode(F.sequence(F.col("b") + 1, F.col("b") + STRETCHES + 1)).alias("b_"))
    lone = rows.where("near IS NULL").select("g", "b", "a").distinct()
    carried = lone.join(ends, (F.col("g") == F.col("g_")) & (F.col("b") == F.col("b_")) & ~F.col("p.a").eqNullSafe(F.col("a"))).groupBy("g", "b", "a").agg(F.max("p").alias("far"))
    both = rows.join(carried.withColumnsRenamed({"g": "g_", "b": "b_", "a": "a_"}), (F.col("g") == F.col("g_")) & (F.col("b") == F.col("b_")) & F.col("a").eqNullSafe(F.col("a_")), "left")
    found = F.coalesce("near", "far")
    long = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_days * 86400.0))
    return both.select(F.col("g").alias(narrative), "mention_id", F.col("a").alias(actor), "ts", F.when(found["ts"] >= F.col("ts") - long, found["mention_id"]).alias("parent"))


def placed(links: DataFrame) -> DataFrame:
    """mention_id, root, depth of each mention (mention_id, parent), by pointer jumping: every round doubles the distance that is known."""
    at = cut(links.select("mention_id", F.coalesce("parent", "mention_id").alias("to"), F.col("parent").isNotNull().cast("long").alias("depth")))
    while True:
        ahead = at.select(F.col("mention_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        at = cut(at.join(ahead, "to").select("mention_id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("mention_id", F.col("to").alias("root"), "depth")


def cascades(mentions: DataFrame, window_days: float = 7, narrative: str = "narrative", actor: str = "actor") -> DataFrame:
    """narrative, root, originator, started, size, depth, breadth (most mentions at one depth), actors: a row for each tree of mentions. Mention ids are distinct."""
    links = cut(predecessors(mentions, window_days, narrative, actor))
    each = links.join(placed(links), "mention_id")
    levels = each.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max("depth").alias("depth"), F.max("n").alias("breadth"), F.sum("n").alias("size"))
    actors = each.groupBy("root").agg(F.count_distinct(actor).alias("actors"))
    roots = links.where("parent IS NULL").select(narrative, F.col("mention_id").alias("root"), F.col(actor).alias("originator"), F.col("ts").alias("started"))
    return roots.join(levels, "root").join(actors, "root").select(narrative, "root", "originator", "started", "size", "depth", "breadth", "actors")
