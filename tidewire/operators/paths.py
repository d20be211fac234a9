"""Touch paths: what led to each event within a window before it; and who came first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = " > "


def bucket(df: DataFrame, ts: str, seconds: float) -> Column:
    """Which stretch of so many seconds a time is in: by its instant, or without a zone by its reading of the clock."""
    c = F.col(ts)
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        at = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    else:
        at = F.unix_seconds(c.cast("timestamp"))
    return F.floor(at / max(1, math.ceil(seconds)))


def touches(mentions: DataFrame, events: DataFrame, window_days: float = 7, key: str = "journey_id", keep_empty: bool = False) -> DataFrame:
    """key, event_id, m_ts, mention_id, channel: a row for each mention (key, mention_id, channel, ts) in [ts - window, ts) of an event (key, event_id, ts).

    Both sides are cut into buckets as long as the window: an event's mentions are in its own bucket or the one before. The join is
    on journey and bucket, so the rows of a long journey are spread over tasks by time, and no mention meets an event of
    another stretch. Adaptive execution splits what is still large. Events without a mention have a row of nulls if keep_empty."""
    seconds = window_days * 86400.0
    m = mentions.select(F.col(key).alias("k"), "mention_id", "channel", F.col("ts").alias("m_ts"), bucket(mentions, "ts", seconds).alias("m_b"))
    e = events.select(F.col(key), "event_id", F.col("ts").alias("e_ts"), bucket(events, "ts", seconds).alias("b"))
    e = e.withColumn("b", F.explode(F.array(F.col("b"), F.col("b") - 1)))
    long = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    near = (F.col(key) == F.col("k")) & (F.col("b") == F.col("m_b")) & (F.col("m_ts") < F.col("e_ts")) & (F.col("m_ts") >= F.col("e_ts") - long)
    return e.join(m, near, "left" if keep_empty else "inner").select(key, "event_id", "m_ts", "mention_id", "channel")


def build_paths(mentions: DataFrame, events: DataFrame, window_days: float = 7, key: str = "journey_id", keep_empty: bool = False) -> DataFrame:
    """event_id, key, path, touches, conv: the channels of each event's touches() in order; equal times go by mention_id.

    Events without a mention have no path unless keep_empty."""
    each = touches(mentions, events, window_days, key, keep_empty)
    t = F.array_sort(F.collect_list(F.when(F.col("mention_id").isNotNull(), F.struct("m_ts", "mention_id", "channel"))))
    paths = each.groupBy("event_id", key).agg(t.alias("t"))
    return paths.select("event_id", key, F.array_join(F.transform("t", lambda x: x["channel"]), SEPARATOR).alias("path"), F.size("t").alias("touches"), F.lit(1).cast("long").alias("conv"))


def first_movers(mentions: DataFrame, narrative: str, actor: str, ts: str = "ts", order: str = "mention_id") -> DataFrame:
    """narrative, originator, first_ts, amplifiers (other actors after it): a partial minimum by narrative, no sort of a narrative's rows."""
    first = F.min(F.struct(F.col(ts).alias("ts"), F.col(order).alias("o"), F.col(actor).alias("actor")))
    return mentions.groupBy(narrative).agg(first.alias("f"), F.count_distinct(actor).alias("actors"), F.count(F.lit(1)).alias("mentions")).select(narrative, F.col("f.actor").alias("originator"), F.col("f.ts").alias("first_ts"), (F.col("actors") - 1).alias("amplifiers"), "mentions")


def amplifier_lags(mentions: DataFrame, narrative: str, actor: str, ts: str = "ts") -> DataFrame:
    """narrative, actor, lag_seconds: how long after the narrative's first mention each actor first joined in, and its place."""
    own = mentions.groupBy(narrative, actor).agg(F.min(ts).alias("at"), F.count(F.lit(1)).alias("mentions"))
    w = Window.partitionBy(narrative)
    lag = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.min("at").over(w).cast("timestamp"))
    return own.select(narrative, actor, "mentions", (lag / 1e6).alias("lag_seconds"), F.row_number().over(w.orderBy("at", actor)).alias("place"))
