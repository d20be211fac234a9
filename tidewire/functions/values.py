"""Periods of dates, numbers and sentiment labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: What the labels count, and where a score stops being neutral.
SENTIMENTS = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}
THRESHOLD = 0.05


def week_start(c: Column) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", c).cast("date")


def month_start(c: Column) -> Column:
    return F.date_trunc("month", c).cast("date")


def to_number(c: Column) -> Column:
    """Double of a plain decimal text; anything else, also NaN, is null."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def sentiment_score(label: Column) -> Column:
    s, out = F.lower(strip(label)), F.lit(None).cast("double")
    for name, value in SENTIMENTS.items():
        out = F.when(s == name, F.lit(value)).otherwise(out)
    return out


def overall_sentiment(*scores: Column) -> Column:
    """The first score there is."""
    return F.coalesce(*scores)


def sentiment_bin(score: Column) -> Column:
    """Positive, Negative or Neutral; null is Neutral."""
    return F.when(score > THRESHOLD, "Positive").when(score < -THRESHOLD, "Negative").otherwise("Neutral")
