"""Summary tables of preprocessed articles. Each is lazy; ties are broken by the group's key, ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .preprocess import SENTIMENT_COLUMNS



def count_by(df: DataFrame, key: str, *order: Column, limit: int | None = None) -> DataFrame:
    """key, count of articles; null keys are left out; most first unless another order is given."""
    k = F.col(f"`{key}`")
    out = df.where(k.isNotNull()).groupBy(k.alias(key)).agg(F.count("ARTICLE_ID").alias("count"))
    out = out.orderBy(*(order or (F.desc("count"), F.asc(f"`{key}`"))))
    return out.limit(limit) if limit else out


def top_publications(df: DataFrame, n: int = 30) -> DataFrame:
    return count_by(df, "PUBLICATION", limit=n)


def sources_count_avg_circ(df: DataFrame) -> DataFrame:
    """With the group of missing publications."""
    out = df.groupBy("PUBLICATION").agg(F.count("ARTICLE_ID").alias("articles"), F.avg("CIRCULATION_SIZE_NUM").alias("avg_circ"))
    return out.orderBy(F.desc("articles"), F.desc_nulls_last("avg_circ"), F.asc("PUBLICATION"))


def sources_by_avg_circ(df: DataFrame) -> DataFrame:
    """The same, by average circulation first."""
    return sources_count_avg_circ(df).orderBy(F.desc_nulls_last("avg_circ"), F.desc("articles"), F.asc("PUBLICATION"))


def volume(df: DataFrame, period: str) -> DataFrame:
    """period is DAY, WEEK or MONTH; no gaps are filled."""
    return count_by(df, period, F.asc(period))


def top_tags(df: DataFrame, n: int = 50) -> DataFrame:
    tags = df.select("ARTICLE_ID", F.explode("TAGS_LIST").alias("TAGS_LIST")).where("TAGS_LIST <> ''")
    return count_by(tags, "TAGS_LIST", limit=n)


def overall_sentiment_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("SENT_OVERALL_BIN").alias("overall_bin")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "overall_bin")


def sentiment_by_topic(df: DataFrame) -> DataFrame:
    """topic, raw label, count."""
    long = df.unpivot(["ARTICLE_ID"], [F.col(f"`{c}`") for c in SENTIMENT_COLUMNS], "topic", "label").dropna(subset=["label"])
    return long.groupBy("topic", "label").agg(F.count("ARTICLE_ID").alias("count")).orderBy("topic", F.desc("count"), "label")


def conversion_summary(df: DataFrame, conv_col: str = "CONVERSION") -> DataFrame:
    """metric, value: total_articles, conversion_articles, conversion_rate (null of no article)."""
    one = df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum(conv_col), F.lit(0)).cast("double").alias("c"))
    rows = [("total_articles", F.col("n")), ("conversion_articles", F.col("c")), ("conversion_rate", F.try_divide(F.col("c"), F.col("n")))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows])))


def eda_tables(df: DataFrame, conv_col: str = "CONVERSION") -> dict[str, DataFrame]:
    """All tables by name; they share df, so cache it when more than one is wanted."""
    out = {
        "top_publications": top_publications(df),
        "sources_count_avg_circ": sources_count_avg_circ(df),
        "by_source_type": count_by(df, "SOURCE TYPE"),
        "by_channel": count_by(df, "CHANNEL"),
        "by_country": count_by(df, "COUNTRY"),
        "volume_daily": volume(df, "DAY"),
        "volume_weekly": volume(df, "WEEK"),
        "volume_monthly": volume(df, "MONTH"),
        "top_tags": top_tags(df),
        "overall_sentiment": overall_sentiment_counts(df),
        "sentiment_by_topic": sentiment_by_topic(df),
    }
    return out | ({"conversion_summary": conversion_summary(df, conv_col)} if conv_col in df.columns else {})


def bar_data(df: DataFrame | dict | None, x: str, y: str, limit: int | None = None, horizontal: bool = False, spark=None, max_rows: int = 1_000_000):
    """What a bar or line figure shows, in drawing order, on the driver: x and y lists; None for no rows. All rows, or the first `limit`; more than max_rows are refused."""
    if isinstance(df, dict):
        df = spark.createDataFrame([*zip(*df.values())], [*df])
    rows = df.limit(max_rows + 1 if limit is None else limit).select(F.col(f"`{x}`"), F.col(f"`{y}`")).collect() if df is not None else []
    if len(rows) > max_rows:
        raise ValueError(f"a figure of over {max_rows} points")
    if not rows:
        return None
    rows = rows[::-1] if horizontal else rows
    return [r[0] for r in rows], [r[1] for r in rows]
