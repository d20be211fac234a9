"""From raw articles to the preprocessed table, and the profiles of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_text, month_start, overall_sentiment, parse_date, sentiment_bin, sentiment_score, split_tags, to_number, week_start, word_count
from ..sources import conform
from ..sources.articles import ORD

SENTIMENT_COLUMNS = ("Public Health SENTIMENT", "World Health Leadership SENTIMENT")


def remove_empty_rows(df: DataFrame, but: tuple[str, ...] = (ORD,)) -> DataFrame:
    """Without rows that are null in all columns but the named ones."""
    return df.dropna(how="all", subset=[f"`{c}`" if " " in c else c for c in df.columns if c not in but])


def remove_empty_columns(df: DataFrame, but: tuple[str, ...] = (ORD,)) -> DataFrame:
    """Without columns that are null throughout: one aggregate over all rows, run at once, as the schema depends on it."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] or c in but])


def dedup_first(df: DataFrame, key: str, order: str | Column = ORD) -> DataFrame:
    """The first row of each key in order; nulls are one key. Catalyst limits each group within tasks before the shuffle."""
    first = Window.partitionBy(F.col(f"`{key}`")).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def preprocess(df: DataFrame, null_text: str = "") -> DataFrame:
    """Conformed, deduplicated by ARTICLE_ID and with the derived columns. null_text is what a missing text counts as ("nan" for parity with text-cast tables).

    A row with an id isn't empty. So whether any row lacks one is looked up at once, in that column alone; where none does, no
    other column is read to find empty rows, and what follows reads the columns that it names. So is whether any id repeats;
    where none does, there is nothing to drop, and texts are neither shuffled nor sorted by id."""
    df = conform(df)
    lacking, most = df.groupBy("ARTICLE_ID").agg(F.count(F.lit(1)).alias("n")).agg(F.bool_or(F.col("ARTICLE_ID").isNull()), F.max("n")).first()
    if lacking:
        df = remove_empty_rows(df)
    if (most or 0) > 1:
        df = dedup_first(df, "ARTICLE_ID")
    text = lambda c: clean_text(F.coalesce(F.col(f"`{c}`"), F.lit(null_text)))
    df = df.withColumns({"LOAD_DATE": parse_date(F.col("LOAD_DATE")), "ARTICLE_TEXT_CLEAN": text("ARTICLE TEXT"), "HEADLINE_CLEAN": text("HEADLINE")})
    scores = {f"{c}__num": sentiment_score(F.col(f"`{c}`")) for c in SENTIMENT_COLUMNS}
    df = df.withColumns(
        {"DAY": F.col("LOAD_DATE"), "WEEK": week_start(F.col("LOAD_DATE")), "MONTH": month_start(F.col("LOAD_DATE")), "TAGS_LIST": split_tags(F.col("TAGS")), "CIRCULATION_SIZE_NUM": to_number(F.col("`CIRCULATION SIZE`"))} | scores
    )
    df = df.withColumn("SENT_OVERALL_NUM", overall_sentiment(*[F.col(f"`{c}`") for c in scores]))
    return df.withColumns({"SENT_OVERALL_BIN": sentiment_bin(F.col("SENT_OVERALL_NUM")), "WORD_LEN": word_count(F.col("ARTICLE_TEXT_CLEAN")), "CHAR_LEN": F.length("ARTICLE_TEXT_CLEAN")})


def preview(df: DataFrame, n: int = 5, order: str = ORD) -> DataFrame:
    return df.orderBy(order).limit(n)


def null_profile(df: DataFrame) -> DataFrame:
    """column, type, non_null, nulls: one aggregate over the table, then a row for each column."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("non_null"), (F.col("_n") - F.col(f"c{i}")).alias("nulls")) for i, (c, t) in enumerate(df.dtypes)])
    return one.select(F.inline(rows))
