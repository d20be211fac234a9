"""Article tables: CSV exports, Parquet, and the sample tables seen as articles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of an article, in order.
CORE = [
    "ARTICLE_ID", "PUBLICATION", "LOAD_DATE", "COUNTRY", "HEADLINE", "ARTICLE TEXT", "AUTHOR", "SOURCE TYPE", "TAGS",
    "CIRCULATION SIZE", "CHANNEL", "LINK", "Public Health SENTIMENT", "World Health Leadership SENTIMENT",
]
#: Texts that a CSV reader of tables takes for missing.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
ORD = "_ord"


def read_articles(spark: SparkSession, path: str, null_tokens: Iterable[str] = NULL_TOKENS, partitions: int | None = None) -> DataFrame:
    """A CSV export: all columns as text, quoted line feeds and doubled quotes, missing-value tokens as null, `_ord` in file order.

    Quoted line feeds make a file one split; give partitions to spread what follows."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    tokens = list(null_tokens)
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) for c in df.columns], F.monotonically_increasing_id().alias(ORD))
    return df.repartition(partitions) if partitions else df


def conform(df: DataFrame) -> DataFrame:
    """The core columns, those that lack as nulls, and `_ord`; nothing else."""
    cols = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in CORE]
    order = F.col(ORD) if ORD in df.columns else F.monotonically_increasing_id().alias(ORD)
    return df.select(*cols, order)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample tables as raw articles: a document with its event, part and label."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    d = read("documents", "doc_id", "text", "lang", "source", "n_chars")
    e = read("events", F.col("event_id").alias("doc_id"), "ts", "user_id", "event_type")
    p = read("part", F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    x = read("labels", "doc_id", "quality", "toxic")
    j = d.join(e, "doc_id", "left").join(p, "doc_id", "left").join(x, "doc_id", "left")
    s = lambda c: F.col(c).cast("string")
    return j.select(
        s("doc_id").alias("ARTICLE_ID"), F.col("source").alias("PUBLICATION"), F.date_format("ts", "yyyy-MM-dd").alias("LOAD_DATE"), F.col("lang").alias("COUNTRY"),
        F.substring_index("text", "\n", 1).alias("HEADLINE"), F.col("text").alias("ARTICLE TEXT"), s("user_id").alias("AUTHOR"), F.col("p_type").alias("SOURCE TYPE"),
        F.replace("p_name", F.lit(" "), F.lit(", ")).alias("TAGS"), F.when(F.col("doc_id") % 10 == 3, "n/a").otherwise(s("n_chars")).alias("CIRCULATION SIZE"),
        F.col("event_type").alias("CHANNEL"), F.lit(None).cast("string").alias("LINK"),
        F.when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, " negative ").alias("Public Health SENTIMENT"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "neutral").alias("World Health Leadership SENTIMENT"),
        F.col("doc_id").alias(ORD),
    )


def write_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table as Parquet under its name; returns the manifest. None is skipped, as an empty figure would be."""
    written = []
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            written.append(name)
    return written
