"""Keywords of high-circulation articles: n-gram counts with document-frequency limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from .quantiles import quantile as _quantile

#: English function words that are no keywords; a parameter of what follows. Lists of libraries differ.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both but by
    can cannot could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just may me might more most must my myself no nor not now of off on once only
    or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
    these they this those through to too under until up very was we were what when where which while who whom why will with
    would you your yours yourself yourselves""".split()
)


def _grams(n: int):
    """The n-grams of the words in column w."""
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def keywords_high_circ_conversion(
    df: DataFrame,
    conv_col: str = "CONVERSION",
    circ_col: str = "CIRCULATION_SIZE_NUM",
    text_col: str = "ARTICLE_TEXT_CLEAN",
    quantile: float = 0.75,
    n_terms: int = 20,
    ngram_range: tuple[int, int] = (1, 2),
    min_df: int = 2,
    max_df: float = 0.9,
    stop_words: tuple[str, ...] = STOP_WORDS,
    strict: bool = False,
) -> DataFrame:
    """term, count: the most frequent n-grams of converted articles (of all, if none is) at or over the quantile of their circulation.

    Terms in fewer than min_df articles or over max_df of them go; equal counts by term, descending. The quantile and
    whether any article has converted are found at once, from their columns alone, so that texts are read, and what made them
    is run, for the articles that pass. strict raises when no term is left."""
    subset = df
    if conv_col in df.columns and not df.where(F.col(conv_col) == 1).select(conv_col).isEmpty():
        subset = df.where(F.col(conv_col) == 1)
    q = _quantile(subset, circ_col, quantile)
    passed = subset.where(F.col(circ_col) >= F.lit(q))
    docs = passed.select(F.coalesce(text_col, F.lit("")).alias("text")).select(F.monotonically_increasing_id().alias("doc"), F.filter(tokens(F.col("text")), lambda w: ~w.isin(list(stop_words))).alias("w"))
    low, high = ngram_range
    per_doc = docs.select("doc", F.explode(F.concat(*[_grams(n) for n in range(low, high + 1)])).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = per_doc.groupBy("term").agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))
    n_docs = passed.agg(F.count(F.lit(1)).alias("n"))
    kept = counts.crossJoin(F.broadcast(n_docs)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    out = kept.orderBy(F.desc("count"), F.desc("term")).limit(n_terms).select("term", "count")
    if strict and out.isEmpty():
        raise ValueError("no term is left by min_df and max_df")
    return out
