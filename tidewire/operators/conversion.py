"""The conversion flag of an article."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repair import plain
from ..functions.text import let
from .quantiles import quantile


def _any_keyword(keywords: list[str], *texts: str) -> Column:
    quoted = "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in keywords)
    found = F.lit(False)
    for t in texts:
        hit = F.col(t).rlike(f"(?iu)(?:{quoted})")
        if all(k.isascii() for k in keywords):
            # In ASCII, case is that of A-Z: lower case is made and searched as bytes.
            hit = F.when(plain(F.col(t)), let(F.lower(t), lambda x: reduce(or_, [x.contains(k.lower()) for k in keywords]))).otherwise(hit)
        found = found | F.coalesce(hit, F.lit(False))
    return found


def derive_conversion_flag(
    df: DataFrame,
    text_keywords: Iterable[str] | None = None,
    tag_includes: Iterable[str] | None = None,
    publication_includes: Iterable[str] | None = None,
    min_circulation_quantile: float | None = None,
    col_name: str = "CONVERSION",
) -> DataFrame:
    """Adds 0 or 1: a keyword in headline or text, a tag, or a publication, whatever the case; with a quantile, only at or over it in circulation.

    The quantile is exact, over all rows, and found at once: it reads the circulation alone."""
    words, tags, names = (list(x or ()) for x in (text_keywords, tag_includes, publication_includes))
    hit = F.lit(False)
    if words:
        hit = hit | _any_keyword(words, "HEADLINE_CLEAN", "ARTICLE_TEXT_CLEAN")
    if tags:
        hit = hit | F.coalesce(F.arrays_overlap(F.transform("TAGS_LIST", F.lower), F.array(*[F.lit(t.lower()) for t in tags])), F.lit(False))
    if names:
        hit = hit | F.coalesce(F.lower("PUBLICATION").isin([n.lower() for n in names]), F.lit(False))
    if min_circulation_quantile is None:
        return df.withColumn(col_name, hit.cast("int"))
    q = quantile(df, "CIRCULATION_SIZE_NUM", min_circulation_quantile)
    return df.withColumn(col_name, F.coalesce(hit & (F.col("CIRCULATION_SIZE_NUM") >= F.lit(q)), F.lit(False)).cast("int"))
