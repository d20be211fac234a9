"""Exact quantiles of a column of any size, by distributed selection.

Values are counted by range, thousands of ranges at a time; only the range that holds the two ranks in question is looked at again, in finer
ranges, until few values are left or all are equal. Each pass is a scan with partial sums: values aren't sorted or shuffled.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Ranges of a pass, and values that are looked at one by one.
RANGES, FEW = 4096, 10_000


def quantile(df: DataFrame, col: str | Column, q: float) -> float | None:
    """The q-quantile of the values, linear between the two nearest ranks; null and NaN are left out, None of no value.

    It runs at once. What is collected are a pass's counts of ranges and, at last, up to FEW values."""
    if not 0 <= q <= 1:
        raise ValueError(f"a quantile is from 0 to 1, not {q}")
    x = (F.col(f"`{col}`") if isinstance(col, str) else col).cast("double")
    values = cut(df.select(x.alias("x")).where("x IS NOT NULL AND NOT isnan(x)"))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    at = q * (n - 1)
    rank = math.floor(at)
    a = _ranked(values, rank, n, low, high)
    if at == rank:
        return a
    up_to, above = values.agg(F.count_if(F.col("x") <= a), F.min(F.when(F.col("x") > a, F.col("x")))).first()
    return a if up_to > rank + 1 else a + (above - a) * (at - rank)


def _ranked(values: DataFrame, rank: int, n: int, low: float, high: float) -> float:
    """The value of a rank, from 0, among n values from low to high."""
    while low < high:
        within = values.where(F.col("x").between(low, high))
        if n <= FEW:
            return sorted(r["x"] for r in within.collect())[rank]
        counts = within.groupBy(_range(low, high).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("k").collect()
        for r in counts:
            if rank < r["n"]:
                n, low, high = r["n"], r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def _range(low: float, high: float) -> Column:
    """Which of about RANGES equal ranges a value is in; infinities are apart. The least and the greatest value never share one."""
    a, z = max(low, -sys.float_info.max) / 2, min(high, sys.float_info.max) / 2  # halves, as their difference has to be finite
    if a == z:
        return F.when(F.col("x") == -math.inf, 0).when(F.col("x") == math.inf, 2).otherwise(1)
    return F.when(F.col("x") == -math.inf, -1).when(F.col("x") == math.inf, RANGES + 1).otherwise(F.floor((F.col("x") / 2 - a) / (z - a) * RANGES))
