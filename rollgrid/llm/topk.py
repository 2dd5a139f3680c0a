"""Exact order statistics of distributed columns, by a few bounded aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by histograms of an ever narrower range.

    Each round collects at most bins counts. Equal values stay together, so at
    least k rows are not below the result.
    """
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k >= n:
        return -math.inf
    above = 0
    for _ in range(8):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        counts = dict(inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.struct(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))).collect())
        for b in sorted(counts, reverse=True):
            own = counts[b]
            if above + own["n"] >= k:
                low, high = own["lo"], own["hi"]
                if above + own["n"] == k or low == high:
                    return low
                break
            above += own["n"]
    return low
