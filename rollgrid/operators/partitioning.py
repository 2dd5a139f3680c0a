"""How parallel parts are laid out: by latency, by round robin, by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of an order that are looked through together for the last ones of a part.
RECENT = 100_000


def latency_load(latencies: Sequence[float], least: float, most: float) -> int:
    """+1, 0 or -1 parts to add, from the moving average of a part's latencies."""
    if least > most:
        raise ValueError("the least latency is above the most")
    mean = sum(latencies) / len(latencies) if latencies else least
    return 1 if mean > most else -1 if mean < least else 0


def latency_load_column(mean: Column, least: float, most: float) -> Column:
    """The same for a column of mean latencies."""
    return F.when(mean > most, 1).when(mean < least, -1).otherwise(0)


def moving_load(rows: DataFrame, part: str, order: str, latency: str, n: int, least: float, most: float) -> DataFrame:
    """part, latency, load: each part's mean of its last n latencies, and the parts to add for it.

    The last ones are kept by an aggregation, combined before its shuffle, so that a part may have any number of rows.
    """
    last = F.expr(f"slice(reverse(array_sort(collect_list(struct(`{order}` AS o, `{latency}` AS v)))), 1, {n})")
    recent = rows.groupBy(part, F.floor(F.col(order) / RECENT).alias("_run")).agg(last.alias("_last"))
    every = recent.groupBy(part).agg(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("_last")))), 1, n).alias("_last"))
    mean = F.aggregate("_last", F.lit(0.0), lambda total, x: total + x["v"]) / F.size("_last")
    means = every.select(part, mean.alias(latency))
    return means.withColumn("load", latency_load_column(F.col(latency), least, most))


def deal_round_robin(items: Sequence, parts: int) -> list[list]:
    """Items over parts by turns; never more parts than items."""
    n = max(1, min(parts, len(items)))
    return [list(items[i::n]) for i in range(n)]


def hash_part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
