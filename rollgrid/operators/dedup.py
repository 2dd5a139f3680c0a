"""Deduplication of events with expiry: every event gets a verdict.

unique: the first of its key in its bucket; duplicate: a later one; expired: too
old when it arrived; error: too far ahead. Arrival is an explicit column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.operators.running import running

UNIQUE, DUPLICATE, EXPIRED, ERROR = "unique", "duplicate", "expired", "error"
#: Defaults of time expiry, in seconds.
DEFAULT_SPAN, DEFAULT_PERIOD, DEFAULT_JUMP = 60, 86_400, 10_800


def _mark_first(accepted: Column, rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """rows with a verdict: among accepted ones, the first of each key is unique.

    The first is found by an aggregation and a join, not a window, so one key may
    have any number of rows.
    """
    at = F.struct(*arrival)
    marked = rows.withColumn("_at", at).withColumn("_in", accepted)
    first = marked.where("_in").groupBy(*keys).agg(F.min("_at").alias("_first"))
    condition = [marked[k].eqNullSafe(first[k]) for k in keys]
    joined = marked.join(first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first"), [marked[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] if condition else F.lit(True), "left")
    verdict = F.when(~F.col("_in"), F.col("verdict")).when(F.col("_at") == F.col("_first"), UNIQUE).otherwise(DUPLICATE)
    return joined.withColumn("verdict", verdict).drop("_at", "_in", "_first", *[f"_k{i}" for i in range(len(keys))])


def dedup(events: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """Without expiry: unique or duplicate."""
    return _mark_first(F.lit(True), events.withColumn("verdict", F.lit(UNIQUE)), [key], arrival)


def dedup_ordered(events: DataFrame, key: str, expiry: str, arrival: list[str], period: int, span: int, max_jump: int | None = None, clock: int | None = None) -> DataFrame:
    """Expiry behind a clock that follows the greatest expiry value so far.

    The clock starts at period - 1, or where it is told to, and never goes back. A value below clock -
    period + 1 is expired; buckets are value div span, and equal keys of different
    buckets are different. With max_jump, a value so far ahead of the clock is an
    error and leaves it alone (once the clock has left its first period).
    """
    start = max(period - 1, clock if clock is not None else period - 1)
    if max_jump is None:
        clocked = running(events, arrival, expiry, "max", "_seen").withColumn("_clock", F.greatest(F.lit(start), F.coalesce("_seen", F.lit(start)))).drop("_seen")
        verdict = F.when(F.col(expiry) < F.col("_clock") - period + 1, EXPIRED).otherwise(UNIQUE)
        judged = clocked.withColumn("verdict", verdict).drop("_clock")
    else:
        judged = _fold_with_jumps(events, expiry, arrival, period, max_jump, start)
    return _mark_first(F.col("verdict") == UNIQUE, judged.withColumn("_bucket", F.floor(F.col(expiry) / span)), ["_bucket", key], arrival).drop("_bucket")


def _fold_with_jumps(events: DataFrame, expiry: str, arrival: list[str], period: int, max_jump: int, start: int) -> DataFrame:
    """A jump that is refused doesn't move the clock, so this is a fold over all rows in order.

    Only arrival and expiry values go through it, in sorted batches of one stream.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*arrival).schema) + ", verdict string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clock = start
        for batch in batches:
            verdicts = []
            for value in batch[expiry]:
                oldest = clock - period + 1
                if value < oldest:
                    verdicts.append(EXPIRED)
                elif oldest > 0 and value - clock > max_jump:
                    verdicts.append(ERROR)
                else:
                    clock = max(clock, value)
                    verdicts.append(UNIQUE)
            yield batch[arrival].assign(verdict=verdicts)

    columns = list(dict.fromkeys([*arrival, expiry]))
    found = events.select(*columns).coalesce(1).sortWithinPartitions(*arrival).mapInPandas(fold, schema)
    return events.join(found, arrival)


def dedup_time(events: DataFrame, key: str, millis: str, arrival: list[str], period: int = DEFAULT_PERIOD, span: int = DEFAULT_SPAN, max_jump: int | None = None, now: int | None = None) -> DataFrame:
    """Ordered expiry on the seconds of a time in milliseconds.

    now: seconds of a wall clock that takes the place of the clock of events.
    """
    seconds = events.withColumn("_seconds", F.floor(F.col(millis) / 1000))
    if now is None:
        return dedup_ordered(seconds, key, "_seconds", arrival, period, span, max_jump).drop("_seconds")
    late = F.when(F.col("_seconds") < now - period + 1, EXPIRED).otherwise(UNIQUE)
    judged = seconds.withColumn("verdict", late).withColumn("_bucket", F.floor(F.col("_seconds") / span))
    return _mark_first(F.col("verdict") == UNIQUE, judged, ["_bucket", key], arrival).drop("_bucket", "_seconds")


def dedup_categorical(events: DataFrame, key: str, category: str, arrival: list[str], expiry_buckets: int) -> DataFrame:
    """The most recent expiry_buckets categories, by first arrival, are live; older ones are expired."""
    at = events.withColumn("_at", F.struct(*arrival))
    first = at.groupBy(F.col(category).alias("_category")).agg(F.min("_at").alias("_begins"))
    marked = at.join(first, at[category].eqNullSafe(F.col("_category"))).withColumn("_new", (F.col("_at") == F.col("_begins")).cast("long")).drop("_category")
    counted = running(marked, arrival, "_new", "sum", "_seen", inclusive=True)
    ranks = counted.where("_new = 1").select(F.col(category).alias("_category"), F.col("_seen").alias("_rank"))
    judged = counted.join(ranks, counted[category].eqNullSafe(F.col("_category"))).withColumn("verdict", F.when(F.col("_rank") <= F.col("_seen") - expiry_buckets, EXPIRED).otherwise(UNIQUE))
    return _mark_first(F.col("verdict") == UNIQUE, judged.drop("_at", "_begins", "_new", "_seen", "_rank", "_category"), [category, key], arrival)


def dedup_counts(judged: DataFrame) -> DataFrame:
    """verdict, n for each of the four verdicts."""
    told = judged.sparkSession.createDataFrame([(v,) for v in (UNIQUE, DUPLICATE, EXPIRED, ERROR)], "verdict string")
    counts = judged.groupBy("verdict").agg(F.count("*").alias("n"))
    return told.join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


def in_order(judged: DataFrame, arrival: list[str]) -> DataFrame:
    """Verdicts in the order of arrival."""
    return judged.orderBy(*arrival)
