"""Late-data classification of events against a reference clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL, LAGGARD, LATE, ERROR = "normal", "laggard", "late_laggard", "error"


def laggard_verdict(time: Column, clock: Column, buffer: int = 60_000, tumbling: int = 3_600_000, laggards: int = 900_000) -> Column:
    """normal, laggard, late_laggard or error for a time, all in milliseconds.

    The current window starts at the clock's tumbling window; laggards may be as
    old as the longer of the tumbling and the laggards window before it. Times
    beyond the clock plus buffer are errors; so are late laggards, which keep
    their own name. A null time is an error.
    """
    start = clock - F.pmod(clock, F.lit(tumbling))
    oldest = start - F.lit(max(tumbling, laggards))
    return F.when(time.isNull() | (time > clock + F.lit(buffer)), ERROR).when(time < oldest, LATE).when(time >= start, NORMAL).otherwise(LAGGARD)


def classify(events: DataFrame, time: str, clock: Column, **windows: int) -> DataFrame:
    """events with a verdict column."""
    return events.withColumn("verdict", laggard_verdict(F.col(time), clock, **windows))


def verdict_counts(classified: DataFrame) -> DataFrame:
    """One row of tuples in all and by verdict; errors include late laggards."""

    def n(*verdicts: str) -> Column:
        return F.coalesce(F.sum(F.col("verdict").isin(*verdicts).cast("long")), F.lit(0))

    return classified.agg(F.count("*").alias("total"), n(NORMAL).alias("normal"), n(LAGGARD).alias("laggards"), n(LATE).alias("late_laggards"), n(ERROR, LATE).alias("errors"))
