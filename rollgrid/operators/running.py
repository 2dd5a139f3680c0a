"""Running maxima and sums over a global order, without a single-task window.

The order's leading column is cut into ranges of about as many rows each; each
range is scanned on its own, and what came before it is added from a table with
one row for each range. Nulls of the leading column come first, in a range of
their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, order: list[str], value: str, kind: str, out: str, inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """rows with the maximum ("max") or sum ("sum") of value over all rows before, in order.

    order: columns of which the first is a number. inclusive: a row counts itself.
    Rows of equal order have no fixed place. Null where nothing comes before.
    """
    if kind not in ("max", "sum"):
        raise ValueError(f"unknown kind {kind!r}")
    fold = {"max": F.max, "sum": F.sum}[kind]
    ranges = ranges or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lead = F.col(order[0]).cast("double")
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx(lead, shares, 100 * ranges).alias("_cuts"))  # one row
    part = F.when(lead.isNull(), -1).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < lead)))
    ranged = rows.crossJoin(F.broadcast(cuts)).withColumn("_range", part.cast("int")).drop("_cuts")
    totals = ranged.groupBy("_range").agg(fold(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    earlier = totals.select("_range", fold("_total").over(before).alias("_earlier"))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = ranged.withColumn("_own", fold(value).over(own)).join(F.broadcast(earlier), "_range")
    both = F.greatest("_own", "_earlier") if kind == "max" else F.when(F.col("_own").isNull() & F.col("_earlier").isNull(), None).otherwise(F.coalesce("_own", F.lit(0)) + F.coalesce("_earlier", F.lit(0)))
    return joined.withColumn(out, both).drop("_range", "_own", "_earlier")
