"""Loaders of lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.operators.enrich import last_by_key


def load_json_lines(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """Newline-delimited JSON: a later line of a key wins; without keys all lines stay.

    Malformed lines are skipped, as far as the columns that are read show it.
    """
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if not keys:
        return lines
    numbered = lines.select("*", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("_position"))
    return last_by_key(numbered, keys, "_position")


def load_jdbc(spark: SparkSession, url: str, table: str, keys: list[str], query: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table or query behind JDBC; partition: column, lower and upper bound, partitions."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("query", query) if query else reader.option("dbtable", table)
    if partition and not query:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()


def wide_columns(cells: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """row_key and "family.qualifier" columns from (row_key, family, qualifier, value) cells."""
    wanted = [f"{f}.{q}" for f, q in columns]
    named = cells.withColumn("_name", F.concat_ws(".", "family", "qualifier"))
    return named.groupBy("row_key").pivot("_name", wanted).agg(F.first("value"))
