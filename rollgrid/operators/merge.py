"""Merging what parallel parts of a query answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_non_empty(results: DataFrame, id: str = "id", data: str = "data", arrival: str = "arrival") -> DataFrame:
    """One result for each id: the first with data, else one of the empty ones."""
    empty = F.coalesce(F.size(data), F.lit(0)) <= 0
    over = Window.partitionBy(id).orderBy(empty, arrival)
    return results.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def drop_empty(results: DataFrame, type: str = "type", data: str = "data") -> DataFrame:
    """All but data results without data."""
    return results.where((F.col(type) != "dataResult") | (F.coalesce(F.size(data), F.lit(0)) > 0))
