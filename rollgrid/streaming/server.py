"""Queries that are answered while a stream runs: once, or again after each batch for a while."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.plans.query import DataQuery, answer, parse_query, result_json, schema_json
from rollgrid.streaming.jobs import CubeStore


@dataclass(frozen=True)
class Registered:
    """A query, the first batch that answered it, and how many do."""

    query: DataQuery
    first: int | None
    times: int


class QueryServer:
    """Takes JSON queries, and answers them in JSON from a store's cube after each batch.

    A query without a countdown is answered once, one with a countdown after so many
    batches; one that comes again keeps the larger number. Queries that can't be
    parsed are left out. A batch that runs again gives its answers again, no further ones.
    """

    def __init__(self, store: CubeStore, path: str | None = None) -> None:
        self.store, self.path = store, path
        self.registered: dict[str, Registered] = {}
        self.schema_queries: list[str] = []

    def submit(self, text: str) -> str | None:
        """The id of a query that will be answered; None for one that is left out."""
        try:
            told = json.loads(text)
            if told.get("type") == "schemaQuery":
                self.schema_queries.append(str(told["id"]))
                return str(told["id"])
            query = parse_query(told, self.store.schema)
        except (ValueError, KeyError, AttributeError):
            return None
        times = int(query.countdown or 1)
        known = self.registered.get(query.id)
        if known is None or times > known.times:
            self.registered[query.id] = Registered(query, known.first if known else None, times)
        return query.id

    def answers(self, batch: int) -> list[str]:
        """The messages of a batch: one for each schema query and each query that still runs."""
        cube = self.store.read()
        out = [schema_json(cube, self.store.schema, i) for i in self.schema_queries]
        self.schema_queries = []
        for id, own in list(self.registered.items()):
            first = batch if own.first is None else own.first
            left = own.times - (batch - first)
            if left < 1:
                del self.registered[id]
                continue
            self.registered[id] = replace(own, first=first)
            told = own.query if own.query.countdown is None else replace(own.query, countdown=left)
            out.append(result_json(answer(cube, self.store.schema, told), told))
        return out

    def on_batch(self, events: DataFrame, batch: int) -> None:
        """What a stream calls for each batch: the store takes it, then all queries are answered."""
        self.store.upsert(events, batch)
        messages = self.answers(batch)
        if self.path and messages:
            spark = events.sparkSession
            rows = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "place int, value string")
            rows.coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(f"{self.path}/batch={batch}")

    def results(self) -> DataFrame:
        """batch, id, message: all that was answered."""
        rows = self.store.spark.read.text(self.path)
        return rows.select(F.col("batch").cast("int").alias("batch"), F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("message"))
