"""Rollups of events over grouping sets and time buckets.

Events are aggregated once, by all keys and the coarsest time that divides all
buckets; every grouping set and bucket is then rolled up from those partial
results. So the expansion over sets and buckets multiplies groups, not events,
and raw events are read and shuffled (combined map-side) once.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.functions.timebuckets import ALL_TIME, bucket_millis
from rollgrid.operators.aggregators import COMPOSITE, INCREMENTAL, ON_THE_FLY
from rollgrid.plans.schema import TYPES, Descriptor, Schema, Value


def _stored_columns(schema: Schema) -> list[tuple[str, str]]:
    """(measure, aggregator) of everything that some descriptor stores, in schema order."""
    return [(v.name, a) for v in schema.values for a in INCREMENTAL if any(a in d.aggregates.get(v.name, ()) for d in schema.descriptors)]


def _source(expression: str | None, name: str, aliases: dict[str, str]) -> Column:
    if name in aliases:
        return F.expr(aliases[name])
    return F.expr(expression) if expression else F.col(name)


def _value(v: Value, aliases: dict[str, str]) -> Column:
    return _source(v.expression, v.name, aliases)


def rollup(events: DataFrame, schema: Schema, time: str = "time", arrival: str | None = None, key_aliases: dict[str, str] | None = None, value_aliases: dict[str, str] | None = None) -> DataFrame:
    """dims, bucket, time, keys and "measure:AGG" columns: a row for each group of each descriptor.

    time names a column of epoch milliseconds. Keys that a grouping set lacks are
    null, as are aggregates that its descriptor does not store. Aliases give the
    expression that a key or measure is read from; they win over the schema's own.
    arrival orders events for FIRST and LAST (default: time).
    """
    key_aliases, value_aliases = key_aliases or {}, value_aliases or {}
    columns = _stored_columns(schema)
    at = F.col(arrival or time) if arrival or schema.has_time else F.lit(0)
    step = reduce(gcd, (bucket_millis(b) for b in schema.buckets)) if schema.has_time else 0
    base_time = (F.col(time) - F.pmod(F.col(time), F.lit(step))) if schema.has_time else F.lit(None).cast("long")
    grouped = {n for d in schema.descriptors for n in d.keys}
    keys = [_source(k.expression, k.name, key_aliases).alias(k.name) for k in schema.keys if k.name in grouped]
    values = {v.name: _value(v, value_aliases) for v in schema.values}
    partials = [INCREMENTAL[a].partial(values[n], at).alias(f"{n}:{a}") for n, a in columns]
    base = events.groupBy(*keys, base_time.alias("time")).agg(*partials)
    return _expand(base, schema, columns)


def _expand(base: DataFrame, schema: Schema, columns: list[tuple[str, str]]) -> DataFrame:
    """Every descriptor's groups, from partial results by all keys."""
    names = schema.key_names()
    types = {k.name: TYPES[k.type] for k in schema.keys} | dict(base.dtypes)
    if len(schema.descriptors) == 1:  # what was aggregated is the result
        (d,) = schema.descriptors
        own = [(F.col(f"`{n}`") if n in d.keys else F.lit(None).cast(types[n])).alias(n) for n in names]
        held = [INCREMENTAL[a].value(F.col(f"`{n}:{a}`")).alias(f"{n}:{a}") for n, a in columns]
        return base.select(F.lit(d.dims).alias("dims"), F.lit(d.bucket).alias("bucket"), "time", *own, *held)

    def place(d: Descriptor) -> Column:
        start = F.lit(None).cast("long") if d.bucket == ALL_TIME else F.col("time") - F.pmod(F.col("time"), F.lit(bucket_millis(d.bucket)))
        own = [(F.col(f"`{n}`") if n in d.keys else F.lit(None).cast(types[n])).alias(n) for n in names]
        return F.struct(F.lit(d.dims).alias("dims"), F.lit(d.bucket).alias("bucket"), start.alias("time"), *own)

    spread = base.withColumn("place", F.explode(F.array(*[place(d) for d in schema.descriptors]))).select("place.*", *[F.col(f"`{n}:{a}`") for n, a in columns])
    merged = spread.groupBy("dims", "bucket", "time", *[f"`{n}`" for n in names]).agg(*[INCREMENTAL[a].merge(F.col(f"`{n}:{a}`")).alias(f"{n}:{a}") for n, a in columns])
    shown = []
    for n, a in columns:
        holders = [d for d in schema.descriptors if a in d.aggregates.get(n, ())]
        column = INCREMENTAL[a].value(F.col(f"`{n}:{a}`"))
        if len(holders) < len(schema.descriptors):
            column = F.when(F.concat_ws("|", "dims", "bucket").isin([f"{d.dims}|{d.bucket}" for d in holders]), column)
        shown.append(column.alias(f"{n}:{a}"))
    return merged.select("dims", "bucket", "time", *[f"`{n}`" for n in names], *shown)


def aggregate_rows(cube: DataFrame, schema: Schema) -> DataFrame:
    """dims, bucket, time, keys, aggregator, measures: one row for each group and stored aggregator."""
    names = schema.key_names()
    measures = [v.name for v in schema.values]
    out = None
    for a in INCREMENTAL:
        holders = {(d.dims, d.bucket) for d in schema.descriptors if any(a in own for own in d.aggregates.values())}
        if not holders:
            continue
        rows = cube.where(F.concat_ws("|", "dims", "bucket").isin([f"{x}|{b}" for x, b in holders]))
        part = rows.select("dims", "bucket", "time", *[f"`{n}`" for n in names], F.lit(a).alias("aggregator"), *[(F.col(f"`{m}:{a}`") if f"{m}:{a}" in cube.columns else F.lit(None)).cast("double").alias(m) for m in measures])
        out = part if out is None else out.unionByName(part)
    return out


def merge_cubes(cubes: DataFrame, schema: Schema) -> DataFrame:
    """One cube from the union of several: equal groups are merged."""
    group = ["dims", "bucket", "time", *schema.key_names()]
    columns = [c for c in cubes.columns if ":" in c]
    return cubes.groupBy(*[f"`{g}`" for g in group]).agg(*[INCREMENTAL[c.rpartition(":")[2]].merge(F.col(f"`{c}`")).alias(c) for c in columns])


def on_the_fly(cube: DataFrame, measure: str, aggregator: str) -> Column:
    """A derived aggregate from a cube's stored columns."""
    otf = ON_THE_FLY[aggregator]
    return otf.value(*[F.col(f"`{measure}:{c}`") for c in otf.children])


def cumulative_sum(cube: DataFrame, schema: Schema, column: str) -> DataFrame:
    """Adds "measure:CUM_SUM": the running sum of a stored SUM over time, in each group of keys."""
    measure = column.rpartition(":")[0]
    return cube.withColumn(f"{measure}:CUM_SUM", running_sum(F.col(f"`{column}`"), schema))


def running_sum(value: Column, schema: Schema) -> Column:
    """Over the buckets of a group in time, so over as many rows as it has buckets."""
    over = Window.partitionBy("dims", "bucket", *[f"`{n}`" for n in schema.key_names()]).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(over)


def rank_composite(cube: DataFrame, schema: Schema, measure: str, parent: tuple[str, ...], sub: tuple[str, ...], bucket: str, aggregator: str, embedded: str, count: int) -> DataFrame:
    """bucket, time, parent keys, sub_key, value, rank: the count largest (TOPN), smallest (BOTTOMN) or first of another order.

    Ranked by value, then by sub key; sub keys of several columns are joined by
    commas. Null values are not ranked.
    """
    own = schema.find(set(parent) | set(sub), bucket)
    value = on_the_fly(cube, measure, embedded) if embedded in ON_THE_FLY else F.col(f"`{measure}:{embedded}`")
    rows = cube.where((F.col("dims") == own.dims) & (F.col("bucket") == bucket)).select("bucket", "time", *[f"`{p}`" for p in parent], F.concat_ws(",", *[F.col(f"`{s}`").cast("string") for s in sorted(sub)]).alias("sub_key"), value.alias("value")).where("value IS NOT NULL")
    order = COMPOSITE[aggregator](F.col("value"))
    over = Window.partitionBy("bucket", "time", *[f"`{p}`" for p in parent]).orderBy(order, "sub_key")
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= count)


def collect_composite(ranked: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """bucket, time, parent keys and array<struct<k, v>> in order of rank: at most count entries a group."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("sub_key").alias("k"), F.col("value").alias("v")))), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    return ranked.groupBy("bucket", "time", *[f"`{p}`" for p in parent]).agg(entries.alias(name))
