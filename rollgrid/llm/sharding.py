"""Consistent-hash sharding with virtual nodes and bounded loads, in native DataFrames.

The ring has 65,536 places. Each shard owns many virtual nodes on it; a key
falls on a place and belongs to the next virtual node clockwise. Loads are
bounded: a shard takes at most its capacity, and keys that find it full go on
clockwise to the next shard with room. With capacities that add up to the
number of rows, counts differ by one at most.

Only the row counts of the places reach the driver, a number that is fixed
whatever the input is. From them it works out which ranks of each arc go to
which shard; a row then needs only its rank on its place, from a window over
about 1/65,536 of all rows. A place that holds many more, as one id may hold a
third of all rows, is ranked in parts of bounded size, whose counts come before
each other's. Texts are read once and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollgrid.llm.common import checkpointed

PLACES = 65_536
#: Rows of a place that one task ranks, about.
PART_ROWS = 1 << 20

SEGMENT = T.StructType([T.StructField("until", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("shift", T.LongType())])
PLACE = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("before", T.ArrayType(T.LongType())), T.StructField("segments", T.ArrayType(SEGMENT))])


def places_of(n_shards: int, virtual_nodes: int = 128) -> int:
    """Places of the ring: PLACES, doubled until virtual nodes fill a half at most."""
    if n_shards < 1 or virtual_nodes < 1:
        raise ValueError("a ring needs a shard and a virtual node")
    places = PLACES
    while places < 2 * n_shards * virtual_nodes:
        places *= 2
    return places


def ring(n_shards: int, virtual_nodes: int = 128) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise; one place has one owner."""
    nodes: dict[int, int] = {}
    places = places_of(n_shards, virtual_nodes)
    for shard in range(n_shards):
        for i in range(virtual_nodes):
            at = xxhash.xxh64_intdigest(f"shard {shard} node {i}") % places
            while at in nodes:
                at = (at + 1) % places
            nodes[at] = shard
    return sorted(nodes.items())


def capacities(total: int, n_shards: int, load: float = 1.0) -> list[int]:
    """Rows that each shard takes at most; with a load of 1 they add up to the total."""
    if load < 1:
        raise ValueError("the load factor is at least 1")
    if load == 1:
        return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]
    return [-int(-total * load // n_shards)] * n_shards


def assign_arcs(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc, (rank at which the segment ends, shard, slot minus rank).

    counts: rows of each arc in ring order; owners: its shard; room: capacities.
    First all arcs fill their own shards, then what overflows tries the next
    virtual node clockwise, and so on; what an earlier step placed stays.
    """
    room, used, n = list(room), [0] * len(room), len(counts)
    segments: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    placed = [0] * n
    left = [a for a in range(n) if counts[a]]
    for step in range(n):
        still = []
        for a in left:
            shard = owners[(a + step) % n]
            take = min(counts[a] - placed[a], room[shard])
            if take:
                segments[a].append((placed[a] + take, shard, used[shard] - placed[a]))
                placed[a] += take
                room[shard] -= take
                used[shard] += take
            if placed[a] < counts[a]:
                still.append(a)
        left = still
        if not left:
            return segments
    raise ValueError("the shards have no room for all rows")


def _hash(doc_id: str, text: str) -> Column:
    """A row's hash, from its id (from its text where it has none)."""
    return F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id).cast("string"))).otherwise(F.xxhash64(F.lit(1), F.col(text)))


def shard_rows(docs: DataFrame, n_shards: int = 16, virtual_nodes: int = 128, load: float = 1.0, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, for each row of docs (doc_id, text).

    Law "rows": with a load of 1 the shards' counts are at most one apart. size is
    the UTF-8 bytes of the text (null: none) plus 1. slot numbers a shard's rows
    from 0 without gaps. grown_shard is null, since loads decide too. Repeated rows
    each get a slot; rows without an id are placed by their text; text_crc32 of a
    null text is null. Rows of one id or hash tie on their place; which of them comes
    first is open, but each has a slot of its own. A very long text counts as one row,
    and only its digests are kept. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    places = places_of(n_shards, virtual_nodes)
    own = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _hash("doc_id", "text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    rows = checkpointed(own.withColumn("place", F.pmod("hash", F.lit(places)).cast("int")))

    counts = [0] * places
    for at, n in rows.groupBy("place").count().collect():  # a row a place at most
        counts[at] = n
    parts = {at: -(-n // part_rows) for at, n in enumerate(counts) if n > part_rows}
    before_part: dict[int, list[int]] = {}
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    if parts:
        hot = spark.createDataFrame(list(parts.items()), "place int, parts long")
        part = F.coalesce(F.pmod("number", "parts"), F.lit(0)).cast("long")
        rows = rows.drop("part").join(F.broadcast(hot), "place", "left").withColumn("part", part)
        # a row for every part_rows rows of all, at most, and one for each place
        sizes = {(r["place"], r["part"]): r["count"] for r in rows.where("parts IS NOT NULL").groupBy("place", "part").count().collect()}
        before_part = {at: [0, *accumulate(sizes.get((at, p), 0) for p in range(n - 1))] for at, n in parts.items()}
    nodes = ring(n_shards, virtual_nodes)
    ends = [at for at, _ in nodes]
    arc_of = [bisect_left(ends, at) % len(nodes) for at in range(places)]
    arcs, before = [0] * len(nodes), [0] * places
    for at, arc in enumerate(arc_of):
        before[at] = arcs[arc]
        arcs[arc] += counts[at]
    segments = assign_arcs(arcs, [shard for _, shard in nodes], capacities(sum(counts), n_shards, load))
    table = []
    for at, arc in enumerate(arc_of):
        if counts[at]:
            met = [s for s in segments[arc] if s[0] > before[at]]
            stop = next(i for i, s in enumerate(met) if s[0] >= before[at] + counts[at])
            table.append((at, [before[at] + n for n in before_part.get(at, [0])], met[: stop + 1]))

    over = Window.partitionBy("place", "part").orderBy("hash", "doc_id", "text_crc32", "size", "number")
    ranked = rows.withColumn("own_rank", F.row_number().over(over) - 1)
    joined = ranked.join(F.broadcast(spark.createDataFrame(table, PLACE)), "place")  # a row a place at most
    rank = F.get("before", F.col("part").cast("int")) + F.col("own_rank")
    segment = F.get(F.filter("segments", lambda s: s["until"] > F.col("rank")), F.lit(0))
    return (
        joined.withColumn("rank", rank)
        .withColumn("segment", segment)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("segment.shard").alias("shard"), (F.col("rank") + F.col("segment.shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
