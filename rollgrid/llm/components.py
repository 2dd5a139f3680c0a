"""Connected components of an undirected graph, by alternating star joins.

Large-star links every neighbour above a node to the least node it knows;
small-star does so with the neighbours below. Both keep connectivity, and the
edges end as stars around the least node of each component, after a number of
rounds about logarithmic in the longest path. Nothing is collected: a round is
one aggregation (pre-aggregated before its shuffle) and one join, for which the
edges of a hot node, as the centre of a large star has, are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.common import checkpointed


#: Edges of a node that one task joins, about, and nodes with more of them, at most.
STAR_EDGES, HOT_NODES = 20_000, 100_000


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """a, b, m: m is the least b of all edges of a; n: how many edges there are at most.

    Edges of a node that has many are dealt by a digest of b to so many tasks as
    need be; its least one is sent to each of them.
    """
    if n <= STAR_EDGES:  # so no node has more
        return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a").select("a", "b", "m")
    edges = checkpointed(edges)
    least = checkpointed(edges.groupBy("a").agg(F.min("b").alias("m"), F.ceil(F.count("*") / max(STAR_EDGES, n // HOT_NODES)).alias("parts")))
    hot = F.broadcast(least.where("parts > 1").select("a", "parts"))  # HOT_NODES rows
    dealt = edges.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    spread = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(spread, ["a", "part"]).select("a", "b", "m")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    met = _with_least(edges.select(both.alias("e")).select("e.*"), 2 * n).withColumn("m", F.least("a", "m"))
    return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """edges: a > b, each once. Every lower neighbour of a, and a itself, goes to the least one."""
    moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return _with_least(edges, n).select(moved.alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component: the least node reachable, for every node of an edge.

    Nodes are integers, or structs of them without nulls; loops, repeated edges and either direction are fine, and
    edges with a null end are left out. No edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    now = checkpointed(now.distinct())
    seen, n = None, now.count()
    for _ in range(max_rounds):
        now = checkpointed(_small_star(_large_star(now, n), n))
        # two order-free digests of the edges; equal ones mean a fixed point
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen, n = tuple(mark), mark[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
