"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits space at the median of a random projection, over and over;
vectors close to a split go to both sides (spill), so that near ones seldom
part. The trees are fitted on a bounded sample and every vector is put through
them. Vectors are compared within leaves only; a pair that meets in several
leaves counts in the first of them. A leaf with very many vectors is split
again, by a tree fitted on a sample of its own, and so on. One whose vectors
don't come apart, as nearly all of them are alike, is compared in blocks of
bounded size, all against all, so nothing is capped. What leaves a block is one
row for each vector: its number of new links, and a link to the least vector it
hangs together with there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.common import checkpointed, once, ship_code
from rollgrid.llm.components import connected_components


#: Bytes of vectors that fit the first trees, at most, however wide they are.
SAMPLE_BYTES = 64 << 20
#: A leaf isn't split if a part would hold more than this share of it.
APART = 0.5


@dataclass(frozen=True)
class Settings:
    """leaf: vectors that a leaf should hold; sample: vectors that fit the trees, at most.

    leaf_sample: vectors of an oversized leaf, about, that fit the tree that splits it.

    spill: half the width of the band around a split whose vectors go both ways,
    in standard deviations of the projected difference of two vectors that are
    just similar enough. block: vectors of a leaf compared at a time.
    """

    threshold: float = 0.93
    trees: int = 6
    leaf: int = 256
    spill: float = 0.5
    sample: int = 20_000
    leaf_sample: int = 2048
    block: int = 1024
    seed: int = 11


def _options(random: np.random.Generator, size: int) -> np.ndarray:
    """Four random directions; a split takes the one along which its sample is widest."""
    options = random.normal(size=(4, size))
    return options / np.linalg.norm(options, axis=1, keepdims=True)


class Tree:
    """Splits as arrays: node i has children 2i + 1 and 2i + 2; leaves are numbered by path.

    A tree is told by its seed and, for each split, which option it took and where it cuts.
    """

    def __init__(self, size: int, band: float, seed: list[int], taken: np.ndarray, cuts: np.ndarray) -> None:
        random = np.random.default_rng(seed)
        self.depth, self.band, self.taken, self.cuts = len(cuts).bit_length(), band, taken, cuts
        self.directions = np.array([_options(random, size)[t] for t in taken], dtype=np.float32).reshape(-1, size)

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, band: float, seed: list[int]) -> Tree:
        random = np.random.default_rng(seed)
        taken, cuts = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
        held: dict[int, np.ndarray] = {0: sample}
        for node in range(2**depth - 1):
            points = held.pop(node)
            options = _options(random, sample.shape[1])
            at = points @ options.T if len(points) else np.zeros((1, 4))
            taken[node] = np.argmax(at.std(axis=0))
            along = points @ options[taken[node]].astype(np.float32).astype(np.float64) if len(points) else np.zeros(1)
            cuts[node] = np.median(along)
            if 2 * node + 2 < 2**depth - 1:
                held[2 * node + 1], held[2 * node + 2] = (points[along <= cuts[node]], points[along >= cuts[node]]) if len(points) else (points, points)
        return cls(sample.shape[1], band, seed, taken, cuts)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) for each leaf that each vector goes to."""
        rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
        for _ in range(self.depth):
            off = np.einsum("ij,ij->i", vectors[rows], self.directions[nodes], dtype=np.float64) - self.cuts[nodes]
            left, right = off <= self.band, off >= -self.band
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return rows, nodes - (2**self.depth - 1)


def band_of(settings: Settings, size: int) -> float:
    return float(settings.spill * np.sqrt(2 - 2 * settings.threshold) / np.sqrt(size))


class Forest:
    def __init__(self, sample: np.ndarray, depth: int, settings: Settings) -> None:
        self.trees = [Tree.fit(sample, depth, band_of(settings, sample.shape[1]), [settings.seed, t]) for t in range(settings.trees)]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) over all trees; a leaf's number tells its tree."""
        found = [tree.leaves(vectors) for tree in self.trees]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] + t * 2**tree.depth for t, (f, tree) in enumerate(zip(found, self.trees))])


def unit_vectors(column: pa.Array, size: int) -> np.ndarray:
    """Rows of length 1, from a list column without nulls, in double precision, however large or small they are."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True, initial=0)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _earlier_together(a: list[list[int]], b: list[list[int]], leaf: int) -> np.ndarray:
    """Whether row i of a and row j of b share a leaf before this one."""
    codes = {c: i for i, c in enumerate(sorted({c for own in a for c in own if c < leaf}))}

    def flags(rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), max(1, len(codes))), dtype=np.float32)
        for i, own in enumerate(rows):
            for c in own:
                if c in codes:
                    out[i, codes[c]] = 1
        return out

    return flags(a) @ flags(b).T > 0


def compare_block(ids: np.ndarray, halves: np.ndarray, copies: np.ndarray, vectors: np.ndarray, leaves: list[list[int]], leaf: int, diagonal: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, new links, least id it hangs together with, of the vectors that have new links.

    Of two blocks (halves 0 and 1) all pairs across are compared, of one block all
    pairs within. Links count the copies of the other vector.
    """
    first, second = (np.arange(len(ids)),) * 2 if diagonal else (np.flatnonzero(halves == 0), np.flatnonzero(halves == 1))
    if not len(first) or not len(second):
        return ids[:0], copies[:0], ids[:0]
    near = vectors[first] @ vectors[second].T >= threshold
    if diagonal:
        np.fill_diagonal(near, False)
    near &= ~_earlier_together([leaves[i] for i in first], [leaves[i] for i in second], leaf)
    links = np.zeros(len(ids), dtype=np.int64)
    links[first] += near @ copies[second]
    if not diagonal:
        links[second] += near.T @ copies[first]
    label = ids.copy()
    rows, columns = np.nonzero(near)
    a, b = first[rows], second[columns]
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (label == before).all():
            break
    linked = links > 0
    return ids[linked], links[linked], label[linked]


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows that can be linked: id and label there, all components finite, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)))


def embedding_components(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row of vectors (vec_id, embedding, label).

    Rows link if their labels and numbers of components are equal and their cosine
    is at least the threshold. Rows whose id, label or vector is null, or whose
    vector is empty, zero or holds a null or non-finite component, link with nothing
    and are their own component. Equal vectors are one node that counts its rows.
    Repeated rows link with each other and each return. An empty table gives none.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    key = [F.col("label"), F.size("embedding").alias("size"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2")]
    valid = _valid(vectors).select(*key, "vec_id", "embedding")
    nodes = checkpointed(valid.groupBy("label", "size", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))

    largest = nodes.groupBy("label", "size").count().groupBy("size").agg(F.max("count").alias("most")).collect()  # a row for each number of components
    parts, edges = [], []
    for size, most in sorted((r["size"], r["most"]) for r in largest):
        found = checkpointed(_links_of_size(nodes.where(F.col("size") == size), size, most, settings))
        parts.append(found.groupBy("node").agg(F.sum("links").alias("links")))
        edges.append(found.select("node", "least").where("node != least"))
    if parts:
        links, linked = parts[0], edges[0]
        for p, e in zip(parts[1:], edges[1:]):
            links, linked = links.unionByName(p), linked.unionByName(e)
    else:
        links, linked = spark.createDataFrame([], "node long, links long"), spark.createDataFrame([], "node long, least long")
    stars = connected_components(linked, "node", "least")
    told = nodes.select("label", "size", "h1", "h2", "node", "copies").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(stars, "node", "left")
    told = told.select("label", "size", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    members = valid.select("vec_id", "label", "size", "h1", "h2").join(told, ["label", "size", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone = vectors.where(F.col("vec_id").isNull() | F.col("label").isNull() | F.col("embedding").isNull() | ~finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return members.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _place(nodes: DataFrame, size: int, most: int, settings: Settings) -> DataFrame:
    """label_key, node, copies, embedding, leaves: every vector put through a forest fitted on a bounded sample."""
    spark = nodes.sparkSession
    fitting = max(16, min(settings.sample, SAMPLE_BYTES // (8 * size)))
    fitted = nodes.orderBy(F.xxhash64("h1", F.lit(settings.seed)), "node").limit(fitting).select("embedding").toArrow()  # SAMPLE_BYTES at most
    sample = unit_vectors(fitted.column("embedding").combine_chunks(), size)
    deepest = max(0, int(np.log2(max(1, len(sample) / 16))))
    depth = min(deepest, max(0, int(np.ceil(np.log2(most / settings.leaf)))))
    forest = spark.sparkContext.broadcast(Forest(sample, depth, settings))  # at most sample / 16 splits a tree
    key = f"forest {uuid4()}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = once(key, lambda: forest.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_vectors(batch.column("embedding"), size)
            rows, leaves = trees.leaves(unit)
            order = np.lexsort((leaves, rows))
            ends = np.cumsum(np.bincount(rows, minlength=len(unit)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(leaves[order]))
            yield pa.RecordBatch.from_arrays([batch.column("label_key"), batch.column("node"), batch.column("copies"), batch.column("embedding"), lists], ["label_key", "node", "copies", "embedding", "leaves"])

    keyed = nodes.select(F.col("label").cast("string").alias("label_key"), "node", "copies", "embedding")
    return checkpointed(keyed.mapInArrow(place, "label_key string, node long, copies long, embedding array<double>, leaves array<long>"))


def _leaf_sizes(placed: DataFrame) -> DataFrame:
    return placed.select("label_key", F.explode("leaves").alias("leaf")).groupBy("label_key", "leaf").count()


def _split(placed: DataFrame, large: DataFrame, size: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """placed with each large leaf (label_key, leaf, count) in the place of its parts, and those that don't come apart.

    Every large leaf gets a tree of its own, from a sample of its own vectors.
    """
    band = band_of(settings, size)
    held = placed.select("label_key", "node", "embedding", F.explode("leaves").alias("leaf")).join(large, ["label_key", "leaf"])
    drawn = F.pmod(F.xxhash64("node", "leaf", F.lit(settings.seed)), F.lit(1 << 30)) * F.col("count") < F.lit(settings.leaf_sample << 30)
    depth = max(1, int(np.log2(settings.leaf_sample / 16)))

    def seed(leaf: int) -> list[int]:
        return [settings.seed, leaf % 2**64]

    def fit(group: pa.Table) -> pa.Table:
        label, leaf = (group.column(c)[0].as_py() for c in ("label_key", "leaf"))
        sample = unit_vectors(group.column("embedding").combine_chunks(), size)
        tree = Tree.fit(sample, depth, band, seed(leaf))
        largest = np.bincount(tree.leaves(sample)[1]).max() / len(sample)
        apart = largest <= APART
        return pa.table({"label_key": pa.array([label], pa.string()), "leaf": pa.array([leaf], pa.int64()), "taken": pa.array([tree.taken if apart else None], pa.list_(pa.int64())), "cuts": pa.array([tree.cuts if apart else None], pa.list_(pa.float64()))})

    # about leaf_sample rows a group
    fitted = held.where(drawn).groupBy("label_key", "leaf").applyInArrow(fit, "label_key string, leaf long, taken array<long>, cuts array<double>")
    trees = checkpointed(large.select("label_key", "leaf").join(fitted, ["label_key", "leaf"], "left"))
    splits = trees.where("cuts IS NOT NULL")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], Tree] = {}
        for batch in batches:
            unit = unit_vectors(batch.column("embedding"), size)
            owners = list(zip(batch.column("label_key").to_pylist(), batch.column("leaf").to_pylist()))
            for owner in sorted(set(owners)):
                places = np.array([i for i, o in enumerate(owners) if o == owner])
                if owner not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[owner] = Tree(size, band, seed(owner[1]), *(np.array(batch.column(c)[int(places[0])].as_py()) for c in ("taken", "cuts")))
                rows, leaves = known[owner].leaves(unit[places])
                at = pa.array(places[rows])
                yield pa.RecordBatch.from_arrays([batch.column("label_key").take(at), batch.column("node").take(at), batch.column("leaf").take(at), pa.array(leaves)], ["label_key", "node", "leaf", "part"])

    parted = held.drop("count").join(splits, ["label_key", "leaf"]).mapInArrow(descend, "label_key string, node long, leaf long, part long")
    whole = placed.select("label_key", "node", F.explode("leaves").alias("leaf")).join(splits.select("label_key", "leaf"), ["label_key", "leaf"], "left_anti")
    # two leaves of one number are one leaf: more is compared then, never less
    every = parted.select("label_key", "node", F.xxhash64("leaf", "part").alias("leaf")).unionByName(whole.select("label_key", "node", "leaf"))
    lists = every.groupBy("label_key", "node").agg(F.collect_set("leaf").alias("leaves"))
    return checkpointed(placed.drop("leaves").join(lists, ["label_key", "node"])), trees.where("cuts IS NULL").select("label_key", "leaf")


def _links_of_size(nodes: DataFrame, size: int, most: int, settings: Settings) -> DataFrame:
    """node, links, least: new links of each vector in each leaf, among vectors of size components."""
    placed, solid = _place(nodes, size, most, settings), None
    while True:
        counts = _leaf_sizes(placed)
        large = counts.where(F.col("count") > settings.block)
        large = checkpointed(large if solid is None else large.join(solid, ["label_key", "leaf"], "left_anti"))
        if large.isEmpty():
            break
        placed, whole = _split(placed, large, size, settings)
        solid = checkpointed(whole if solid is None else solid.unionByName(whole))
    large = counts.where(F.col("count") > settings.block).select("label_key", "leaf", F.ceil(F.col("count") / settings.block).cast("int").alias("blocks"))
    rows = placed.select("*", F.explode("leaves").alias("leaf")).join(large, ["label_key", "leaf"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    dealt = rows.withColumn("pair", F.explode(F.coalesce(pairs, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
    dealt = dealt.select("label_key", "leaf", "pair.i", "pair.j", F.when(F.col("blocks").isNull(), 0).otherwise((own == F.col("pair.j")).cast("int")).alias("half"), "node", "copies", "embedding", "leaves")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        leaf, i, j = (group.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        unit = unit_vectors(group.column("embedding").combine_chunks(), size)
        ids, halves, copies = (group.column(c).to_numpy() for c in ("node", "half", "copies"))
        found = compare_block(ids, halves, copies, unit, group.column("leaves").to_pylist(), leaf, i == j, settings.threshold)
        return pa.table({"node": pa.array(found[0], pa.int64()), "links": pa.array(found[1], pa.int64()), "least": pa.array(found[2], pa.int64())})

    return dealt.groupBy("label_key", "leaf", "i", "j").applyInArrow(compare, "node long, links long, least long")
