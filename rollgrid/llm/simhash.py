"""SimHash near-dedup: pigeonhole blocks, a join on blocks, then the exact distance.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. To link all fingerprints at most ``radius`` bits apart, the 64 bits
are cut into ``blocks`` blocks; two such fingerprints differ in at most
``radius`` of them, so they agree on all of at least one choice of
``blocks - radius`` blocks. Each distinct fingerprint is therefore written once
for every such choice, joined on (choice, agreeing bits), and kept where the
distance holds. Copies of one fingerprint are one node from the start, so a
group of copies, however large, costs one row here.

``near_dedup`` links texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, all of them and no others. Fingerprints of those sets
that share a block and are within radius come first. They can't be all: at a
similarity of 0.8 about 10 of 64 bits differ, and no blocks that find so many have
enough bits left to part other texts. So the pairs that fingerprints miss are found
by prefix filtering, a pigeonhole on the sets themselves, which is complete: in any
order of all shingles, two such texts share one of the first fifth (and one more) of
each. An order with common shingles last makes few pairs. Bounds that no such pair
can miss thin them out, and the sets themselves decide on every pair.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.llm.common import NULL_ID_LAST, checkpointed, order_id, scratch, ship_code, text_key
from rollgrid.llm.components import connected_components

#: Shingles hashed at a time; bounds the memory for one very long text.
CHUNK = 50_000
#: Nodes of a block that are compared with each other, at most; free bits below which a block isn't cut further.
MOST, FREE_BITS = 256, 8
#: A pair counts as copies if its shingle sets have this similarity, as a fraction.
NEAR = (4, 5)
#: Of the texts, one in so many is counted for the order of shingles, and so many shingles
#: at most are put last. Both bear on the number of candidates only, never on the result.
SAMPLE, COMMON = 16, 100_000
#: Bits of the parities that bound the difference of two shingle sets from below.
PARITY_BITS = 512
#: Digests of texts to be read again that are sent to all executors; more of them are joined by a shuffle.
SENT_IDS = 1_000_000
#: Shingles and sets of a cell, about: sets that are verified in one place. Both bear on what is dealt out only.
CELL_SHINGLES, CELL_SETS = 1_000_000, 1_000
#: Pairs whose parities are joined to them at a time, about; bears on the disk in use only.
PAIRS_AT_ONCE = 20_000_000
ROLL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(words: list[bytes], words_per_shingle: int, digest: Callable[[bytes], bytes], bits: int) -> bytes:
    """The bits set in over half the digests of the shingles; zero without words, one shingle if there are too few."""
    if not words:
        return bytes(bits // 8)
    joined = b" ".join(words)
    k = min(words_per_shingle, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - k + 1], ends[k - 1 :]
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(joined[s:e]) for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64 bits; 0 for a text without words."""
    return int.from_bytes(majority(words_of(text), words_per_shingle, lambda s: xxhash.xxh64_digest(s, seed), 64), "big")


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles of a text, sorted, each once; one shingle if there are too few words, none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(words_per_shingle, len(words))
    n = len(words) - k + 1
    keys = ids[:n].copy()
    for i in range(1, k):
        keys = (keys ^ (keys >> np.uint64(31))) * ROLL + ids[i : i + n]
    keys = (keys ^ (keys >> np.uint64(32))) * ROLL
    return np.unique(keys ^ (keys >> np.uint64(29)))


def set_fingerprint(keys: np.ndarray) -> int:
    """The bits set in over half the keys; 0 without keys."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(keys), CHUNK):
        ones += np.unpackbits(keys[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(keys)).tobytes(), "little")


def prefix(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first keys of a set, as many as a set of similarity NEAR can't miss all of; those in common (sorted) come last."""
    n = len(keys)
    if not n:
        return keys
    last = np.zeros(n, dtype=bool)
    if len(common):
        last = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys
    return np.concatenate([keys[~last], keys[last]])[: n - -(-n * NEAR[0] // NEAR[1]) + 1]


def shared(keys: np.ndarray, others: np.ndarray) -> int:
    """How many keys two sets (sorted) have in common."""
    few, many = sorted((keys, others), key=len)
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()) if len(few) else 0


def parities(keys: np.ndarray) -> bytes:
    """Whether each of PARITY_BITS parts of all hashes holds an odd number of these; a key more or less changes one bit."""
    return np.packbits(np.bincount((keys % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_key, fp (signed 64 bits), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words_per_shingle, seed) for x in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def finer_masks(mask: int, radius: int, blocks: int) -> list[int]:
    """mask with each choice of all but radius blocks of the bits it leaves free; none if those are too few to cut."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= FREE_BITS or len(free) < blocks:
        return []
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    bits = [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return sorted({mask | sum(c) for c in combinations(bits, blocks - radius)})


def _hang_together(ids: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places a, b: each node but the least of its links' component within these, and that least one."""
    places = np.arange(len(ids))
    rank = np.empty_like(places)
    rank[np.lexsort((fps.view(np.int64), ids))] = places
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = rank
    while True:
        least = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (least == label).all():
            break
        label = least
    a = np.flatnonzero(label != rank)
    return a, np.argsort(rank)[label[a]]


def _compared(groups: DataFrame, radius: int) -> DataFrame:
    """a_id, a_fp, b_id, b_fp: links that join all nodes (arrays ids and fps of a row) as those within radius do."""
    names = ["a_id", "a_fp", "b_id", "b_fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("ids", "fps")]
            offsets = lists[0].offsets.to_numpy()
            ids, fps = (x.values.to_numpy() for x in lists)
            found = [np.zeros((4, 0), dtype=np.int64)]
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                a, b = _hang_together(ids[lo:hi], fps[lo:hi].view(np.uint64), radius)
                found.append(np.stack([ids[lo + a], fps[lo + a], ids[lo + b], fps[lo + b]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names)

    return groups.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def links(distinct: DataFrame, radius: int = 3, blocks: int = 6, most: int = MOST) -> DataFrame:
    """a, b: nodes (id, fp) that hang together by fingerprints at most radius bits apart, as many rows as a block has nodes at most.

    distinct: id, fp, each fingerprint once. Not every two such fingerprints are a row,
    but the components of the rows are those of all of them. A block of more than most
    nodes isn't compared: its free bits are cut into blocks in turn, in which two of its
    fingerprints within radius agree on all of a choice again, until few bits are left.
    So rows grow with the nodes, not with the pairs of a block.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below the number of blocks")
    spark = distinct.sparkSession
    masks, keyed, found = [0], distinct.select("id", "fp", F.lit(0).cast("long").alias("mask")), []
    while True:
        finer = {m: finer_masks(m, radius, blocks) for m in masks}
        table = spark.createDataFrame([(_signed(m), [_signed(x) for x in own]) for m, own in finer.items()], "mask long, masks array<long>")
        cut = keyed.join(F.broadcast(table), "mask").select("id", "fp", F.explode("masks").alias("mask"))  # rows by the bits' number only
        keyed = cut.select("id", "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
        if len(masks) > 1:
            keyed = keyed.distinct()
        masks = sorted({x for own in finer.values() for x in own})
        last = not any(finer_masks(m, radius, blocks) for m in masks)
        counts = checkpointed(keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"))
        small = counts if last else counts.where(F.col("n") <= most)
        members = keyed.join(small.select("mask", "part"), ["mask", "part"])
        groups = members.groupBy("mask", "part").agg(F.collect_list(F.struct("id", "fp")).alias("nodes"))  # at most `most`, or 2**FREE_BITS
        found.append(_compared(groups.select(F.col("nodes.id").alias("ids"), F.col("nodes.fp").alias("fps")), radius))
        large = counts.where(F.col("n") > most).select("mask", "part")
        if last or large.isEmpty():
            break
        keyed = keyed.join(large, ["mask", "part"]).select("id", "fp", "mask")
    near = reduce(DataFrame.unionByName, found)
    return near.select(F.struct(F.col("a_id").alias("id"), F.col("a_fp").alias("fp")).alias("a"), F.struct(F.col("b_id").alias("id"), F.col("b_fp").alias("fp")).alias("b"))


def simhash_components(docs: DataFrame, radius: int = 3, blocks: int = 6, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fp, component_id, label, for each row of docs (doc_id, text).

    component_id is the least doc_id reachable through links, a row's own
    included; null only if no row of its component has an id. label is the
    component's node of the least (doc_id, fingerprint), null ids last. Null texts
    count as texts without words (fingerprint 0, linked like any other); repeated
    rows each return; an empty table gives none.
    """
    rows = checkpointed(fingerprints(docs, words_per_shingle))
    nodes = rows.groupBy("fp").agg(F.min(order_id()).alias("id"))
    # a node carries the least id of its rows, so a component's least node names it
    stars = connected_components(links(nodes, radius, blocks), "a", "b")
    own = F.struct("id", "fp")
    by_fp = nodes.join(stars.select(F.col("node.fp").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component", own).alias("label"))
    by_fp = checkpointed(by_fp)  # so that both sides of the next join are dealt anew and hot fingerprints can be split
    component_id = F.when(F.col("label.id") != NULL_ID_LAST, F.col("label.id"))
    return rows.join(by_fp, "fp").select("doc_id", "text_key", "fp", component_id.alias("component_id"), "label")


PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]


def _common_shingles(docs: DataFrame, words_per_shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that several texts of a sample hold, the most frequent ones if there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), words_per_shingle).view(np.int64))], ["shingle"])

    sample = docs.where(F.pmod(text_key(), F.lit(SAMPLE)) == 0).select(F.col("text").cast("string").alias("text"))
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle")  # bounded, so that it can be sent to all
    return np.sort(top.toArrow().column("shingle").to_numpy().view(np.uint64))


def _prefixed(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """For each row id, key, the digest g of its shingle set, the set's size n, fingerprint, prefix and parities."""
    sent = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words_per_shingle))
    names = ["id", "key", "g", "n", "fp", "prefix", *PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, odd, sizes, prints, firsts = bytearray(), bytearray(), [], [], []
            for text in batch.column("text"):
                keys = shingle_set(text.as_py(), words_per_shingle)
                digests += xxhash.xxh64_digest(keys.tobytes())
                odd += parities(keys)
                sizes.append(len(keys))
                prints.append(set_fingerprint(keys))
                firsts.append(prefix(keys, sent.value).view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *firsts])))
            longs = np.frombuffer(bytes(odd), dtype=">i8").astype(np.int64).reshape(-1, len(PARITY))
            g = np.frombuffer(bytes(digests), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(g), pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), lists, *map(pa.array, longs.T)], names)

    rows = docs.select(order_id().alias("id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key long, g long, n long, fp long, prefix array<long>, " + ", ".join(f"{c} long" for c in PARITY))


def _free(docs: DataFrame) -> None:
    """Lets Spark delete the shuffle files of what has been written to the shared folder."""
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words_per_shingle: int) -> DataFrame:
    _free(docs)
    with scratch(docs.sparkSession) as keep:
        return _verified_with(keep, pairs, nodes, docs, words_per_shingle)


def _cells(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, id, key, cell: for each set of the pairs its least row, and a cell that it shares with most sets it is paired with.

    A label is the least set found within three steps. Labels of many sets or shingles
    are parted, so that a cell stays small. Any cells would do: they decide only how
    often a text is dealt out, once for each cell that holds a partner of it.
    """
    edges = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("g"), F.col(y).alias("other")) for x in "ab" for y in "ab"])).alias("e")).select("e.*")
    labels = edges.groupBy("g").agg(F.min("other").alias("label"))
    for _ in range(2):
        labels = edges.join(labels.toDF("other", "label"), "other").groupBy("g").agg(F.min("label").alias("label"))
    sized = labels.join(nodes.select("g", "n", "node"), "g")
    parts = F.ceil(F.greatest(F.sum("n") / CELL_SHINGLES, F.count("*") / CELL_SETS, F.lit(1.0))).alias("parts")
    cell = F.xxhash64("label", F.pmod(F.xxhash64("g"), F.col("parts"))).alias("cell")
    return sized.join(sized.groupBy("label").agg(parts), "label").select("g", "node.id", "node.key", cell)


def _likely(keep: Callable[[DataFrame, str], DataFrame], pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs a, b, n, each once, whose parities don't rule out the similarity NEAR.

    Pairs may grow faster than the texts, and with their parities each is some hundred
    bytes in two shuffles. So they are kept bare, and go through these joins in parts.
    """
    near, of = NEAR
    # each key that only one set holds changes one parity: sets that are near differ in few
    sides = [nodes.select(F.col("g").alias(side), *(F.col(c).alias(side + c) for c in PARITY)) for side in ("a", "b")]
    differ = reduce(add, [F.bit_count(F.col("a" + p).bitwiseXOR(F.col("b" + p))) for p in PARITY])
    kept = []
    with scratch(nodes.sparkSession) as keep_pairs:
        once = keep_pairs(pairs.distinct(), "pairs")
        _free(nodes)
        parts = 1 + once.count() // PAIRS_AT_ONCE
        for i in range(parts):
            held = once.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i).join(sides[0], "a").join(sides[1], "b")
            kept.append(keep(held.where(differ * (of + near) <= F.col("n") * (of - near)).select("a", "b", "n"), f"likely-{i}"))
            del held
            _free(nodes)
    return reduce(DataFrame.unionByName, kept)


def _verified_with(keep: Callable[[DataFrame, str], DataFrame], pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """Those pairs a, b of digests, of n keys in all, whose shingle sets have the similarity NEAR at least.

    No text is dealt out for each of its pairs: pairs are dealt by the cells of their
    sets, and a text goes to each of these places once, where its set is made.
    """
    near, of = NEAR
    likely = _likely(keep, pairs, nodes)
    cells = keep(_cells(likely, nodes), "cells")
    c, d = F.col("a_cell"), F.col("b_cell")
    met = likely
    for side in ("a", "b"):
        met = met.join(cells.select(F.col("g").alias(side), F.col("cell").alias(f"{side}_cell")), side)
    met = keep(met.select(F.least(c, d).alias("c"), F.greatest(c, d).alias("d"), "a", "b", "n"), "met")
    _free(docs)
    texts = docs.select(order_id().alias("row_id"), text_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    if cells.count() <= SENT_IDS:
        sent = F.broadcast(cells.select(F.xxhash64("id", "key").alias("sent")))
        texts = texts.join(sent, F.xxhash64("row_id", "row_key") == F.col("sent"), "left_semi")
    else:
        texts = texts.join(cells, (F.col("row_id") == F.col("id")) & (F.col("row_key") == F.col("key")), "left_semi")
    found = texts.groupBy("row_id", "row_key").agg(F.min("text").alias("text"))
    places = met.select(F.col("c").alias("to_c"), F.col("d").alias("to_d"), F.explode(F.array("a", "b")).alias("g")).distinct().join(cells, "g")
    dealt = places.join(found, (F.col("id") == F.col("row_id")) & (F.col("key") == F.col("row_key"))).select("to_c", "to_d", "g", "text")

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = {g.as_py(): shingle_set(text.as_py(), words_per_shingle) for g, text in zip(texts.column("g"), texts.column("text"))}
        ends = [pairs.column(x).to_pylist() for x in ("a", "b", "n")]
        alike = [(a, b) for a, b, n in zip(*ends) if (both := shared(sets[a], sets[b])) * of >= (n - both) * near]
        return pa.table({"a": pa.array([a for a, _ in alike], pa.int64()), "b": pa.array([b for _, b in alike], pa.int64())})

    return checkpointed(met.groupBy("c", "d").cogroup(dealt.groupBy("to_c", "to_d")).applyInArrow(run, "a long, b long"))


def _n(place: Column | str) -> Column:
    return F.shiftright(place, 32)


def _overlap(place: Column, other: Column) -> Column:
    """How many shingles two sets can have in common: as many as come before, at and behind the shared one of their prefixes."""
    at, other_at = place.bitwiseAND(F.lit(2**32 - 1)), other.bitwiseAND(F.lit(2**32 - 1))
    return F.least(at, other_at) + F.least(_n(place) - at, _n(other) - other_at)


def _able(place: Column, other: Column) -> Column:
    """Whether that is enough for the similarity NEAR."""
    near, of = NEAR
    return _overlap(place, other) * (of + near) >= (_n(place) + _n(other)) * near


def _with_ends(members: DataFrame, label: str) -> DataFrame:
    """members (block, g, place, label) of the blocks that hold two labels or more, with two of its rows each.

    low: the row of the least label; drawn: one drawn for the block.
    """
    members = members.repartition("block")  # so that no row is dealt with what the window makes of it
    block = Window.partitionBy("block")
    one = F.struct(*dict.fromkeys([label, "g", "place"]))
    drawn = F.min(F.struct(F.xxhash64(label, "block").alias("order"), one.alias("one"))).over(block)
    ends = members.select("*", F.min(one).over(block).alias("low"), drawn.alias("drawn"), F.max(label).over(block).alias("high"))
    columns = [F.col(f"{row}.{c}").alias(f"{end}_{c}") for end, row in (("low", "low"), ("drawn", "drawn.one")) for c in dict.fromkeys([label, "g", "place"])]
    return ends.where(F.col(f"low.{label}") != F.col("high")).select(*members.columns, *columns)


def _pair(g: Column, place: Column, other: Column, other_place: Column) -> list[Column]:
    return [F.least(g, other).alias("a"), F.greatest(g, other).alias("b"), (_n(place) + _n(other_place)).alias("n")]


def _likeliest(ends: DataFrame, label: str) -> DataFrame:
    """a, b, n: for each g, of the low and of the drawn rows of its blocks that have another label, the one it can have most in common with."""
    g, place = F.col("g"), F.col("place")
    best = []
    for end in ("low", "drawn"):
        other, other_place = F.col(f"{end}_g"), F.col(f"{end}_place")
        share = _overlap(place, other_place) / (_n(place) + _n(other_place))
        rows = F.when((F.col(label) != F.col(f"{end}_{label}")) & _able(place, other_place), F.struct(share.alias("share"), place.alias("place"), other.alias("g"), other_place.alias("other_place")))
        best.append(F.max(rows).alias(end))
    found = ends.groupBy("g").agg(*best)
    return reduce(DataFrame.unionByName, [found.where(F.col(e).isNotNull()).select(*_pair(g, F.col(f"{e}.place"), F.col(f"{e}.g"), F.col(f"{e}.other_place"))) for e in ("low", "drawn")])


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """a, b, n: sets of one fingerprint with the least of them, and of fingerprints that hang together, by pigeonhole blocks."""
    own = nodes.groupBy("fp").agg(F.min(F.struct("g", "n")).alias("least"))
    equal = nodes.join(own, "fp").where("g != least.g").select(F.least("g", "least.g").alias("a"), F.greatest("g", "least.g").alias("b"), (F.col("n") + F.col("least.n")).alias("n"))
    prints = checkpointed(own.select(F.col("least.g").alias("id"), "fp"))
    sizes = own.select(F.col("least.g").alias("id"), F.col("least.n").alias("n"))
    met = links(prints).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    near = met.join(sizes.toDF("a", "a_n"), "a").join(sizes.toDF("b", "b_n"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a_n") + F.col("b_n")).alias("n"))
    return equal.unionByName(near)


def near_groups(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """id, key, component: the least row (id, key) of each distinct shingle set, and a number for its group of near copies.

    Groups are the components of all pairs of sets of similarity NEAR. First come pairs
    of fingerprints within radius. A block, then, is the sets with one shingle in their
    prefix. Twice each set is held against the likeliest of two sets that stand for its
    blocks; then all pairs of a block, but only of those that are in two components by
    then. So a large group of different near copies makes about as many rows as it has
    sets.
    """
    spark = docs.sparkSession
    ship_code(spark)
    near, of = NEAR
    with scratch(spark) as keep:
        with scratch(spark) as keep_prefixes:
            rows = _prefixed(docs, words_per_shingle).groupBy("g", "n", "fp", *PARITY)
            nodes = keep_prefixes(rows.agg(F.min(F.struct("id", "key")).alias("node"), F.min("prefix").alias("prefix")), "nodes")
            _free(docs)
            placed = nodes.select("g", "n", F.posexplode("prefix").alias("at", "block"))
            placed = placed.select("block", "g", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("place"))
            ends = keep(_with_ends(placed, "g"), "ends")
            told = keep(nodes.select("g", "n", "fp", "node", *PARITY), "told")
            _free(docs)
        edges = _verified(_by_fingerprint(told).unionByName(_likeliest(ends, "g")), told, docs, words_per_shingle)

        def labelled(members: DataFrame) -> DataFrame:
            stars = connected_components(edges, "a", "b").toDF("g", "component")
            _free(docs)
            return members.select("block", "g", "place").join(stars, "g", "left").withColumn("component", F.coalesce("component", "g"))

        ends = keep(_with_ends(labelled(ends), "component"), "mixed")
        edges = checkpointed(edges.unionByName(_verified(_likeliest(ends, "component"), told, docs, words_per_shingle)))

        members = labelled(ends)
        block = Window.partitionBy("block")
        mixed = members.select("*", F.min("component").over(block).alias("low"), F.max("component").over(block).alias("high")).where("low != high").drop("low", "high")
        folded = [reduce(lambda x, y: x.bitwiseXOR(y), [F.col(p) for p in PARITY[i::4]]).alias(f"q{i}") for i in range(4)]
        still = keep(mixed.join(told.select("g", *folded), "g"), "still")
        left = still.select("block", *(F.col(c).alias("a_" + c) for c in still.columns if c != "block"))
        differ = reduce(add, [F.bit_count(F.col(f"a_q{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(4)])
        place, other = F.col("a_place"), F.col("place")
        likely = _able(place, other) & (differ * (of + near) <= (_n(place) + _n(other)) * (of - near))
        others = left.join(still, "block").where((F.col("a_component") < F.col("component")) & likely)
        between = _verified(others.select(*_pair(F.col("a_g"), place, F.col("g"), other)), told, docs, words_per_shingle)
        groups = connected_components(edges.unionByName(between), "a", "b").toDF("g", "component")
        return checkpointed(told.join(groups, "g", "left").select("node.id", "node.key", F.coalesce("component", "g").alias("component")))


def near_dedup(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """docs with one row for each group of near copies: its least (doc_id, text digest), null ids last.

    Groups are those of near_groups(). Texts without words are copies of
    each other; texts of fewer words than a shingle are one shingle, so that only
    equal ones are copies. Rows that agree in doc_id and text are one document, of
    which one row stays. All columns stay as they are; an empty table gives none.
    """
    groups = near_groups(docs, words_per_shingle)
    _free(docs)
    keep = groups.groupBy("component").agg(F.min(F.struct("id", "key")).alias("keep")).select("keep")
    packed = docs.select(F.struct("*").alias("row"), order_id().alias("row_id"), text_key().alias("row_key"))
    kept = packed.join(keep, (packed["row_id"] == keep["keep.id"]) & (packed["row_key"] == keep["keep.key"]), "left_semi")
    return kept.dropDuplicates(["row_id", "row_key"]).select("row.*")


def hex_fingerprint(fp: str = "fp"):
    """16 lower-case hex digits of a signed long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
