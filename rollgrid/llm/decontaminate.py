"""Benchmark decontamination by SimHash of windows as large as the items.

Each benchmark item has a SimHash fingerprint of its weighted word shingles. A
document's windows of as many words as an item are fingerprinted with running
sums, so that each further window costs one subtraction. A multi-index of
Hamming blocks finds all items within the radius: two fingerprints at most
``radius`` bits apart agree up to ``radius // blocks`` bits on one of the blocks
at least, and the index lists each item under all block values that near. Each
candidate is then held against the item by its exact weighted-shingle
similarity.

A shingle weighs more the fewer items hold it, counted over the whole benchmark.
Windows that hold none of an item's rarest shingles, which make up over a fifth
of its weight, can't reach a similarity of 0.8 and are not fingerprinted for it;
no result depends on that. A benchmark of more items than a block is searched
for block by block, but only in those documents, found in one pass over all, that
hold one of the rarest shingles of some item.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.common import checkpointed, once, ship_code
from rollgrid.llm.topk import kth_largest

WORD = re.compile(r"\w+")
ROLL = np.uint64(0x9E3779B97F4A7C15)
#: Windows fingerprinted at a time, and items of a block.
CHUNK, BLOCK_ITEMS = 4096, 2000
#: Shingles of several items whose numbers of items are known, the most frequent ones; others count as of one item.
FREQUENT = 1 << 22
#: Bits of the table of rarest shingles that a document is looked up in first, and words whose hashes a worker remembers.
TABLE_BITS, MEMORY = 26, 300_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles_of(words: list[str], k: int) -> list[str]:
    """Shingles of k words; fewer words are one shingle, none are none."""
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


class HammingIndex:
    """Finds all fingerprints within a radius, by blocks that differ in few bits each."""

    def __init__(self, fingerprints: list[int], radius: int, blocks: int = 4) -> None:
        self.radius, self.blocks, self.width = radius, blocks, 64 // blocks
        if 64 % blocks:
            raise ValueError("blocks must divide 64")
        self.fingerprints = np.array(fingerprints, dtype=np.uint64)
        size = 1 << self.width
        flips = np.array([sum(1 << b for b in c) for n in range(radius // blocks + 1) for c in combinations(range(self.width), n)], dtype=np.int64)
        self.offsets: list[np.ndarray] = []
        self.items: list[np.ndarray] = []
        for block in range(blocks):
            own = ((self.fingerprints >> np.uint64(block * self.width)) & np.uint64(size - 1)).astype(np.int64)
            listed = (own[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(listed, kind="stable")
            self.items.append((order // len(flips)).astype(np.int32))
            self.offsets.append(np.searchsorted(listed[order], np.arange(size + 1)))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, fingerprint, distance of all pairs within the radius, in order."""
        found = []
        for block in range(self.blocks):
            parts = ((queries >> np.uint64(block * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            low, high = self.offsets[block][parts], self.offsets[block][parts + 1]
            n = high - low
            places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            query, item = np.repeat(np.arange(len(queries)), n), self.items[block][places]
            near = np.bitwise_count(queries[query] ^ self.fingerprints[item]) <= self.radius
            found.append(query[near] * max(1, len(self.fingerprints)) + item[near])
        pairs = np.unique(np.concatenate(found))
        query, item = np.divmod(pairs, max(1, len(self.fingerprints)))
        return query, item, np.bitwise_count(queries[query] ^ self.fingerprints[item])


class Weights:
    """Whole-number weights of shingles, so that sums are exact: more for those that fewer of total items hold."""

    def __init__(self, total: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        """hashes: sorted XXH64 of the shingles of several items; counts: how many items each."""
        self.hashes = np.append(hashes, np.uint64(2**64 - 1))
        told = [*counts.tolist(), 1]
        self.values = np.array([self._value(total, n) for n in told], dtype=np.int64)
        self.rare = self._value(total, 1)

    @staticmethod
    def _value(total: int, n: int) -> int:
        return max(1, round(16 * math.log2(1 + total / n)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], self.rare)


def hashes_of(shingles: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles), dtype=np.uint64, count=len(shingles))


def rarest(shingles: Counter, weights: dict[str, int], threshold: float) -> list[str]:
    """The rarest shingles of an item, as many as no window of the threshold's similarity can lack all of."""
    left = total = sum(n * weights[s] for s, n in shingles.items())
    out = []
    for s in sorted(shingles, key=lambda s: (-weights[s], s)):
        if left < threshold * total * (1 - 1e-9):
            break
        out.append(s)
        left -= shingles[s] * weights[s]
    return out


class Benchmark:
    """The items of one block, ready to be searched for; weights are the whole benchmark's."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: float, radius: int, weights: Weights) -> None:
        self.k, self.threshold, self.weights = k, threshold, weights
        held = [(i, words) for i, text in items if (words := words_of(text))]
        self.ids = [i for i, _ in held]
        self.lengths = [len(w) for _, w in held]
        self.shingles = [Counter(shingles_of(w, k)) for _, w in held]
        self.vocabulary: dict[str, int] = {}
        for _, words in held:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.by_shingle: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.sums, prints = [], []
        for item, (own, (_, words)) in enumerate(zip(self.shingles, held)):
            told = self._told(list(own))
            self.sums.append(sum(n * told[s] for s, n in own.items()))
            for s in rarest(own, told, threshold):
                ids = np.array([self.vocabulary[w] for w in s.split(" ")], dtype=np.uint64)
                self.by_shingle[len(ids)][int(rolled(ids, len(ids))[0])].append(item)
            prints.append(int(self._fingerprints([s for s, n in own.items() for _ in range(n)], [0], sum(own.values()))[0][0]))
        self.by_shingle = {w: dict(t) for w, t in self.by_shingle.items()}
        self.sorted_keys = {w: np.array(sorted(t), dtype=np.uint64) for w, t in self.by_shingle.items()}
        self.lengths_array = np.array(self.lengths, dtype=np.int64)
        self.index = HammingIndex(prints, radius)

    def _told(self, shingles: list[str]) -> dict[str, int]:
        return dict(zip(shingles, self.weights.of(hashes_of(shingles)).tolist()))

    def _fingerprints(self, shingles: list[str], starts: list[int], size: int) -> tuple[np.ndarray, dict[str, int]]:
        """Fingerprints of the runs of size shingles from each start, by running sums; and the shingles' weights."""
        hashes = hashes_of(shingles)
        weights = self.weights.of(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        sums = np.zeros((len(shingles) + 1, 64), dtype=np.int64)
        np.cumsum((2 * bits - 1) * weights[:, None], axis=0, out=sums[1:])
        at = np.array(starts)
        ones = sums[at + size] - sums[at] > 0
        return np.packbits(ones, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64).ravel(), dict(zip(shingles, weights.tolist()))

    def _hits(self, words: list[str]) -> dict[int, list[int]]:
        """Item to the words at which one of its rarest shingles begins."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        known = ids > 0
        out: dict[int, list[int]] = defaultdict(list)
        for width, table in self.by_shingle.items():
            n = len(words) - width + 1
            if n <= 0:
                continue
            run = known[:n].copy()
            for i in range(1, width):
                run &= known[i : i + n]
            places = np.flatnonzero(run)
            if not len(places):
                continue
            keys = rolled(ids, width)[places]
            sorted_keys = self.sorted_keys[width]
            found = sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys
            for place, key in zip(places[found].tolist(), keys[found].tolist()):
                for item in table[key]:
                    out[item].append(place)
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, words, distance, similarity): the best window for each item found."""
        words = words_of(text)
        hits = self._hits(words) if words else {}
        if not hits:
            return []
        wanted: dict[int, set[int]] = defaultdict(set)
        for item, places in hits.items():
            length = self.lengths[item]
            size = max(1, length - self.k + 1)
            last = max(0, len(words) - length)
            for place in places:
                wanted[length].update(range(min(max(0, place - size + 1), last), min(place, last) + 1))
        best: dict[int, tuple[int, int, int, int, float]] = {}
        for length, starts in wanted.items():
            span = min(length, len(words))
            for group in _near_groups(sorted(starts), length):
                first = group[0]
                width = min(self.k, span)
                shingles = shingles_of(words[first : group[-1] + span], width)
                size = span - width + 1
                prints, told = self._fingerprints(shingles, [s - first for s in group], size)
                query, near, distances = self.index.search(prints)
                same = self.lengths_array[near] == length
                for q, item, distance in zip(query[same].tolist(), near[same].tolist(), distances[same].tolist()):
                    start = group[q]
                    similarity = self._similarity(Counter(shingles[start - first : start - first + size]), item, told)
                    if similarity >= self.threshold and (item not in best or (-similarity, start) < (-best[item][4], best[item][1])):
                        best[item] = (self.ids[item], start, span, distance, similarity)
        return [best[i] for i in sorted(best)]

    def _similarity(self, window: Counter, item: int, told: dict[str, int]) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        own = self.shingles[item]
        both = sum(min(n, own[s]) * told[s] for s, n in window.items() if s in own)
        all_of = sum(n * told[s] for s, n in window.items()) + self.sums[item] - both
        return both / all_of


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A key of each run of width ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    key = ids[:n].copy()
    for i in range(1, width):
        key = (key ^ (key >> np.uint64(31))) * ROLL + ids[i : i + n]
    return key


def _near_groups(starts: list[int], length: int) -> Iterator[list[int]]:
    """Sorted starts in runs whose windows touch, of at most CHUNK words each."""
    group: list[int] = []
    for s in starts:
        if group and (s - group[-1] > length or s - group[0] >= CHUNK):
            yield group
            group = []
        group.append(s)
    if group:
        yield group


def _items(benchmark: DataFrame, block_items: int) -> tuple[DataFrame, int]:
    """block, item_id, text: each item once, dealt to so many blocks by a digest of all of it; and the number of blocks."""
    items = benchmark.select(F.col("item_id").try_cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    items = checkpointed(items)
    n = -(-items.count() // block_items)
    return items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))).alias("block"), "item_id", "text"), n


def _frequencies(items: DataFrame, k: int, frequent: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """What Weights takes, of all items: those with words, and how many hold a shingle, for shingles of several.

    Of more than frequent such shingles only the most frequent are told; those that
    tie for the last places are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(hashes_of(shingles_of(words_of(text.as_py()), k))).view(np.int64) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64()))], ["shingles"])

    held = checkpointed(items.select("text").mapInArrow(run, "shingles array<long>"))
    counts = checkpointed(held.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
    least = kth_largest(counts, "n", frequent)
    if counts.where(F.col("n") >= least).count() > frequent:
        least += 1
    told = counts.where(F.col("n") >= F.lit(least)).toArrow()  # at most `frequent` rows of two numbers
    hashes, n = told.column("s").to_numpy().view(np.uint64), told.column("n").to_numpy()
    order = np.argsort(hashes)
    return held.where(F.size("shingles") > 0).count(), hashes[order], n[order]


def _block(items: DataFrame, block: int) -> list[tuple[int, str]]:
    return [tuple(r) for r in items.where(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()]  # about block_items rows


def _word_hashes(words: list[str]) -> np.ndarray:
    known = once("benchmark words/hashes", dict)
    if len(known) > MEMORY:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _table(items: DataFrame, weighed, k: int, threshold: float) -> tuple[np.ndarray, list[int]]:
    """A bit for each value of TABLE_BITS bits that the key of an item's rarest shingle has, and the widths of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*weighed.value)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                own = Counter(shingles_of(words_of(text.as_py()), k))
                told = dict(zip(own, weights.of(hashes_of(list(own))).tolist()))
                for words in (s.split(" ") for s in rarest(own, told, threshold)):
                    found.append((int(rolled(_word_hashes(words), len(words))[0]) >> (64 - TABLE_BITS), len(words)))
            at, width = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(width, pa.int32())], ["at", "width"])

    keys = checkpointed(items.select("text").mapInArrow(run, "at long, width int").distinct())
    widths = sorted(r["width"] for r in keys.select("width").distinct().collect())  # k rows at most
    bits = np.zeros(1 << TABLE_BITS, dtype=bool)
    bits[keys.select("at").distinct().toArrow().column("at").to_numpy()] = True  # 2**TABLE_BITS rows at most
    return np.packbits(bits), widths


def _maybe_udf(sent, widths: list[int]):
    """Whether a text may hold one of the rarest shingles of some item: never wrongly false."""

    @F.pandas_udf("boolean")
    def maybe(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = sent.value
        for series in texts:
            out = []
            for text in series:
                ids = _word_hashes(words_of(text))
                at = np.concatenate([rolled(ids, w) for w in widths]) >> np.uint64(64 - TABLE_BITS)
                out.append(bool((table[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).any()))
            yield pd.Series(out, dtype="bool")

    return maybe


class _Search:
    """What find_contamination() and drop_contaminated() share: the blocks, their weights and the texts to search."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, k: int, threshold: float, radius: int, block_items: int) -> None:
        ship_code(docs.sparkSession)
        self.context, self.group = docs.sparkSession.sparkContext, uuid4()
        self.items, self.n = _items(benchmark, block_items)
        self.arguments = (k, threshold, radius)
        self.weighed = self.context.broadcast(_frequencies(self.items, k))  # FREQUENT pairs of numbers at most
        self.maybe = None
        if self.n > 1:
            table, widths = _table(self.items, self.weighed, k, threshold)
            self.maybe = _maybe_udf(self.context.broadcast(table), widths)  # 2**TABLE_BITS bits

    def index(self, block: int):
        """A function that gives the Benchmark of a block in a worker; about block_items items are sent along."""
        sent, weighed, arguments, key = self.context.broadcast(_block(self.items, block)), self.weighed, self.arguments, f"benchmark {self.group} {block}/index"
        return lambda: once(key, lambda: Benchmark(sent.value, *arguments, Weights(*weighed.value)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 19, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance, similarity: a row for each row of docs and item found in it.

    Words are runs of letters, digits and underscores in lower case; windows have
    as many words as the item, or all of a shorter text. The window given is the
    most similar one, the first of equals. Null and empty texts and items match
    nothing; repeated documents return each, repeated items once; items of fewer
    words than a shingle are one shingle. Very long texts are searched whole. Ids
    of items that are no whole numbers, and null ones, show as null. Other columns
    are not read. Empty tables give no rows. Results don't depend on block_items.
    """
    search = _Search(docs, benchmark, k, threshold, radius, block_items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word int, n_words int, distance int, similarity double"
    names = ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    if search.maybe:
        rows = checkpointed(rows.where(search.maybe("text")))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in range(search.n):
        index = search.index(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for hit in index().search(text.as_py())]
                columns = list(zip(*found)) if found else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        part = rows.mapInArrow(run, schema)
        out = part if search.n == 1 else out.unionByName(checkpointed(part))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 19, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs in which find_contamination() finds no item, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; very long texts are
    searched whole; without items all rows stay; an empty table gives no rows.
    """
    search = _Search(docs, benchmark, k, threshold, radius, block_items)
    text = F.col("row.text").cast("string")
    packed = docs.select(F.struct("*").alias("row"))
    if not search.maybe:
        return (packed.where(_clean_udf(search.index(0))(text)) if search.n else packed).select("row.*")
    told = packed.withColumn("maybe", search.maybe(text))
    left = checkpointed(told.where("maybe").select("row"))
    for block in range(search.n):
        left = checkpointed(left.where(_clean_udf(search.index(block))(text)))
    return told.where("NOT maybe").select("row").unionByName(left).select("row.*")


def _clean_udf(index):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([not index().search(x) for x in series], dtype="bool")

    return clean
