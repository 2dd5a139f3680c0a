import zlib
from collections import Counter

from rollgrid.llm import sharding
from tests.llm.helpers import ODD_DOCS, no_docs, odd_docs


def test_rows_law(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "repeat('é', cast(id % 7 AS int)) AS text")
    rows = sharding.shard_rows(docs, 16).collect()
    assert len(rows) == 1003
    by = Counter(r["shard"] for r in rows)
    assert len(by) == 16 and max(by.values()) - min(by.values()) <= 1
    for shard, n in by.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows[:20]:
        text = ("é" * (r["doc_id"] % 7)).encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)


def test_odd_rows(spark):
    rows = sharding.shard_rows(odd_docs(spark), 3).collect()
    assert len(rows) == len(ODD_DOCS)
    assert sorted(Counter(r["shard"] for r in rows).values()) == [3, 3, 4]
    assert sharding.shard_rows(no_docs(spark), 3).count() == 0


def test_overflow_goes_clockwise():
    counts, owners = [5, 1, 0, 2], [0, 1, 0, 2]
    got = sharding.assign_arcs(counts, owners, [3, 3, 2])
    assert got == [[(3, 0, 0), (5, 1, 1 - 3)], [(1, 1, 0)], [], [(2, 2, 0)]]


def test_growth_moves_few(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'' AS text")
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 16).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 17).collect()}
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert moved < 0.45  # placing by rank or modulo would move over 0.9
    loose_a = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 16, load=1.25).collect()}
    loose_b = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 17, load=1.25).collect()}
    assert sum(loose_a[i] != loose_b[i] for i in a) / len(a) < 0.25


def test_many_virtual_nodes_widen_the_ring():
    assert sharding.places_of(16) == sharding.PLACES and sharding.places_of(513) == 4 * sharding.PLACES
    nodes = sharding.ring(513)
    assert len(nodes) == len({at for at, _ in nodes}) == 513 * 128 and max(at for at, _ in nodes) < sharding.places_of(513)


def test_hot_place_is_ranked_in_parts(spark):
    docs = spark.range(900).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "'same' AS text")
    rows = sharding.shard_rows(docs, 5, part_rows=40).collect()
    assert len(rows) == 900 and Counter(r["doc_id"] for r in rows)[7] == 301
    by = Counter(r["shard"] for r in rows)
    assert sorted(by.values()) == [180] * 5
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in by.items())


def test_rows_walk_clockwise(spark):
    """Row by row: to the first shard with room, each arc's rows one node further a round."""
    docs = spark.range(700).selectExpr("id AS doc_id", "'t' AS text")
    hashes = sorted((r["h"] % sharding.PLACES, r["h"], r["doc_id"]) for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id AS string)) AS h").collect())
    nodes = sharding.ring(6, 16)
    arcs = [[] for _ in nodes]
    for place, _, doc in hashes:
        arcs[next((i for i, (at, _) in enumerate(nodes) if at >= place), 0)].append((place, doc))
    arcs[0].sort(key=lambda x: [p for p, _, _ in hashes].index(x[0]))
    room = {s: 700 // 6 + (s < 700 % 6) for s in range(6)}
    want = {}
    for step in range(len(nodes)):
        for i, rows in enumerate(arcs):
            shard = nodes[(i + step) % len(nodes)][1]
            for _, doc in rows:
                if doc not in want and room[shard]:
                    want[doc] = shard
                    room[shard] -= 1
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 6, virtual_nodes=16).collect()}
    assert got == want
