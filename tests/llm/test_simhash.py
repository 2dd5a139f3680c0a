import random

import numpy as np
import xxhash

from rollgrid.llm import simhash
from tests.llm.helpers import ODD_DOCS, no_docs, odd_docs


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split(" ")
    words = [w for part in words for w in part.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc, _), c in zip(rows, label):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return prints, [least.get(c) for c in label]


def test_components_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for g in range(12):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(99)}"
            rows.append((len(rows) + 100, " ".join(own)))
    rows += [(r[0], r[1]) for r in ODD_DOCS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints, labels = brute(rows)
    got = simhash.simhash_components(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=d, f=f"{p:016x}", component_id=c)) for (d, _), p, c in zip(rows, prints, labels))


def test_near_dedup(spark):
    kept = simhash.near_dedup(odd_docs(spark))
    assert kept.columns == ["doc_id", "text", "fp", "row"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.near_dedup(no_docs(spark)).count() == 0


def test_near_dedup_takes_shingle_similarity(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(900)}" for _ in range(300)] for _ in range(8)]
    rows, group = [], {}
    for g, words in enumerate(base):
        for edits in (0, 1, 2, 3):
            own = list(words)
            for at in rng.sample(range(300), edits):
                own[at] = f"edit{rng.randrange(900)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    far = []
    for words in base:
        order = [words[i : i + 2] for i in range(0, 300, 2)]  # the same words in another order
        rng.shuffle(order)
        far += [" ".join(sum(order, [])), " ".join(words[:150] + [f"x{rng.randrange(900)}" for _ in range(150)])]
    rows += [(len(rows) + i, t) for i, t in enumerate(far)]
    kept = sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [i for i in group if i % 4 == 0] + list(range(len(group), len(rows)))


def groups_of(spark, texts):
    """Places of texts, by groups of near copies."""
    kept = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["id"]: r["component"] for r in kept}


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, words, places):
    own = list(words)
    for at in places:
        own[at] = f"e{rng.randrange(10**9)}"
    return " ".join(own)


def test_near_dedup_leaves_pairs_below_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(900)}" for _ in range(300)]
        texts += [" ".join(words), edited(rng, words, range(10, 80, 10))]  # 7 edits, 35 of 296 shingles: 0.789
    assert all(0.78 < similarity(texts[i], texts[i + 1]) < 0.8 for i in range(0, 80, 2))
    assert len(set(groups_of(spark, texts).values())) == 80


def test_near_dedup_finds_all_pairs_of_the_threshold(spark):
    rng = random.Random(6)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(300)]
        places = range(0, 160, 5) if i % 2 else range(10, 70, 10)
        texts += [" ".join(words), edited(rng, words, places if i % 2 == 0 else range(270, 300))]
    near = [similarity(texts[i], texts[i + 1]) >= 0.8 for i in range(0, 120, 2)]
    got = groups_of(spark, texts)
    assert all(near) and all(got[i] == got[i + 1] for i in range(0, 120, 2))
    assert len(set(got.values())) == 60


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        words = [f"v{rng.randrange(200)}" for _ in range(rng.randint(30, 200))]
        for _ in range(12):
            words = edited(rng, words, rng.sample(range(len(words)), rng.randrange(len(words) // 40 + 2))).split()
            texts.append(" ".join(words))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    got = groups_of(spark, texts)  # of equal texts the first stands for all
    assert len({(label[i], got[i]) for i in got}) == len(set(label)) == len(set(got.values())) > 6


def test_near_dedup_compares_all_texts_of_a_group(spark):
    """A text near the least one of its words, and near a text that the least one isn't near."""
    rng = random.Random(9)
    texts = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(300)]
        other = list(words)
        for at in (10, 30, 50):
            other[at], other[at + 10] = other[at + 10], other[at]
        head, t, u = " ".join(other), " ".join(words), edited(rng, words, range(100, 150, 10))
        assert similarity(head, t) >= 0.8 and similarity(t, u) >= 0.8 and similarity(head, u) < 0.7
        texts += [head, t, u]
    assert len(set(groups_of(spark, texts).values())) == 6


def test_long_chain_is_one_component(spark):
    from rollgrid.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_large_blocks_are_cut_further(spark):
    from rollgrid.llm.components import connected_components

    rng = random.Random(12)
    center = rng.getrandbits(64)
    prints = {center ^ sum(1 << b for b in rng.sample(range(14), rng.randrange(6))) ^ (rng.getrandbits(1) << 40) for _ in range(400)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    nodes = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(sorted(prints))]
    want = list(range(len(nodes)))
    for i, (_, a) in enumerate(nodes):
        for j in range(i):
            if ((a ^ nodes[j][1]) & (2**64 - 1)).bit_count() <= 3:
                want = [want[j] if x == want[i] else x for x in want]
    for most in (1024, 16):
        found = simhash.links(spark.createDataFrame(nodes, "id long, fp long"), most=most)
        edges = found.selectExpr("a.id AS a", "b.id AS b").cache()
        got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
        assert {(want[i], got.get(i, i)) for i, _ in nodes} == {(w, min(i for i, x in enumerate(want) if x == w)) for w in set(want)}
        if most == 1024:
            assert edges.count() <= 20 * len(nodes)  # not as many as a block has pairs


def test_hot_nodes_of_a_star(spark, monkeypatch):
    from rollgrid.llm import components

    monkeypatch.setattr(components, "STAR_EDGES", 10)
    edges = [(0, i) for i in range(1, 90)] + [(200, i) for i in range(80, 130)] + [(500, 501)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in [*range(130), 200]} | {500: 500, 501: 500}


def test_pairs_are_verified_without_a_set_for_each(spark):
    """All pairs of a family of texts: what is shuffled grows with the texts, not with their pairs."""
    import time

    rng = random.Random(14)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [edited(rng, words, rng.sample(range(1500), rng.randrange(8, 25))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").localCheckpoint()
    nodes = docs.selectExpr("doc_id AS g", "struct(doc_id AS id, xxhash64(text) AS key) AS node")
    sets = [simhash.shingle_set(t) for t in texts]
    extra = spark.createDataFrame([(i, len(k), *np.frombuffer(simhash.parities(k), dtype=">i8").tolist()) for i, k in enumerate(sets)], "g long, n long, " + ", ".join(f"{c} long" for c in simhash.PARITY))
    nodes = nodes.join(extra, "g").localCheckpoint()
    pairs = spark.createDataFrame([(i, j, len(sets[i]) + len(sets[j])) for j in range(60) for i in range(j)], "a long, b long, n long")
    want = {(i, j) for j in range(60) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8}

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        time.sleep(2)
        spark.range(1).count()
        context.listenerBus().waitUntilEmpty()
        held = context.statusStore().executorList(True)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        got = {tuple(r) for r in simhash._verified(pairs, nodes, docs, 5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == want and 200 < len(want) < 1770
    assert written() - before < 8_000_000


def test_pairs_go_through_joins_in_parts(spark, monkeypatch):
    """Of many pairs, each part is joined on its own: all are judged, each once."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(300)]
    sets = [simhash.shingle_set(edited(rng, words, rng.sample(range(300), 2 if i % 2 else 60))) for i in range(24)]
    nodes = spark.createDataFrame([(i, *np.frombuffer(simhash.parities(k), dtype=">i8").tolist()) for i, k in enumerate(sets)], "g long, " + ", ".join(f"{c} long" for c in simhash.PARITY))
    pairs = spark.createDataFrame([(i, j, len(sets[i]) + len(sets[j])) for j in range(24) for i in range(j)] * 2, "a long, b long, n long")
    found, names = [], []
    for most in (20_000_000, 50):
        monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", most)
        with simhash.scratch(spark) as keep:
            found.append(sorted(map(tuple, simhash._likely(lambda df, name: names.append(name) or keep(df, name), pairs, nodes).collect())))
    assert found[0] == found[1] and {(i, j) for j in range(1, 24, 2) for i in range(1, j, 2)} <= {(a, b) for a, b, _ in found[0]}
    assert len(found[0]) == len(set(found[0])) < 276 and len(names) == 1 + 6
