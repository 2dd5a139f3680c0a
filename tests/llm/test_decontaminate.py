import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rollgrid.llm import decontaminate as d
from tests.llm.helpers import no_docs, odd_docs


def _words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def brute(text, items, threshold=0.8, k=5):
    """item: (similarity, first word) of its best window, from the rule alone."""

    def words_of(t):
        return re.findall(r"\w+", (t or "").lower())

    def bag(words):
        return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))

    bags = {i: bag(words_of(t)) for i, t in items if words_of(t)}
    holders = Counter(s for own in bags.values() for s in own)

    def weigh(shingle):
        return max(1, round(16 * math.log2(1 + len(bags) / max(1, holders[shingle]))))

    words, out = words_of(text), {}
    for item, t in items:
        length = len(words_of(t))
        for start in range(max(1, len(words) - length + 1) if words and length else 0):
            window = bag(words[start : start + length])
            both, every = window & bags[item], window | bags[item]
            similarity = sum(n * weigh(s) for s, n in both.items()) / sum(n * weigh(s) for s, n in every.items())
            if similarity >= threshold and similarity > out.get(item, (0, 0))[0]:
                out[item] = (similarity, start)
    return out


def whole(items, k=5, threshold=0.8, radius=19):
    """All items as one block."""
    spread = Counter(s for _, t in items for s in set(d.shingles_of(d.words_of(t), k)))
    several = sorted((int(d.hashes_of([s])[0]), n) for s, n in spread.items() if n > 1)
    hashes, counts = (np.array([x[i] for x in several], dtype=t) for i, t in ((0, np.uint64), (1, np.int64)))
    return d.Benchmark(items, k, threshold, radius, d.Weights(sum(bool(d.words_of(t)) for _, t in items), hashes, counts))


def test_search_equals_brute_force():
    rng = random.Random(3)
    items = [(i, " ".join(_words(rng, rng.randint(6, 50)))) for i in range(30)] + [(90, "w1 w2 w3"), (91, ""), (92, None)]
    items += [(100 + i, items[i][1] + " " + " ".join(_words(rng, 9))) for i in range(8)]  # so that some shingles have several items
    bench = whole(items)
    for _ in range(60):
        words = _words(rng, rng.randint(0, 150))
        if rng.random() < 0.8:
            own = items[rng.randrange(30)][1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            if rng.random() < 0.3:
                own.insert(rng.randrange(len(own)), "added")
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        text = " ".join(words)
        found = {h[0]: (h[4], h[1]) for h in bench.search(text)}
        wanted = brute(text, items)
        assert found.keys() == wanted.keys()
        assert all(abs(found[i][0] - wanted[i][0]) < 1e-12 for i in found)


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    queries = prints.copy()
    for i in range(50):
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    q, i, dist = d.HammingIndex([int(x) for x in prints], 19).search(queries)
    all_of = np.bitwise_count(queries[:, None] ^ prints[None, :])
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(all_of <= 19))))


def test_operator(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, "lorem ipsum dolor sit amet lorem ipsum"), (3, None), (None, "")], "item_id long, text string")
    rows = d.find_contamination(odd_docs(spark), bench, block_items=2).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 1), (1, 1), (6, 2)]
    left = d.drop_contaminated(odd_docs(spark), bench)
    assert left.columns == ["doc_id", "text", "fp", "row"] and left.count() == 7
    assert d.find_contamination(no_docs(spark), bench).count() == 0
    assert d.find_contamination(odd_docs(spark), bench.limit(0)).count() == 0
    assert d.drop_contaminated(odd_docs(spark), bench.limit(0)).count() == 10


def test_blocks_of_items_do_not_change_results(spark):
    rng = random.Random(11)
    shared = _words(rng, 25)
    items = [(i, " ".join(shared + _words(rng, 25))) for i in range(12)] + [(None, "w1 w2 w3 w4 w5 w6"), (None, "w7 w8 w9")]
    docs = []
    for i, text in items[:12]:
        words = text.split()
        words[i % 5] = words[40 + i % 5] = "changed"
        docs.append((i, " ".join(words + _words(rng, 60) if i % 2 else _words(rng, 30) + words)))
    docs += [(50, "nothing of any item"), (51, None), (52, "x w7 w8 w9 y")]
    bench, texts = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = [sorted(map(str, d.find_contamination(texts, bench, threshold=0.5, radius=30, block_items=n).collect())) for n in (2000, 5, 1)]
    assert len(found[0]) >= 12 and found[0] == found[1] == found[2]
    want = {(doc, item): s for doc, t in docs for item, s in brute(t, [(i if i is not None else 1000 + len(t2), t2) for i, t2 in items], 0.5).items()}
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in d.find_contamination(texts, bench, threshold=0.5, radius=64, block_items=5).collect()}
    assert {k: v for k, v in got.items() if k[1] is not None}.keys() == {k for k in want if k[1] < 12}
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 for k in want if k[1] < 12)
    left = {r["doc_id"] for r in d.drop_contaminated(texts, bench, threshold=0.5, radius=30, block_items=5).collect()}
    assert left == {50, 51}


def test_blocks_must_divide():
    with pytest.raises(ValueError):
        d.HammingIndex([1], 3, 5)
