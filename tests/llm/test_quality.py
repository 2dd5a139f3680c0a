import math
import random
import statistics
from collections import Counter

import numpy as np

from rollgrid.llm import quality
from tests.llm.helpers import no_docs, odd_docs

SMALL = quality.Settings(bits=14)


def _corpus(n=600):
    rng = random.Random(1)
    good = ["river", "stone", "garden", "window", "letter", "morning", "paper", "street"]
    bad = ["idiot", "scum", "trash", "moron"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(bad if toxic and rng.random() < 0.2 else good) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.resample(docs, marks, SMALL).collect()}
    unseen = [i for i, _ in rows if i % 2 == 0]
    assert np.mean([i in kept for i in unseen if i % 5]) > 0.97
    assert np.mean([i in kept for i in unseen if i % 5 == 0]) < 0.05
    again = quality.keep_quality(docs, marks, SMALL)
    assert again.columns == docs.columns and {r["doc_id"] for r in again.collect()} == kept


def test_chunks_do_not_change_ngrams(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500))
    whole = sorted(np.concatenate(list(quality.ngram_buckets(text, (4, 5), 16))).tolist())
    monkeypatch.setattr(quality, "CHUNK", 97)
    assert sorted(np.concatenate(list(quality.ngram_buckets(text, (4, 5), 16))).tolist()) == whole


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.0, rng.random(), -rng.random() * 100]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 7, 100, 333, 499):
        assert quality.kth_largest(df, "v", k, bins=8) == ordered[k - 1]
    assert quality.kth_largest(df, "v", 500) == -np.inf
    assert quality.kth_largest(df.limit(0), "v", 3) == -np.inf


def test_odd_rows(spark):
    marks = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 0), (5, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")
    kept = quality.keep_quality(odd_docs(spark), marks, SMALL)
    assert kept.columns == ["doc_id", "text", "fp", "row"]
    assert quality.resample(odd_docs(spark), marks.limit(0), SMALL).count() == 10
    assert quality.keep_quality(no_docs(spark), marks, SMALL).count() == 0


def test_weights_keys_and_k_equal_brute_force(spark):
    rows, labels = _corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    settings = quality.Settings(bits=12, temperature=0.5)
    part = {r["label_id"]: r["part"] for r in quality.labelled_sample(marks, settings).collect()}
    bags = {i: Counter(b for found in quality.ngram_buckets(t, settings.sizes, settings.bits) for b in found.tolist()) for i, t in rows}
    raw = sum(bags.values(), Counter())
    target = sum((bags[i] for i in bags if part.get(i) == quality.TARGET), Counter())
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + settings.prior) / (raw[b] * share + settings.prior)) for b in raw}
    ratio = {b: r if abs(r) >= settings.deadband else 0.0 for b, r in ratio.items()}
    weight = {i: sum(n * ratio[b] for b, n in bag.items()) / sum(bag.values()) for i, bag in bags.items()}
    good, bad = ([weight[i] for i, p in part.items() if p == wanted] for wanted in (quality.GOOD, quality.BAD))
    at = sorted({*good, *bad})
    cuts = [(a + b) / 2 for a, b in zip(at, at[1:])]
    cut = min(cuts, key=lambda c: (sum(g < c for g in good) / len(good) + sum(b >= c for b in bad) / len(bad), c))
    k = sum(w >= cut for w in weight.values())
    sharpness = 1 / (settings.temperature * abs(statistics.median(good) - statistics.median(bad)))
    noise = {r["doc_id"]: r["u"] for r in docs.selectExpr("doc_id", f"(shiftrightunsigned(xxhash64(doc_id, xxhash64(text), {settings.seed}), 11) + 0.5D) / {2**53}D AS u").collect()}
    key = {i: sharpness * w - math.log(-math.log(noise[i])) for i, w in weight.items()}
    fitted, keyed = quality.fit(docs, marks, settings)
    told = {r["doc_id"]: r for r in keyed.collect()}
    assert all(abs(told[i]["weight"] - weight[i]) < 1e-5 for i in weight)
    assert all(abs(told[i]["sampling_key"] - key[i]) < 1e-3 for i in key)
    kept = {r["doc_id"] for r in quality.resample(docs, marks, settings).collect()}
    assert kept == set(sorted(key, key=key.get, reverse=True)[:k]) and len(kept) == k
