"""Quality by importance resampling: hashed n-gram models, their ratio, Gumbel top-k.

Two generative models draw hashed byte n-grams g one by one: one of the target
(labelled good and not toxic) with probabilities p_T(g), one of the raw text (all
documents) with p_R(g). The target's counts are smoothed by ``prior`` pseudo-counts
of the raw model. Where that leaves a log ratio within the deadband, the labelled
sample tells more of topic and language than of quality, and the target model backs
off to the raw one: the ratio is 1.

A document's importance weight is the ratio of its two likelihoods, a geometric mean
over its n-grams so that long texts aren't decided by their length:
log w = mean over g of log(p_T(g) / p_R(g)).

Documents are drawn without replacement in proportion to w ** sharpness by the
Gumbel top-k trick: the sampling key is sharpness * log w plus Gumbel noise, and
the k largest keys stay. k is the number of documents whose weight clears the
threshold that parts held-out good from bad labels best; sharpness is such that the
distance of the two medians is 1 / ``temperature`` units of noise.

Raw counts, weights, k and the k-th largest key are taken over all documents;
only the labelled sample is bounded (max_labelled).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.common import checkpointed, ship_code, text_key
from rollgrid.llm.topk import kth_largest

#: Fixed multipliers of the rolling hash and of its last mixing.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 20

TARGET, GOOD, BAD = 1, 2, 3


@dataclass(frozen=True)
class Settings:
    """max_labelled: labelled documents that train and calibrate, at most.

    held_out: one labelled document in so many calibrates the threshold. prior:
    pseudo-count of each n-gram in the target, as the raw text would have it.
    deadband: log ratios nearer to zero count as zero. temperature: scale of the
    Gumbel noise against the distance of good from bad.
    """

    sizes: tuple[int, ...] = (4, 5)
    bits: int = 20
    max_labelled: int = 20_000
    held_out: int = 4
    prior: float = 1.0
    deadband: float = 0.3
    temperature: float = 0.02
    seed: int = 7


def ngram_buckets(text: str | None, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, white space squeezed, in chunks that overlap by an n-gram."""
    raw = np.frombuffer((" " + " ".join((text or "").split()) + " ").encode("utf-8", "replace"), dtype=np.uint8)
    longest = max(sizes)
    for at in range(0, len(raw), CHUNK):
        for n in sizes:
            part = raw[at : min(at + CHUNK + n - 1, len(raw))].astype(np.uint64)
            if len(part) < n:
                continue
            h = part[: len(part) - n + 1].copy()
            for i in range(1, n):
                h = h * ROLL + part[i : len(part) - n + 1 + i]
            yield ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - bits)).astype(np.int64)
        if at + CHUNK + longest > len(raw) and at + CHUNK >= len(raw):
            return


def weight(text: str | None, ratios: np.ndarray, settings: Settings) -> float:
    """The mean log ratio over a text's n-grams; 0 for one without."""
    total, n = 0.0, 0
    for buckets in ngram_buckets(text, settings.sizes, settings.bits):
        total += float(ratios[buckets].sum(dtype=np.float64))
        n += len(buckets)
    return total / n if n else 0.0


def labelled_sample(labels: DataFrame, settings: Settings) -> DataFrame:
    """label_id, part: at most max_labelled rows, those with the least hash of doc_id.

    Repeated labels of a document count as its worst. Labels without an id or a
    quality are left out; a null toxic label counts as none.
    """
    worst = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    mixed = F.xxhash64("doc_id", F.lit(settings.seed))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    held = F.pmod(F.shiftright(mixed, 8), F.lit(settings.held_out)) == 0
    part = F.when(good & ~held, TARGET).when(good, GOOD).otherwise(BAD)
    chosen = worst.select(F.col("doc_id").alias("label_id"), part.cast("int").alias("part"), mixed.alias("mixed"))
    return checkpointed(chosen.orderBy("mixed", "label_id").limit(settings.max_labelled).select("label_id", "part"))


def _with_parts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left").drop("label_id")  # max_labelled rows


def count_ngrams(docs: DataFrame, sample: DataFrame, settings: Settings) -> DataFrame:
    """bucket, raw, target: counts of n-grams in all documents and in the target."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(1 << settings.bits, dtype=np.int64)
        target = np.zeros_like(raw)
        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text")):
                for buckets in ngram_buckets(text.as_py(), settings.sizes, settings.bits):
                    np.add.at(raw, buckets, 1)
                    if part == TARGET:
                        np.add.at(target, buckets, 1)
        found = np.flatnonzero(raw)
        for at in range(0, len(found), 50_000):
            own = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(raw[own]), pa.array(target[own])], ["bucket", "raw", "target"])

    rows = _with_parts(docs, sample).select("part", "text").mapInArrow(run, "bucket int, raw long, target long")
    return checkpointed(rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def log_ratios(counts: DataFrame, settings: Settings) -> np.ndarray:
    """Log ratio of target to raw by bucket; all zero if either is empty.

    Only buckets outside the deadband come to the driver, 2**bits at most.
    """
    ratios = np.zeros(1 << settings.bits, dtype=np.float32)
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if raw and target:
        expected = F.col("raw") * (target / raw)
        ratio = F.log((F.col("target") + settings.prior) / (expected + settings.prior))
        told = counts.select("bucket", ratio.cast("float").alias("ratio")).where(F.abs("ratio") >= settings.deadband).toArrow()
        ratios[told.column("bucket").to_numpy()] = told.column("ratio").to_numpy()
    return ratios


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Where the share of good below plus the share of bad above is least; -inf without either."""
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    cuts = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[int(np.argmin(lost + passed))])


@dataclass(frozen=True)
class Fitted:
    """ratios by bucket; weights scaled by sharpness, plus noise, stay from cut on."""

    settings: Settings
    ratios: np.ndarray
    sharpness: float
    cut: float


def _key(weight_column: str, sharpness: float, seed: int) -> Column:
    """The row's place in the sample: its scaled log weight plus Gumbel noise from its hash."""
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", F.lit(seed)), 11) + 0.5) / float(2**53)
    return F.col(weight_column) * F.lit(sharpness) - F.log(-F.log(uniform))


def _score(docs: DataFrame, sample: DataFrame, ratios: np.ndarray, settings: Settings) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(ratios)  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weight(x.as_py(), known.value, settings) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("part"), pa.array(found, pa.float64())], ["doc_id", "text_key", "part", "weight"])

    return _with_parts(docs, sample).mapInArrow(run, "doc_id long, text_key long, part int, weight double")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[Fitted, DataFrame]:
    """The fitted sampler, and doc_id, text_key, weight, sampling_key of every row of docs."""
    sample = labelled_sample(labels, settings)
    ratios = log_ratios(count_ngrams(docs, sample, settings), settings)
    scores = checkpointed(_score(docs, sample, ratios, settings))
    held = scores.where(F.col("part").isin(GOOD, BAD)).groupBy("doc_id").agg(F.min("weight").alias("weight"), F.min("part").alias("part")).select("weight", "part").toArrow()  # max_labelled rows
    weights, parts = held.column("weight").to_numpy(), held.column("part").to_numpy()
    good, bad = weights[parts == GOOD], weights[parts == BAD]
    threshold = best_threshold(good, bad)
    spread = abs(np.median(good) - np.median(bad)) if len(good) and len(bad) else 1.0
    sharpness = float(1 / (settings.temperature * spread)) if spread else 1.0
    keyed = scores.select("doc_id", "text_key", "weight", _key("weight", sharpness, settings.seed).alias("sampling_key"))
    k = scores.where(F.col("weight") >= F.lit(threshold)).count()
    return Fitted(settings, ratios, sharpness, kth_largest(keyed, "sampling_key", k)), keyed


def resample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, weight, sampling_key of the rows of docs (doc_id, text) that are sampled.

    A null or empty text has no n-grams and a log weight of 0. Rows that agree in
    doc_id and text are sampled together; ties at the last place all stay. Without
    good and bad labels nothing can be told apart, and all rows stay. Very long texts
    are weighed whole, a part at a time. Other columns are not read. Empty tables
    give none.
    """
    fitted, keyed = fit(docs, labels, settings)
    return keyed.where(F.col("sampling_key") >= F.lit(fitted.cut)).drop("text_key")


def keep_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that resample() takes, with all their columns, whatever their names.

    Nulls, empty and very long texts, ties and repeated rows are as resample() has them.
    Weights are computed once more rather than joined: a join would shuffle all texts.
    """
    fitted, _ = fit(docs, labels, settings)
    known = docs.sparkSession.sparkContext.broadcast(fitted.ratios)

    @F.pandas_udf("double")
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([weight(x, known.value, settings) for x in series], dtype="float64")

    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), weigh(F.col("text").cast("string")).alias("weight"))
    return packed.where(_key("weight", fitted.sharpness, settings.seed) >= F.lit(fitted.cut)).select("row.*")
