"""Quality by importance resampling.

Two generative models of hashed n-grams are counted, over runs of four bytes (`BUCKETS` hash buckets) and over runs of four words
by which of them repeat the word before (16 patterns): the target's, from at most `SAMPLE`
documents labelled good, and the raw corpus's, from every document. A document's importance weight is the ratio of the two likelihoods of
all its n-grams, at a temperature (1: as it is). Documents are sampled without replacement by Gumbel top-k: the k largest of log
weight plus Gumbel noise, the noise being a function of doc_id and seed. k is the number of documents at least as target-like as all but
`TAIL` of the labelled good documents held out of the target model. The ratio of a long document is far from 1 either way; for a filter
that treats short and long documents alike there is the mean log ratio an n-gram (`mean`), in which case the temperature is over n-grams.

Defined results: a null text counts as empty; texts under four bytes have log weight 0; without a good label every document is
kept; labels repeat harmlessly; equal keys at the k-th place are all kept, so k may be exceeded by repeated rows; a null doc_id
has noise like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import crc_mod, fresh, total, written
from tidewright.llm.flat import blocks, grams, words

N, BUCKETS, TEMPERATURE, TAIL, SEED = 4, 1 << 16, 1.0, 0.005, 11
#: Byte n-grams and patterns of repeated words.
ALL = BUCKETS + (1 << N)
#: n-grams of ratio 1 that each document is taken to have besides its own in its mean, so that a few do not decide.
PRIOR = 30
#: Labelled good documents the target model is counted from, at most; they are drawn by a hash of doc_id.
SAMPLE = 20_000
#: The remainder of crc32(doc_id) mod FOLDS that is held out of the target model.
FOLDS, HELD = 5, 0


def buckets(raw: np.ndarray) -> np.ndarray:
    return (grams(raw, N) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def repeats(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word's pattern (which of it and the three before repeat the word before them), and where texts start."""
    hashes, at = words(raw, starts)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    first = np.repeat(at[:-1], np.diff(at))
    place = np.arange(len(hashes)) - first
    same[place == 0] = 0
    out = same.copy()
    for back in range(1, N):
        out[back:] += (same[:-back] << back) * (place[back:] >= back)
    return BUCKETS + out, at


def _counts(docs: DataFrame) -> np.ndarray:
    """n-grams by bucket, of the documents and of those whose `target` is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, ALL), np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, raw, starts in blocks(batch.column(0)):
                found = buckets(raw)
                over = np.unique(starts[1:, None] - np.arange(1, N + 1))  # those that would reach past a text's end
                patterns, at = repeats(raw, starts)
                sums[0] += np.bincount(np.delete(found, over[(over >= 0) & (over < len(found))]), minlength=ALL) + np.bincount(patterns, minlength=ALL)
                for i in np.flatnonzero(good[first : first + len(starts) - 1]).tolist():
                    sums[1] += np.bincount(found[starts[i] : max(starts[i], starts[i + 1] - N)], minlength=ALL) + np.bincount(patterns[at[i] : at[i + 1]], minlength=ALL)
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], names=["counts"])

    return total(docs.mapInArrow(count, "counts binary"), "counts", 2 * ALL).reshape(2, ALL)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Of target to raw, by bucket, add-half smoothed. All zero without a target."""
    if not counts[1].any():
        return np.zeros(ALL)
    parts = [slice(0, BUCKETS), slice(BUCKETS, ALL)]  # a distribution each
    raw, target = (np.concatenate([np.log(c[p] + 0.5) - np.log((c[p] + 0.5).sum()) for p in parts]) for c in counts)
    return target - raw


def _weights(column: pa.Array, ratios: np.ndarray, temperature: float, mean: bool) -> np.ndarray:
    """Log weights of texts."""
    out = [np.zeros(0)]
    for _, raw, starts in blocks(column):
        found = np.append(ratios[buckets(raw)], np.zeros(N - 1))
        ends = np.maximum(starts[:-1], starts[1:] - N)
        whole = np.concatenate([[0.0], np.cumsum(found)])
        patterns, at = repeats(raw, starts)
        again = np.concatenate([[0.0], np.cumsum(ratios[patterns])])
        ratio = whole[ends] - whole[starts[:-1]] + again[at[1:]] - again[at[:-1]]
        out.append(ratio / (ends - starts[:-1] + PRIOR) if mean else ratio)
    return np.round(np.concatenate(out) / temperature, 6)  # equal texts weigh the same wherever they stand in a block


def gumbel(key: str, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """Exactly, by histograms of 1000 bins that close in on it; no row leaves the executors."""
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return lo
    while lo < hi:
        width = (hi - lo) / 1000
        at = F.least(F.floor((F.col(column) - lo) / width), F.lit(999))
        found = sorted(values.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect(), key=lambda r: -r[0])
        for _, n, least, most in found:
            if k <= n:
                lo, hi = least, most
                break
            k -= n
    return lo


def fit(docs: DataFrame, labels: DataFrame, seed: int = SEED, sample: int = SAMPLE, temperature: float = TEMPERATURE, mean: bool = False) -> tuple[np.ndarray, float, DataFrame]:
    """Log ratios by bucket, the k-th largest key, and every document's doc_id, log_weight and key. labels: doc_id, quality (1 for good)."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("held", crc_mod("doc_id", FOLDS) == HELD)
    target = good.where("not held").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select(F.col("doc_id").alias("_good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(target), F.col("doc_id") == F.col("_good"), "left")  # at most `sample` rows
    ratios = log_ratios(_counts(marked.select("text", F.col("_good").isNotNull().alias("target"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(1), pa.array(_weights(batch.column(0), ratios, temperature, mean))], names=["doc_id", "log_weight"])

    scored = docs.select("text", "doc_id").mapInArrow(run, "doc_id long, log_weight double")
    scored = written(scored.withColumn("key", F.col("log_weight") + gumbel("doc_id", seed)), "weights")
    known = scored.join(good, "doc_id").select("log_weight", "held")
    for fold in ("held", "true"):
        if (least := known.where(fold).agg(F.expr(f"percentile_approx(log_weight, {TAIL}, 100000)")).first()[0]) is not None:
            break
    if least is None:
        return ratios, float("-inf"), scored
    return ratios, kth_largest(scored, "key", scored.where(F.col("log_weight") >= least).count()), scored


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, sample: int = SAMPLE, temperature: float = TEMPERATURE, mean: bool = False) -> DataFrame:
    """doc_id, log_weight, key, kept for every document."""
    _, least, scored = fit(docs, labels, seed, sample, temperature, mean)
    return scored.withColumn("kept", F.col("key") >= least)


def keep(docs: DataFrame, labels: DataFrame, seed: int = SEED, sample: int = SAMPLE, temperature: float = TEMPERATURE, mean: bool = False) -> DataFrame:
    """The rows of docs that are sampled, with all their columns. Texts are weighed again on the way instead of being shuffled to
    their decisions."""
    ratios, least, _ = fit(docs, labels, seed, sample, temperature, mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _weights(batch.column(0), ratios, temperature, mean) + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(batch.columns[2:], schema=pa.schema(list(batch.schema)[2:])).filter(pa.array(key >= least))

    text, noise = (fresh(x, docs.columns) for x in ("_text", "_noise"))
    return docs.select(F.col("text").alias(text), gumbel("doc_id", seed).alias(noise), *docs.columns).mapInArrow(run, docs.schema)
