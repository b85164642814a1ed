"""Language ID by bit-sliced Bloom filters of byte n-grams.

One table of `SLOTS` slots serves all languages: bit l of a slot belongs to language l's filter. A lookup ands the slots of an
n-gram's `HASHES` hashes, and gives the mask of all languages that contain it, at once. A text's n-grams give a popcount a
language; each is corrected for the false positives its filter makes, known from how full it is, and the largest decides.
An n-gram is put into a language's filter if it is at least `SHARE` as frequent there as in the language where it is most
frequent. Filters are filled from at most `SAMPLE` training documents a language (all of them if there are fewer), drawn by a hash
of doc_id; every document is judged by its whole text.

Defined results: `und`, score 0, for a null text and one without a letter; a text none of whose n-grams is in a filter, and one
too short to have any, gets the language with the most training documents, score 0; ties go to the language first by code point;
without training documents all is `und`; a null lang or doc_id takes no part in training; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import fresh
from tidewright.llm.flat import BLOCK, LOWER, blocks, grams, sums

N, SLOTS, HASHES, SHARE, SAMPLE = 4, 1 << 20, 2, 0.2, 3000
#: n-grams that make up less than this of a language's are left out of its filter.
RARE = 2e-6
#: ASCII other than letters becomes a space.
_CLEAN = LOWER.copy()
_CLEAN[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[i for i in range(128) if chr(i).isalpha()]] = True
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def positions(found: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    """The slots of n-grams (of four bytes)."""
    shift = np.uint32(32 - (slots.bit_length() - 1))
    return [((found ^ (found >> np.uint32(15))) * odd) >> shift for odd in _ODD[:hashes]]


class Filters:
    """table: (words, slots) unsigned integers, bit l % width of word l // width being language l's."""

    def __init__(self, languages: list[str], prior: int, table: np.ndarray, hashes: int = HASHES):
        self.languages, self.prior, self.table, self.hashes = languages, prior, table, hashes
        self.width = table.dtype.itemsize * 8
        bits = np.array([np.count_nonzero(table[i // self.width] >> table.dtype.type(i % self.width) & table.dtype.type(1)) for i in range(len(languages))])
        #: How often a filter says yes to an n-gram it does not contain.
        self.false = np.minimum((bits / table.shape[1]) ** hashes, 0.999)

    def masks(self, found: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, as masks, by word."""
        at = positions(found, self.table.shape[1], self.hashes)
        out = self.table[:, at[0]]
        for p in at[1:]:
            out &= self.table[:, p]
        return out

    def counts(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and those in each language less its false positives."""
        clean = _CLEAN[raw]
        found = grams(clean, N)
        # spaces alone, and n-grams over the edge of a text, say nothing
        real = np.append(found, np.zeros(len(raw) - len(found), found.dtype)) != np.uint32(0x20202020)
        if len(found) < len(raw):
            real[len(found) :] = False
        over = (starts[1:, None] - np.arange(1, N)).ravel()
        real[over[over >= 0]] = False
        found = np.append(found, np.zeros(len(raw) - len(found), found.dtype))
        n = sums(real, starts)
        masks = self.masks(found) * real
        hits = np.stack([sums((masks[i // self.width] >> masks.dtype.type(i % self.width)) & masks.dtype.type(1), starts) for i in range(len(self.languages))], 1)
        return n, np.maximum(0.0, (hits - n[:, None] * self.false) / (1 - self.false))

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of its n-grams in that language, as far as no other language has more."""
        names, scores = [], []
        for _, raw, starts in blocks(column):
            letters = sums(_LETTER[raw], starts) > 0
            for i in np.flatnonzero(~letters).tolist():
                letters[i] = any(c.isalpha() for c in raw[starts[i] : starts[i + 1]].tobytes().decode("utf-8", "replace"))
            if not self.languages:
                names += ["und"] * len(letters)
                scores.append(np.zeros(len(letters)))
                continue
            n, counts = self.counts(raw, starts)
            best = counts.argmax(1)
            top = counts[np.arange(len(n)), best]
            best[top <= 0] = self.prior
            names += [self.languages[b] if has else "und" for b, has in zip(best.tolist(), letters.tolist(), strict=True)]
            scores.append(np.where(letters, np.clip(top / np.maximum(n, 1), 0, 1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def train(docs: DataFrame, sample: int = SAMPLE, slots: int = SLOTS, hashes: int = HASHES) -> Filters:
    """Filters from docs: text, lang, doc_id. Only the table, of a fixed size, and one row a language reach the driver."""
    known = docs.where("lang is not null and doc_id is not null")
    sizes = dict(sorted((r[0], r[1]) for r in known.groupBy("lang").count().collect()))
    languages = list(sizes)
    if not languages:
        return Filters([], 0, np.zeros((1, slots), np.uint8), hashes)
    number = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i)))
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n))))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_numpy()
            for language in np.unique(own).tolist():
                for _, raw, starts in blocks(batch.column(0).filter(pa.array(own == language)), 16 * BLOCK):
                    found = grams(_CLEAN[raw], N)
                    real = found != np.uint32(0x20202020)
                    over = (starts[1:, None] - np.arange(1, N)).ravel()  # those over the edge of a text
                    real[over[(over >= 0) & (over < len(found))]] = False
                    found, n = np.unique(found[real], return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(n), language), pa.int32()), pa.array(found.astype(np.int64)), pa.array(n)], names=["language", "gram", "n"])

    seen = known.where(drawn).select("text", number[F.col("lang")].alias("language")).mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).cache()
    totals = {r[0]: r[1] for r in seen.groupBy("language").agg(F.sum("n")).collect()}
    total = F.create_map(*(F.lit(x) for i, n in (totals or {0: 1}).items() for x in (i, float(n))))
    by_gram = seen.select("gram", F.struct((F.col("n") / total[F.col("language")]).alias("rate"), "language").alias("x")).groupBy("gram").agg(F.collect_list("x").alias("x"))
    width = 8 if len(languages) <= 8 else 64
    words = -(-len(languages) // width)
    kept = by_gram.select("gram", F.expr(f"filter(x, y -> y.rate >= {RARE} and y.rate >= {SHARE} * array_max(transform(x, z -> z.rate)))").alias("x")).select("gram", F.explode("x.language").alias("language"))

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(positions(batch.column(0).to_numpy().astype(np.uint32), slots, hashes)).astype(np.int64)
            language = np.tile(batch.column(1).to_numpy().astype(np.int64), hashes)
            yield pa.record_batch([pa.array(at), pa.array(language // width), pa.array(np.left_shift(np.int64(1), language % width))], names=["slot", "word", "mask"])

    filled = kept.mapInArrow(slot, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    seen.unpersist()
    table = np.zeros((words, slots), np.uint8 if width == 8 else np.uint64)
    table[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64).astype(table.dtype)
    return Filters(languages, int(np.argmax(list(sizes.values()))), table, hashes)


def predict(docs: DataFrame, filters: Filters, *columns: str | Column) -> DataFrame:
    """The given columns of docs (doc_id if none), lang_pred and score. The filters are broadcast: their size is fixed."""
    names = docs.select(*(columns or ("doc_id",))).columns
    judged = fresh("_judged", names)
    kept = docs.select(F.col("text").alias(judged), *(columns or ("doc_id",)))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = shared.value.judge(batch.column(0))
            yield pa.record_batch([*batch.columns[1:], pa.array(found, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, kept.drop(judged).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
