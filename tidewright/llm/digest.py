"""Document fingerprints: quartile bucket digest.

Every byte triplet within a window of five bytes is hashed into one of 256 buckets; the digest holds the text's length on
a log scale, the ratios of the bucket counts' quartiles, and two bits a bucket (the quartile its count falls into). Two
digests are compared by a bounded difference score: bucket bits (a jump over two quartiles costs more than two single
steps), length and quartile ratios, capped at `MOST`; likeness is 1 - difference / MOST.

Defined results: a null text counts as empty; an empty text, and one under three bytes, has no triplet and gets the
all-zero body; equal texts have equal digests; rows with an equal id are ordered by their text, null ids come last in
descending order; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import in_order, texts, written

BUCKETS = 256
#: Offsets, from a window's last byte, of the triplets it counts, with a salt each.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Cost of the distance between two bucket quartiles, by its absolute value.
STEP = np.array([0, 1, 2, 4], np.int64)
#: Differences at and above this count as wholly unlike.
MOST = 400
BLOCK = 1 << 16


def bucket_counts(text: bytes) -> np.ndarray:
    """How many of the text's triplets fall into each bucket. Works through whole texts, in blocks of bounded memory."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(text, np.uint8)
    for start in range(0, max(len(raw) - 2, 0), BLOCK):
        for salt, (i, j, k) in enumerate(TRIPLETS):
            # the k bytes before the block's first last-byte, so that windows over an edge count once
            own = raw[max(start + 2 - k, 0) : start + BLOCK + 2].astype(np.uint32)
            if len(own) <= k:
                continue
            n = len(own) - k
            x = own[k - i : k - i + n] | own[k - j : k - j + n] << 8 | own[:n] << 16
            x = (x + np.uint32(salt + 1) * np.uint32(0x01000193)) * np.uint32(0x9E3779B1)
            x ^= x >> 15
            x *= np.uint32(0x85EBCA6B)
            counts += np.bincount(x >> 24, minlength=BUCKETS)
    return counts


def digest(text: bytes) -> bytes:
    """Length, two quartile ratios, then the bucket quartiles, four a byte."""
    counts = bucket_counts(text)
    length = min(255, int(round(np.log1p(len(text)) * 12)))
    if not counts.any():
        return bytes([length, 0, 0]) + bytes(BUCKETS // 4)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    ratios = [int(min(255, 64 * int(q) // max(int(q3), 1))) for q in (q1, q2)]
    fours = codes.reshape(-1, 4)
    return bytes([length, *ratios]) + (fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6).astype(np.uint8).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """The score, before its bound: 0 for equal digests."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    apart = sum(int(STEP[np.abs((x[3:] >> s & 3) - (y[3:] >> s & 3))].sum()) for s in (0, 2, 4, 6))
    length = abs(int(x[0] - y[0]))
    return apart + max(0, length - 1) + int(np.abs(x[1:3] - y[1:3]).sum()) // 8


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 at a difference of MOST or more."""
    return 1.0 - min(difference(a, b), MOST) / MOST


def edited(text: bytes, following: bytes) -> str:
    """The text with its last third of code points replaced by as many of the next text's first."""
    own, other = text.decode("utf-8", "replace"), following.decode("utf-8", "replace")
    n = len(own) // 3
    return own[: len(own) - n] + other[:n]


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator: docs' key and `fingerprint` (hexadecimal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([digest(x).hex() for x in texts(batch.column(1))], pa.string())], names=[key, "fingerprint"])

    kept = docs.select(F.col(key), F.col(text).alias("text"))
    return kept.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fingerprint", T.StringType())]))


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [x.split()[0] for x in _COMPARED.split(", ")]
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(doc_id, text: bytes, own: bytes, following: bytes, theirs: bytes) -> tuple:
    mixed = edited(text, following).encode()
    changed = digest(mixed)
    return (doc_id, len(text.decode("utf-8", "replace")), hashlib.sha256(mixed).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, theirs))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, in descending doc_id.

    The texts move once, into ranges of doc_id; all but the last document of a range meet their next one there. The first and
    last of each range are written aside and meet by range number, so no task sees more than a range."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True

        def out(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            n, m = len(rows), len(edges)
            cols = [pa.array([*(r[i] for r in rows), *[None] * m], t) for i, t in enumerate(_ARROW)]
            if m:
                cols[0] = pa.array([*(r[0] for r in rows), *(e[1] for e in edges)], pa.int64())
            cols += [pa.array([*[None] * n, *(e[0] for e in edges)], pa.string()), pa.array([part] * (n + m), pa.int32()), pa.array([*[None] * n, *(e[2] for e in edges)], pa.binary())]
            return pa.record_batch(cols, names=[*_FIELDS, "edge", "part", "edge_text"])

        for batch in batches:
            rows, edges = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = digest(text)
                if first:
                    edges.append(("first", doc_id, text))
                    first = False
                else:
                    rows.append(_compare(*held, text, own))
                held = (doc_id, text, own)
            yield out(rows, edges)
        if held is not None:
            yield out([], [("last", held[0], held[1])])

    ranged = in_order(docs, order, ["doc_id", "text"])
    ran = written(ranged.mapInArrow(run, f"{_COMPARED}, edge string, part int, edge_text binary"), "digest")
    inner = ran.where("edge is null").select(*_FIELDS)
    firsts, lasts = (ran.where(F.col("edge") == e).select("doc_id", "part", "edge_text") for e in ("first", "last"))
    parts = sorted(r[0] for r in firsts.select("part").collect())  # one number a range
    if not parts:
        return inner
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    met = lasts.join(after, "part").join(firsts.select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text")), "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compare(i, a, digest(a), b, digest(b)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)], names=_FIELDS)

    return inner.unionByName(met.select("doc_id", "edge_text", "next_text").mapInArrow(close, _COMPARED))
