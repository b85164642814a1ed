"""Periodic runs of words: tiles by period octave, Z-functions at tile boundaries, fragments stitched by document and period.

A run of period q has words q apart identical over a stretch of at least max(24, 3q) words, and q is its smallest period. For the
octave of periods from S/2 up to S, boundaries stand every S words. The positions whose word equals the one q later form an
interval of at least S positions in such a run, so a boundary lies in it: at each, a Z-function of what follows and one of what
precedes (reversed) tell for every period of the octave how far its interval reaches either way, up to S. A tile is a stretch of
boundaries with S words before and 2S after, so tiles overlap and are solved apart, wherever they are dealt. Their fragments are
shuffled by document and period, where overlapping or touching ones are stitched.

Tiles are cut only where a run can be: S words have to repeat at a distance of the octave with no nearer repeat between, which every
run shows at each of its boundaries (a nearer one would give it a smaller period). Repeats are found exactly, by ranks of word
sequences of doubled length, and most documents have none beyond a few words.

Defined results: a null text counts as empty; a text without a run has an empty list and is its words joined by one space; repeated
rows, and rows whose id is null, are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewright.llm.common import slots, texts, written
from tidewright.llm.packed import pack, unpack

LEAST = 24
EXPONENT = 3
#: Words a tile's boundaries span, where the octave is shorter; words looked at together for repeats.
SPAN, TOGETHER = 512, 1 << 18


def z_function(x: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the start; the whole length at 0."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(right - i, 0)
            while i + k < n and x[k] == x[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def repeats(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """codes: words of documents laid end to end, alike only within a document; starts, ends: of each position's document. For each
    octave length S: the positions whose S words come next at a distance from S/2 up to S."""
    n = len(codes)
    rank = np.where(np.bincount(codes, minlength=1)[codes] > 1, codes, -1) if n else codes
    at, size = np.flatnonzero(rank >= 0), 1
    while len(at):
        at = at[at + 2 * size <= ends[at]]
        a, b = rank[at], rank[at + size]
        at, pair = at[b >= 0], (a * (n + 1) + b)[b >= 0]
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        same = pair[1:] == pair[:-1]
        if not same.any():
            return
        size *= 2
        apart = at[1:] - at[:-1]
        yield size, at[:-1][same & (apart >= size // 2) & (apart < size)]
        again = np.zeros(len(pair), bool)
        again[1:] |= same
        again[:-1] |= same
        rank = np.full(n, -1, np.int64)
        rank[at[again]] = np.concatenate([[0], np.cumsum(~same)])[again]
        at = np.sort(at[again])


def primitive(root: list[int]) -> bool:
    """Whether the root is no shorter sequence repeated."""
    n, z = len(root), z_function(root)
    return not any(n % q == 0 and z[q] == n - q for q in range(1, n // 2 + 1))


def fragments(words: list[int], octave: int, bounds: list[int]) -> dict[int, list[list[int]]]:
    """By period from octave / 2 up to octave, the intervals of positions equal to the one a period later, as far as `octave` from a
    boundary; overlapping and touching ones are one."""
    found: dict[int, list[list[int]]] = {}
    for c in bounds:
        ahead = z_function(words[c : c + 2 * octave])
        before = words[max(0, c - octave) : c][::-1]
        reach = min(octave, len(words) - c)
        behind = z_function([*before, -1, *words[c : c + reach][::-1], *before])
        base = len(before) + 1 + reach
        for q in range(octave // 2, min(octave, len(ahead))):
            f, b = min(ahead[q], octave), min(behind[base - q], octave) if q <= reach else 0
            if f + b < octave:
                continue
            have = found.setdefault(q, [])
            if have and c - b <= have[-1][1]:
                have[-1][1] = max(have[-1][1], c + f)
            elif primitive(words[c - b : c - b + q]):
                have.append([c - b, c + f])
    return {q: x for q, x in found.items() if x}


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words no run (start, length, period) has beyond its first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def _tiles(docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(document, octave, offset, packed words, packed boundaries from the offset) of each tile."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = [w for d in docs for w in d]
    place = {w: i for i, w in enumerate(set(flat))}
    plain = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
    last = np.cumsum(lengths)
    number = np.repeat(np.arange(len(docs)), lengths)
    starts, ends = np.repeat(last - lengths, lengths), np.repeat(last, lengths)
    codes = np.unique(number * (len(place) + 1) + plain, return_inverse=True)[1].reshape(-1)
    for octave, first in repeats(codes, starts, ends):
        bound = -(-(first - starts[first]) // octave) * octave
        span = max(SPAN, octave)
        keys = np.unique(np.stack([number[first], bound // span, bound]), axis=1)
        edges = np.flatnonzero(np.concatenate([[True], (keys[:2, 1:] != keys[:2, :-1]).any(axis=0), [True]])) if keys.shape[1] else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            doc, bounds = int(keys[0, i]), keys[2, i:j]
            offset, start = max(0, int(bounds[0]) - octave), int(last[doc] - lengths[doc])
            upto = min(int(lengths[doc]), int(bounds[-1]) + 2 * octave)
            own = np.unique(plain[start + offset : start + upto], return_inverse=True)[1].reshape(-1)
            yield doc, octave, offset, pack(own), pack(bounds - offset)


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "period", "length")]))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable | None = None, keep: Callable[[bytes], str] | None = None) -> DataFrame:
    """The operator: docs' key, `runs` (start, period and length, by start and period), `collapsed`: the text without what repeats.

    change: what to make of a key and its words before the search. keep: what to keep of a collapsed text, as a digest; the text itself
    by default."""
    keep = keep or (lambda x: x.decode("utf-8", "replace"))
    kind = docs.schema[key].dataType
    arrow_kind = to_arrow_type(kind)
    fields = [T.StructField("row", T.LongType()), T.StructField("key", kind), T.StructField("collapsed", T.StringType()), T.StructField("words", T.BinaryType()), T.StructField("octave", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("tile", T.BinaryType()), T.StructField("bounds", T.BinaryType())]
    arrow = [pa.int64(), arrow_kind, pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40

        def out(keys: list, held: list[list[bytes]]) -> pa.RecordBatch:
            tiles = list(_tiles(held))
            marked = {t[0] for t in tiles}
            rows = [(row + i, k, None, b" ".join(w), None, None, None, None) if i in marked else (row + i, k, keep(b" ".join(w)), None, None, None, None, None) for i, (k, w) in enumerate(zip(keys, held, strict=True))]
            rows += [(row + t[0], None, None, None, *t[1:]) for t in tiles]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=[f.name for f in fields])

        keys, held, size = [], [], 0
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = raw.split()
                keys.append(k)
                held.append(change(k, words) if change else words)
                size += len(words)
                if size >= TOGETHER or len(keys) >= 10_000:
                    yield out(keys, held)
                    row += len(keys)
                    keys, held, size = [], [], 0
        if keys:
            yield out(keys, held)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, octave, offset, tile, bounds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for q, found in fragments(unpack(tile).tolist(), octave, unpack(bounds).tolist()).items():
                    rows += [(row, q, offset + s, offset + t) for s, t in found]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["row", "period", "s", "t"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for raw, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = raw.split(b" ")
                kept.append(keep(b" ".join(collapsed(words, [(r["start"], r["length"], r["period"]) for r in runs]))))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(kept, pa.string())], names=[key, "runs", "collapsed"])

    scanned = written(docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(cut, T.StructType(fields)), "periods")
    tiles = scanned.where("octave is not null").select("row", "octave", "offset", "tile", "bounds")
    found = tiles.repartition(slots(docs.sparkSession), "row", "octave", "offset").mapInArrow(solve, "row long, period long, s long, t long")
    order = Window.partitionBy("row", "period").orderBy("s", "t")
    opened = F.coalesce(F.col("s") > F.max("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = found.withColumn("opens", opened.cast("int")).withColumn("island", F.sum("opens").over(order))
    stitched = islands.groupBy("row", "period", "island").agg(F.min("s").alias("start"), (F.max("t") - F.min("s") + F.col("period")).alias("length"))
    runs = stitched.where(F.col("length") >= F.greatest(F.lit(LEAST), EXPONENT * F.col("period"))).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast(RUNS)
    marked = scanned.where("words is not null").select("row", "key", "words").join(runs, "row", "left")
    closed = marked.select("key", "words", F.coalesce("runs", none).alias("runs")).mapInArrow(finish, T.StructType([T.StructField(key, kind), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]))
    plain = scanned.where("octave is null and words is null").select(F.col("key").alias(key), none.alias("runs"), "collapsed")
    return plain.unionByName(closed)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: a tenth of the documents, by their id, end in a repeated stretch."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns of find_runs(): counts, the run of greatest exponent, hashes of runs and of the collapsed text."""
    found = find_runs(docs, change=planted, keep=_sha256)
    greater = lambda best, x: F.when(best["length"].isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(RUNS.elementType), greater)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    topped = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return topped.select("doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
