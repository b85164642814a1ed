"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and hashed to the
nearest signed axis. A table's code joins the axes of several such turns, the last of them over fewer axes, so that there are some
`SPACE` codes for each vector: codes grow longer with the table. `TABLES` tables are kept. A query looks into the likeliest buckets of
each (multiprobe: combinations of axes by how much nearness they give up), whose number grows with the root of the number of vectors.

Vectors and queries meet by equality: a vector is sent once a table, to the cell of its code's first axes, and a query to the cells of
its probes, with the codes it looks for there. In a cell the candidates found are compared in single precision, and each query's best
`KEPT` go on; the best of all its cells are ranked by their exact cosine in double precision, from the original vectors. Cells hold
some `CELL` vectors; one with more (many vectors alike) is dealt out, and so are its queries. A query that found fewer than k looks into
four times the buckets, until it has k or has seen all. Equal vectors are one entry, with the `k + 1` smallest ids of each, which is all a
result can show of them; so a vector that a third of all rows share costs one comparison.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
lengths never meet; a row with a null vec_id takes no part; rows that repeat a vec_id and its vector count once; a query with
fewer than k candidates gets them all; equal scores go to the smaller vec_id; further columns are ignored. Results do not depend on
how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import slots, written

TABLES, SPACE, PROBES, KEPT, SEED = 8, 2.5, 8.6, 4, 7
#: Vectors in a cell, and queries that meet them at once.
CELL, QUERIES = 65_536, 4096
#: Dimensions up to which a pseudo-rotation is cheaper as one matrix product than as its transforms.
DENSE = 128


def _hadamard(y: np.ndarray) -> np.ndarray:
    d, h = y.shape[1], 1
    while h < d:
        v = y.reshape(len(y), d // (2 * h), 2, h)
        y = np.concatenate([v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]], 2).reshape(len(y), d)
        h *= 2
    return y / np.sqrt(d)


def _rounds(y: np.ndarray, seed: int) -> np.ndarray:
    for s in np.random.default_rng([SEED, seed, y.shape[1]]).choice([-1.0, 1.0], (3, y.shape[1])):
        y = _hadamard(y * s)
    return y


@lru_cache(512)
def _matrix(d: int, seed: int) -> np.ndarray:
    """The pseudo-rotation of a short vector, as the one product that it comes to."""
    return _rounds(np.eye(d), seed)


def _padded(d: int) -> int:
    return 1 << max(0, d - 1).bit_length()


def turned(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of x, padded to a power of two, under the pseudo-rotation `seed`."""
    d = _padded(x.shape[1])
    if d <= DENSE:
        return x @ _matrix(d, seed)[: x.shape[1]]
    return _rounds(np.pad(x, ((0, 0), (0, d - x.shape[1]))), seed)


def axes(n: int, d: int) -> list[int]:
    """How many axes each turn is hashed to, for n vectors of d dimensions: all, but as few as do in the last."""
    d, out, codes_ = _padded(d), [], 1
    while codes_ < SPACE * n:
        more = d
        while more > 1 and codes_ * more >= SPACE * n:  # half as many axes are enough
            more //= 2
        out.append(more)
        codes_ *= 2 * more
    return out or [1]


def n_codes(shape: list[int]) -> int:
    return int(np.prod([2.0 * a for a in shape]))


def n_probes(n: int, shape: list[int], more: int = 1) -> int:
    return int(min(n_codes(shape), np.ceil(PROBES * more * n**0.5)))


def depth(n: int, shape: list[int]) -> int:
    """The turns that name a cell."""
    cells, k = 1, 0
    while cells * CELL < n and k < len(shape):
        cells, k = cells * 2 * shape[k], k + 1
    return k


def codes(x: np.ndarray, table: int, shape: list[int]) -> np.ndarray:
    """The bucket of each unit vector in a table."""
    code = np.zeros(len(x), np.int64)
    for r, a in enumerate(shape):
        y = turned(x, table << 8 | r)[:, :a]
        axis = np.abs(y).argmax(1)
        code = code * (2 * a) + axis + a * (np.take_along_axis(y, axis[:, None], 1)[:, 0] < 0)
    return code


def probes(x: np.ndarray, table: int, shape: list[int], n: int) -> np.ndarray:
    """The n buckets of a table likeliest to hold each unit vector's neighbours."""
    code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for r, a in enumerate(shape):
        y = turned(x, table << 8 | r)[:, :a]
        near = np.concatenate([y, -y], 1)
        best = np.argsort(-near, 1, kind="stable")[:, :n]
        value = np.take_along_axis(near, best, 1)
        # the i-th and j-th best can be among the n likeliest only if at most n pairs are as good in both
        i, j = np.nonzero(np.multiply.outer(np.arange(1, code.shape[1] + 1), np.arange(1, best.shape[1] + 1)) <= n)
        code = code[:, i] * (2 * a) + best[:, j]
        loss = loss[:, i] + ((value[:, :1] - value) ** 2)[:, j]
        keep = np.argsort(loss, 1, kind="stable")[:, :n]
        code, loss = np.take_along_axis(code, keep, 1), np.take_along_axis(loss, keep, 1)
    return code


def _sound(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, e in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is None or not e.is_valid or not len(e.values) or e.values.null_count:
            continue
        x = e.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
        if np.isfinite(x).all() and x.any():
            yield i, x.tobytes()


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """key, vec (binary, doubles) and ids, the k + 1 smallest of each distinct vector; key is the first. Tasks merge their own copies before
    the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vec", "ids"])

        for batch in batches:
            for i, vec in _sound(batch):
                own = held.setdefault(vec, [])
                if i not in own and (len(own) <= k or i < own[-1]):
                    held[vec] = sorted([*own, i])[: k + 1]
            if len(held) >= 50_000:
                yield out()
                held = {}
        yield out()

    merged = vectors.select("vec_id", "embedding").mapInArrow(run, "vec binary, ids array<long>").groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    merged = merged.select("vec", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"))
    # rows that repeat a vec_id with another vector: the pair names an entry
    return merged.withColumn("key", F.struct(F.col("ids")[0].alias("id"), F.xxhash64("vec").alias("hash")))


def _units(vecs: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to length 1; first by their largest component, so that no square is out of range."""
    x = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_CELL = ["bytes", "table", "cell"]
_ROW = "bytes int, table int, cell long, code long, id long, hash long, unit binary"
_ASK = "bytes int, table int, cell long, query_id long, qhash long, unit binary, codes binary"
_FOUND = "query_id long, qhash long, id long, hash long, near double"


def _sent(df: DataFrame, shapes: dict[int, tuple[int, list[int]]], tables: int, more: int) -> DataFrame:
    """Rows of df (vec, and two longs that name it) as cells get them: once a table, or with more > 0 as queries, by their probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                vecs, a, b = (batch.column(i).to_pylist() for i in range(3))
                for size, (n, shape) in shapes.items():
                    at = [i for i, v in enumerate(vecs) if len(v) == size]
                    if not at:
                        continue
                    units, tail = _units([vecs[i] for i in at]), n_codes(shape[depth(n, shape) :])
                    names, single = [np.array([x[i] for i in at], np.int64) for x in (a, b)], units.astype("<f4")
                    for t in range(tables):
                        if not more:
                            code = codes(units, t, shape)
                            yield pa.record_batch([np.full(len(at), size, np.int32), np.full(len(at), t, np.int32), code // tail, code, *names, pa.array([v.tobytes() for v in single], pa.binary())], names=[x.split()[0] for x in _ROW.split(", ")])
                            continue
                        wanted = np.sort(probes(units, t, shape, n_probes(n, shape, more)), 1)
                        cols: list[list] = [[] for _ in range(5)]
                        for i, row in enumerate(wanted):
                            cell, first = np.unique(row // tail, return_index=True)
                            for c, own in zip(cell.tolist(), np.split(row, first[1:]), strict=True):
                                for col, v in zip(cols, (c, names[0][i], names[1][i], single[i].tobytes(), own.astype("<i8").tobytes()), strict=True):
                                    col.append(v)
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                        yield pa.record_batch([np.full(len(cols[0]), size, np.int32), np.full(len(cols[0]), t, np.int32), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in _ASK.split(", ")])

    return df.mapInArrow(run, _ASK if more else _ROW)


def _search(keep: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            code, ids, hashes = (left.column(c).to_numpy() for c in ("code", "id", "hash"))
            order = np.lexsort((hashes, ids, code))
            code, ids, hashes = code[order], ids[order], hashes[order]
            units = np.frombuffer(b"".join(left.column("unit").to_pylist()), "<f4").reshape(len(code), -1)[order]
            for q, qh, unit, wanted in zip(*(right.column(c).to_pylist() for c in ("query_id", "qhash", "unit", "codes")), strict=True):
                wanted = np.frombuffer(wanted, "<i8")
                lo, hi = np.searchsorted(code, wanted, "left"), np.searchsorted(code, wanted, "right")
                size = hi - lo
                at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
                near = units[at] @ np.frombuffer(unit, "<f4")
                if len(at) > keep:  # all that tie with the last are looked at, the smaller ids stay
                    some = near >= np.partition(near, -keep)[-keep]
                    at, near = at[some], near[some]
                    first = np.lexsort((ids[at], -near))[:keep]
                    at, near = at[first], near[first]
                for col, v in zip(out, ([q] * len(at), [qh] * len(at), ids[at].tolist(), hashes[at].tolist(), near.tolist()), strict=True):
                    col += v
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, ids, vecs, qvecs = (batch.column(i).to_pylist() for i in range(4))
        scores = []
        for v, w in zip(vecs, qvecs, strict=True):
            x, y = np.frombuffer(v, "<f8"), np.frombuffer(w, "<f8")
            with np.errstate(all="ignore"):
                s = (x @ y) / (np.linalg.norm(x) * np.linalg.norm(y))
            scores.append(float(s if np.isfinite(s) else _units([v])[0] @ _units([w])[0]))  # products beyond the range of doubles
        yield pa.record_batch([pa.array(q, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.float64())], names=["query_id", "ids", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. vectors and queries: vec_id, embedding."""
    index = written(entries(vectors, k).select("key.*", "vec", "ids"), "entries")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_sound(batch))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["query_id", "vec"])

    asked = queries.select("vec_id", "embedding").mapInArrow(checked, "query_id long, vec binary").distinct()
    asked = written(asked.withColumn("qhash", F.xxhash64("vec")), "queries")
    sizes = index.groupBy(F.octet_length("vec").alias("bytes")).count().collect()  # a row a length of vectors
    shapes = {r[0]: (r[1], axes(r[1], r[0] // 8)) for r in sizes}
    rows = _sent(index.select("vec", "id", "hash"), shapes, tables, 0)
    crowds = written(rows.groupBy(*_CELL).count().where(F.col("count") > 2 * CELL).select(*_CELL, F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "crowds")
    salted = rows.join(crowds, _CELL, "left").withColumn("part", F.pmod("hash", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    best, more = None, 1
    while True:
        asks = written(_sent(asked.select("vec", "query_id", "qhash").repartition(slots(vectors.sparkSession)), shapes, tables, more), "asks")
        crowd = asks.groupBy(*_CELL).count().select(*_CELL, F.ceil(F.col("count") / QUERIES).cast("int").alias("turns")).where("turns > 1")
        crowd = written(crowd, "turns")
        dealt = asks.join(crowd, _CELL, "left").join(crowds, _CELL, "left").withColumns({"turn": F.pmod("query_id", F.coalesce("turns", F.lit(1))).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))}).drop("turns", "parts")
        met = salted.join(crowd, _CELL, "left").withColumn("turn", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1))).drop("turns")
        cell = [*_CELL, "part", "turn"]
        found = met.groupBy(*cell).cogroup(dealt.groupBy(*cell)).applyInArrow(_search(KEPT * (k + 1)), _FOUND)
        found = found.groupBy("query_id", "qhash", "id", "hash").agg(F.max("near").alias("near"))
        order = Window.partitionBy("query_id", "qhash").orderBy(F.desc("near"), "id")
        found = found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= KEPT * (k + 1))
        pairs = found.join(index, ["id", "hash"]).join(asked.withColumnRenamed("vec", "qvec"), ["query_id", "qhash"]).select("query_id", "ids", "vec", "qvec")
        scored = pairs.mapInArrow(_exact, "query_id long, ids array<long>, score double").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
        scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if all(n_probes(n, shape, more) >= n_codes(shape) for n, shape in shapes.values()):
            return ranked if best is None else best.unionByName(ranked)
        ranked = written(ranked, "nearest")
        full = ranked.where(F.col("rank") == k).select("query_id")
        ranked_full = ranked.join(full, "query_id", "left_semi")
        best = ranked_full if best is None else best.unionByName(ranked_full)
        asked = written(asked.join(full, "query_id", "left_anti"), "queries")
        if asked.isEmpty():
            return best
        more *= 4
