"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint is 64 bits; two link when they differ in `BITS` or fewer. Equal fingerprints meet first, by aggregation, so a
group of copies is one key from then on. The distinct keys are joined with themselves in binary tries: node pairs are walked
together from the roots down, differing bits add up on the way, and a pair is left as soon as its budget is spent.

To deal the walk out, the key's bits are cut into blocks, and tries are made with each choice of blocks in front: of any two
keys within the budget, one choice of blocks is equal in both (pigeonhole), so there the walk's pairs need only start from
equal prefixes. Those prefixes are the cells that are dealt out. More and longer prefixes are chosen as the number of keys
grows. A cell with more keys than `CELL` goes on as the node pairs some bits further down, each a cell of its own, until none
is too large: no cell's size is left to chance and no pair is lost. A task reports links as stars, one edge a key, and
components are found over those edges without any of them leaving the executors.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; rows of equal doc_id and text are
each returned; a row without doc_id is returned with the component of its fingerprint, null if no document with an id has
it, and links nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import slots, texts, written
from tidewright.llm.components import components

BITS, SHINGLE, SEED = 3, 3, 42
#: Keys above which a cell is split, and bits by which.
CELL, SPLIT = 2048, 6
#: Products of node sizes up to which a node pair is compared key by key.
LEAF = 64
#: Keys walked at once in a task.
CHUNK = 65_536

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The text's SimHash over its word shingles, repeats included."""
    from xxhash import xxh64_digest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return int.from_bytes(xxh64_digest(b" ".join(words), seed), "big")
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - width + 1].tolist()
    n = len(starts)
    hashed = np.frombuffer(b"".join([xxh64_digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]), np.uint8).reshape(n, 8)
    set_bits = np.concatenate([np.bincount(hashed[:, i], minlength=256) @ _BIT_OF for i in range(8)])
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `fp`, the fingerprint as a signed long, and the columns carried."""
    kept = docs.select("doc_id", "text", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, width, seed) for x in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carried])

    return kept.mapInArrow(run, kept.select("doc_id", F.lit(0).cast("long").alias("fp"), *carried).schema)


def _prefixes(n: int, bits: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Orders of (offset, width) blocks, and how many leading bits must be equal, for n keys: blocks choose (blocks - bits)."""
    for spare in range(1, 5):  # blocks in front
        blocks = bits + spare
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        parts = [(64 - edges[i + 1], edges[i + 1] - edges[i]) for i in range(blocks)]
        front = list(combinations(range(blocks), spare))
        if n >> min(sum(parts[i][1] for i in f) for f in front) <= 64 or spare == 4:
            return [([parts[i] for i in f] + [parts[i] for i in range(blocks) if i not in f], sum(parts[i][1] for i in f)) for f in front]
    raise AssertionError


def _arranged(fp: Column, order: list[tuple[int, int]]) -> Column:
    out, at = F.lit(0).cast("long"), 64
    for offset, width in order:
        at -= width
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
    return out


def _cells(keys: DataFrame, n: int, bits: int, most: int) -> DataFrame:
    """(trie, depth, a, b, key, node): every key in the cells where its links are found. a, b: the two prefixes, of depth bits."""
    tries = _prefixes(n, bits)
    rows = keys.select("node", F.explode(F.array(*(F.struct(F.lit(i).alias("trie"), F.lit(k).alias("depth"), _arranged(F.col("fp"), order).alias("key")) for i, (order, k) in enumerate(tries)))).alias("x")).select("node", "x.*")
    prefix = F.expr("shiftrightunsigned(key, 64 - depth)")
    cells = rows.select("trie", "depth", prefix.alias("a"), prefix.alias("b"), "key", "node")
    cell = ["trie", "depth", "a", "b"]
    while True:
        crowded = cells.where(F.col("depth") <= 64 - SPLIT).groupBy(*cell).count().where(F.col("count") > most).select(*cell)
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            return cells
        split = cells.join(crowded, cell, "left_semi")
        mine = F.expr(f"shiftrightunsigned(key, 64 - depth - {SPLIT}) & {(1 << SPLIT) - 1}")
        apart = F.expr("bit_count(a ^ b)")
        pairs = (
            split.withColumn("p", mine)
            .withColumn("on_a", F.expr("shiftrightunsigned(key, 64 - depth)") == F.col("a"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit((1 << SPLIT) - 1))))
            .where(apart + F.expr("bit_count(p ^ q)") <= bits)
        )
        deeper = lambda x, y: F.shiftleft(F.col(x), SPLIT).bitwiseOR(F.col(y))
        one, other = deeper("a", "p"), deeper("b", "q")
        pairs = pairs.select(
            "trie",
            (F.col("depth") + SPLIT).alias("depth"),
            F.when(F.col("a") == F.col("b"), F.least(one, other)).when(F.col("on_a"), one).otherwise(deeper("a", "q")).alias("a"),
            F.when(F.col("a") == F.col("b"), F.greatest(one, other)).when(F.col("on_a"), other).otherwise(deeper("b", "p")).alias("b"),
            "key",
            "node",
        )
        cells = written(cells.join(crowded, cell, "left_anti").unionByName(pairs), "cells")


def walk(keys: np.ndarray, pairs: np.ndarray, depth: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of keys within `bits`. keys: unsigned, sorted within each node; pairs: rows lo, hi, lo, hi, differing bits so
    far, of nodes at `depth` (a node with itself twice the same)."""
    left, right = [], []
    while len(pairs):
        n1, n2 = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        leaf = (n1 * n2 <= LEAF) | (depth >= 64)
        at = pairs[leaf]
        sizes = (n1 * n2)[leaf]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        first = 0
        while first < len(at):  # in pieces of bounded size
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 4_000_000, "right")) - 1)
            part, size = at[first:last], sizes[first:last]
            of = np.repeat(np.arange(len(part)), size)
            place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            wide = (part[:, 3] - part[:, 2])[of]
            i, j = part[of, 0] + place // wide, part[of, 2] + place % wide
            ok = (np.bitwise_count(keys[i] ^ keys[j]) <= bits) & (i < j)
            left.append(i[ok])
            right.append(j[ok])
            first = last
        pairs = pairs[~leaf]
        if not len(pairs):
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        lo1, hi1, lo2, hi2, err = pairs.T
        m1, m2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        other = lo1 != lo2
        below = [np.stack(x, 1) for x in ((lo1, m1, lo2, m2, err), (m1, hi1, m2, hi2, err), (lo1, m1, m2, hi2, err + 1))]
        below.append(np.stack((m1, hi1, lo2, m2, err + 1), 1)[other])
        pairs = np.concatenate(below)
        pairs = pairs[(pairs[:, 4] <= bits) & (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & ((pairs[:, 0] != pairs[:, 2]) | (pairs[:, 1] > pairs[:, 0] + 1))]
        depth += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n, over links i - j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    while (label[label] != label).any():
        label = label[label]
    return label


def links(keys: DataFrame, bits: int = BITS, most: int = CELL) -> DataFrame:
    """Edges (a, b) between nodes whose keys differ in `bits` or fewer: not every such pair, but enough to connect them.
    keys: node (long), fp (long), both distinct."""
    n = keys.count()
    cells = _cells(keys, n, bits, most)
    parts = max(slots(keys.sparkSession), n * 4 // 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        trie, depth, a, b, key, node = (rows.column(i).to_numpy() for i in range(6))
        a, b, key = a.view(np.uint64), b.view(np.uint64), key.view(np.uint64)
        order = np.lexsort((key, b, a, depth, trie))
        trie, depth, a, b, key, node = (x[order] for x in (trie, depth, a, b, key, node))
        new = np.concatenate([[True], (trie[1:] != trie[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(key))
        some = hi - lo > 1
        lo, hi = lo[some], hi[some]
        _, node_at = np.unique(node, return_inverse=True)
        i, j = [], []
        for d in np.unique(depth[lo]):
            at = depth[lo] == d
            starts, ends = lo[at], hi[at]
            bounds = np.cumsum(ends - starts)
            for g in np.split(np.arange(len(starts)), np.searchsorted(bounds, np.arange(CHUNK, bounds[-1], CHUNK))):
                if not len(g):
                    continue
                base, s, e = starts[g[0]], starts[g], ends[g]
                own = a[s] == b[s]
                on_a = np.concatenate([[0], np.cumsum(key[base : e[-1]] >> np.uint64(64 - d) == a[base : e[-1]])]) if d < 64 else np.zeros(e[-1] - base + 1, np.int64)
                mid = np.where(own, s, s + on_a[e - base] - on_a[s - base])
                err = np.bitwise_count(a[s] ^ b[s]).astype(np.int64)
                pairs = np.stack((s, np.where(own, e, mid), np.where(own, s, mid), e, err), 1) - np.array([base, base, base, base, 0])
                pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])]
                x, y = walk(key[base : e[-1]], pairs, int(d), bits)
                i.append(node_at[x + base])
                j.append(node_at[y + base])
        if not i:
            return
        names = np.unique(node)
        label = stars(len(names), np.concatenate(i), np.concatenate(j))
        moved = np.flatnonzero(label != np.arange(len(names)))
        yield pa.record_batch([pa.array(names[moved]), pa.array(names[label[moved]])], names=["a", "b"])

    dealt = cells.repartition(parts, "trie", "depth", "a", "b")
    return dealt.select("trie", "depth", "a", "b", "key", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = BITS, width: int = SHINGLE, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable over links; and the columns carried."""
    found = written(fingerprints(docs, width, seed, carried), "simhash")
    keys = written(found.groupBy("fp").agg(F.min("doc_id").alias("node")), "keys")
    of_node = components(links(keys.where("node is not null"), bits))
    classes = keys.join(of_node, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carried)
