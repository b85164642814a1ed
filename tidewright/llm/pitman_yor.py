"""LM scoring by a hierarchical Pitman-Yor model.

Words follow their context, the word before, in restaurants of a Chinese-restaurant process. Every context has its own restaurant,
keyed by its word's whole hash; all of them share one parent, the root restaurant, whose base is even over the known words and keeps
`UNKNOWN` of its mass for all others together. Customers of a context's restaurant are the words seen there; each of its tables is a
customer of the root. How many tables serve a word is sampled by Gibbs: the count of a word's tables in a restaurant is drawn from its
conditional, given all other tables and the root's probability, by generalised Stirling numbers: exact ones up to `EXACT` customers, their
limit beyond (the README has how near that comes). Restaurants sweep side by side and see each other's tables as of the sweep before. After `BURN` sweeps every sweep is a
sample; a word's probability is the mean of its predictive probabilities over the samples. Discounts are the ratio n1 / (n1 + 2 n2).

The corpus stays distributed. Pairs of context and word are dealt into buckets by context, so a restaurant lies in one place; a context
with more than a `SPLIT`-th of a bucket's tokens is dealt to several, by word (which these are is estimated from at most `SAMPLE_BYTES` of
text). A block of documents sends each bucket its distinct pairs with their training counts, packed. In each sweep a bucket seats its
restaurants, and sends the tables of each of its words to where that word's hash says; there they are summed, the word's root tables
are drawn, and both numbers come back. Tables of split contexts are summed in the same way. Draws depend on the pair, the seed and the sweep
alone: results do not change with how pairs are dealt, and any task can be repeated. To score, blocks send their pairs again, with the
documents they occur in, and get sums by document.

Defined results: a null or empty text is the end alone; A-Z is lowered, other letters are not; a row without doc_id is trained
on; without training documents every token is unknown and probabilities are 1 for the one outcome; rows repeat independently;
an empty table gives an empty result; further columns are ignored. Scores of equal texts are equal up to the order of sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import crc_mod, scratch, slots, total
from tidewright.llm.flat import blocks, mixed, words

STRENGTH, ROOT_STRENGTH, UNKNOWN = 1.0, 1.0, 0.5
SWEEPS, BURN, EXACT, SEED = 5, 2, 1024, 3
#: Remainder of crc32(doc_id) mod FOLDS that is not trained on.
FOLDS, HELD = 7, 2
#: Tokens, and documents, of a block; text bytes a bucket; what share of a bucket's tokens splits a context.
BLOCK_TOKENS, BLOCK_DOCS, BUCKET_BYTES, SPLIT = 500_000, 60_000, 12_000_000, 4
#: Text from which the shares of words are estimated, and how many of the most frequent are sent as numbers of two bytes. Only how pairs are
#: dealt and written depends on these.
SAMPLE_BYTES, COMMON = 32_000_000, 65_000
#: Files the buckets are written to, at most.
MOST_FILES = 20_000
END, START = np.uint64(0xFFFFFFFFFFFFFFFE), np.uint64(0xD1B54A32D192ED03)
_ROOT = np.uint64(0x9E3779B97F4A7C15)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, doc ids, held out, tokens a document, word hash, hash of the word before, document of each token). Columns: text, doc_id, held."""
    block = TaskContext.get().partitionId() << 32
    ids, held, parts, sizes, n = [], [], [], [], 0

    def out():
        counts = np.concatenate(sizes)
        w = np.concatenate(parts)
        before = np.concatenate([[START], w[:-1]])
        before[np.cumsum(counts) - counts] = START
        return block, ids, np.concatenate(held), counts, w, before, np.repeat(np.arange(len(ids), dtype=np.uint16), counts)

    for whole in batches:
        for batch in (whole.slice(i, 5000) for i in range(0, whole.num_rows, 5000)):
            own = batch.column(1).to_pylist()
            out_of = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, raw, starts in blocks(batch.column(0)):
                h, at = words(raw, starts)
                parts.append(np.insert(h, at[1:], END))
                sizes.append(np.diff(at) + 1)
                rows = slice(first, first + len(starts) - 1)
                ids = ids + own[rows]
                held.append(out_of[rows])
                n += len(parts[-1])
                if n >= BLOCK_TOKENS or len(ids) + 5000 > BLOCK_DOCS:
                    yield out()
                    block += 1
                    ids, held, parts, sizes, n = [], [], [], [], 0
    if ids:
        yield out()


@dataclass
class Dealing:
    """How pairs go to n buckets: by context, and those of a split context to `parts` consecutive ones by word. common: hashes that are
    written by their place among them."""

    n: int
    split: np.ndarray
    parts: np.ndarray
    common: np.ndarray

    def coded(self, hashes: np.ndarray) -> bytes:
        """How many there are, each one's place among the common ones or 65535, then the others in full."""
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        known = self.common[at] == hashes
        return len(hashes).to_bytes(8, "little") + np.where(known, at, 0xFFFF).astype("<u2").tobytes() + hashes[~known].astype("<u8").tobytes()

    def decoded(self, coded: bytes) -> np.ndarray:
        n = int.from_bytes(coded[:8], "little")
        at = np.frombuffer(coded, "<u2", n, 8)
        known, out = at != 0xFFFF, np.empty(n, np.uint64)
        out[known], out[~known] = self.common[at[known]], np.frombuffer(coded[8 + 2 * n :], "<u8")
        return out

    def bucket(self, ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
        n, own = np.uint64(self.n), (ctx % np.uint64(self.n))
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, ctx), len(self.split) - 1)
            own = own + np.where(self.split[at] == ctx, mixed(w) % self.parts[at], np.uint64(0))
        return (own % n).astype(np.int64)


def grouped(w: np.ndarray, ctx: np.ndarray, deal: Dealing):
    """Distinct pairs by (bucket, context, word), packed: for each bucket that has any, (bucket, contexts, pairs of each, words, first token,
    last token); and the order of tokens. The context of a token is the word before, or START."""
    found, of = np.unique(w, return_inverse=True)
    own = np.concatenate([np.zeros(1, np.int64), of[:-1]])
    own[ctx == START] = len(found)
    key = own * (len(found) + 1) + of
    bits = max(1, len(key) - 1).bit_length()
    if bits + int(key.max(initial=0)).bit_length() < 64:  # sorted with the places behind, which is faster
        key = np.sort(key << bits | np.arange(len(key)))
        at = key & ((1 << bits) - 1)
        key >>= bits
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    ends = np.append(first[1:], len(at)) if len(at) else first
    bucket = deal.bucket(ctx[at[first]], w[at[first]])
    order = np.argsort(bucket.astype(np.uint16) if deal.n <= 1 << 16 else bucket, kind="stable")
    sizes = (ends - first)[order]
    starts = np.cumsum(sizes) - sizes
    at = at[np.repeat(first[order] - starts, sizes) + np.arange(len(at))]
    bucket, pair_w, pair_ctx = bucket[order], w[at[starts]], ctx[at[starts]]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    rows = []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        new = np.flatnonzero(np.concatenate([[True], pair_ctx[x + 1 : y] != pair_ctx[x : y - 1]]))
        rows.append((int(bucket[x]), pair_ctx[x:y][new], np.diff(np.append(new, y - x)), pair_w[x:y], starts[x:y], int(starts[y - 1] + sizes[y - 1])))
    return rows, at


def _small(x: np.ndarray) -> bytes:
    """Counts, in the least of 1, 2, 4 or 8 bytes each, which comes first."""
    most = int(x.max(initial=0))
    width = next(b for b in (1, 2, 4, 8) if most < 1 << 8 * b)
    return bytes([width]) + np.asarray(x).astype(f"<u{width}").tobytes()


def _large(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _dumped(x) -> bytes:
    """Pickled and compressed: what moves lies on disk at both ends of a shuffle."""
    raw = pickle.dumps(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _loaded(x: bytes):
    return pickle.loads(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True))


def _set(numbers: np.ndarray) -> bytes:
    """Distinct numbers below 65536, ascending: as two bytes each or as bits, whichever is shorter. The first byte says which."""
    if 8 * 2 * len(numbers) <= int(numbers.max(initial=0)):
        return b"\0" + numbers.astype("<u2").tobytes()
    bits = np.zeros(int(numbers.max(initial=0)) + 1, bool)
    bits[numbers] = True
    return b"\1" + np.packbits(bits).tobytes()


def _members(x: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, offset=1))) if x[0] else np.frombuffer(x, "<u2", offset=1)


# --- seating


@lru_cache(4)
def _log_tables(d: float, most: int = EXACT) -> np.ndarray:
    """log of the chance that c customers of a restaurant without strength sit at t tables: generalised Stirling numbers, to scale."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1:2] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            stay = s[c, 1 : c + 2] + np.log(np.maximum(c - d * t[: c + 1], 0) / c)
            s[c + 1, 1 : c + 2] = np.logaddexp(stay, s[c, : c + 1] + np.log(d * (t[: c + 1] - 1) / c))
    return s


def log_tables(d: float, c: int, most: int) -> np.ndarray:
    """The same for t from 1 to most. Beyond `EXACT` customers t / c ** d has its limiting distribution, as at EXACT."""
    known = _log_tables(d)
    if c <= EXACT:
        return known[c, 1 : most + 1]
    row = known[EXACT, 1:]
    row = np.concatenate([[2 * row[0] - row[1]], row])
    at = np.arange(1, most + 1) * (EXACT / c) ** d
    return np.interp(at, np.arange(len(row)), row) + np.maximum(at - EXACT, 0) * (row[-1] - row[-2])


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1), a function of key and step."""
    x = mixed(key + mixed(np.full(1, step, np.uint64)))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def sample_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each word in its restaurant, given its customers c, the restaurant's other tables and the parent's probability. A draw
    depends on key and sweep. Without regard to c there would be 1 + a negative binomial number of tables, and there are never more:
    that says how far the chances must be looked at."""
    t, u = np.ones(len(c), np.int64), uniform(key, sweep)
    order = np.argsort(c, kind="stable")
    sizes, cuts = np.unique(c[order], return_index=True)
    for n, x, y in zip(sizes.tolist(), cuts, np.append(cuts, len(c))[1:], strict=True):
        if n < 2:
            continue
        at = order[x:y]
        r = strength / d + others[at]
        mean = (r + 1) * p[at] / (1 - p[at])
        most = int(min(n, (mean + 12 * np.sqrt(mean / (1 - p[at])) + 30).max()))
        prior, j = log_tables(d, n, most), np.arange(most)
        rows = max(1, 2_000_000 // most)
        for part in (slice(i, i + rows) for i in range(0, len(at), rows)):
            weight = prior + np.cumsum(np.log((r[part, None] + j) * p[at[part], None] / np.maximum(j, 1)), 1)
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            t[at[part]] = 1 + (weight < u[at[part], None] * weight[:, -1:]).sum(1)
    return t


@dataclass
class Model:
    """What all buckets share. history: customers and tables of the root before each sweep, and after the last."""

    d: float
    n: int
    v: int = 0
    root_d: float = 0.5
    history: list[tuple[int, int]] = field(default_factory=list)

    @staticmethod
    def ratio(n1: int, n2: int) -> float:
        return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5

    def base(self) -> float:
        """The root's base probability of a known word."""
        return (1 - UNKNOWN) / max(self.v, 1)

    def root(self, c: np.ndarray, t: np.ndarray, i: int) -> np.ndarray:
        """The root's probability of words with c customers at t tables there; without any, of the unknown."""
        if not self.v:
            return np.ones(len(c))
        customers, tables = self.history[i]
        rest = ROOT_STRENGTH + self.root_d * tables
        return np.where(c > 0, c - self.root_d * t + rest * self.base(), rest * UNKNOWN) / (ROOT_STRENGTH + customers)


class Bucket:
    """A bucket's contexts, their pairs with words, and the tables of pairs. Pairs are in order of context, then word. data: what stays;
    now: what sweeps change."""

    def __init__(self, data: bytes, now: bytes | None, deal: Dealing):
        d, self.data = pickle.loads(data), _loaded(now) if now else {"kept": []}
        self.words, self.contexts = deal.decoded(d["words"]), deal.decoded(d["contexts"])
        self.c, self.at = _large(d["counts"]), _large(d["at"])
        self.of = np.repeat(np.arange(len(self.contexts)), _large(d["pairs"]))
        self.split = _large(d["split"])  # contexts that have pairs elsewhere
        self.many = np.flatnonzero(self.c > 1)
        self.t = _large(self.data["t"]) if "t" in self.data else np.ones(len(self.many), np.int64)

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Of every pair."""
        out = (self.c > 0).astype(np.int64)
        out[self.many] = t
        return out

    def sent(self, first: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What goes to the homes, by word and by split context: tables here; at first customers here, later a word's root tables so far."""
        by_word, by_ctx = (lambda x: np.bincount(self.at, x, len(self.words)).astype(np.int64)), (lambda x: np.bincount(self.of, x, len(self.contexts)).astype(np.int64)[self.split])
        t = self.tables(self.t)
        return ([by_word(t), by_word(self.c)], [by_ctx(t), by_ctx(self.c)]) if first else ([by_word(t), _large(self.data["root_t"])], [by_ctx(t)])

    def take(self, rows: list[dict], n: int, first: bool, keep: bool) -> None:
        """The homes' answer: of words, customers and tables in the root (at first, also all its tokens); of split contexts, all tables
        (and customers)."""
        (c, t), (tables, customers) = _placed(rows, self.words, n, 2), _placed(rows, self.contexts[self.split], n, 2, 1)
        d = self.data
        if first:
            d["tokens"], d["customers"], t = _small(t), _small(customers), (c > 0).astype(np.int64)
        d["root_t"], self.root_c, self.root_t = _small(t), c, t
        self.all_tables = np.bincount(self.of, self.tables(self.t), len(self.contexts)).astype(np.int64)
        self.all_tables[self.split] = tables
        if keep:
            d["kept"].append({"t": _small(self.t), "tables": _small(tables), "root_c": _small(c), "root_t": _small(t)})

    def sweep(self, model: Model, i: int) -> None:
        """Seats the pairs anew."""
        p = model.root(self.root_c, self.root_t, i)
        w, ctx = self.at[self.many], self.of[self.many]
        key = mixed(self.contexts[ctx] + mixed(self.words[w]))
        self.t = sample_tables(self.c[self.many], self.all_tables[ctx] - self.t, p[w], model.d, STRENGTH, key, SEED << 8 | i)
        self.data["t"] = _small(self.t)

    def log_probabilities(self, model: Model) -> np.ndarray:
        """log10 of each pair's predictive probability, averaged over the samples."""
        customers = np.bincount(self.of, self.c, len(self.contexts))
        customers[self.split] = _large(self.data["customers"])
        total_ = np.zeros(len(self.c))
        for i, s in enumerate(self.data["kept"], len(model.history) - len(self.data["kept"])):
            t = self.tables(_large(s["t"]))
            tables = np.bincount(self.of, t, len(self.contexts))
            tables[self.split] = _large(s["tables"])
            root = model.root(_large(s["root_c"]), _large(s["root_t"]), i)
            total_ += (self.c - model.d * t + (STRENGTH + model.d * tables[self.of]) * root[self.at]) / (STRENGTH + customers[self.of])
        return np.log10(total_ / len(self.data["kept"]))


# --- over the corpus

_MESSAGE = "bucket int, home int, kind string, data binary, sums binary"
_BUCKET = "bucket int, data binary, sums binary"
_PARTS = "bucket int, contexts binary, pairs binary, words binary, counts binary"


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select("text", "doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD, F.lit(False)).alias("held"))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.Table.from_batches([_rows(rows, schema)])


class Kept:
    """Messages in the shared folder. What is put there next replaces them, and shuffles that made them are given up."""

    def __init__(self, df: DataFrame):
        self.at = None
        self.put(df)

    def put(self, df: DataFrame) -> None:
        spark, old, self.at = df.sparkSession, self.at, scratch(df.sparkSession, "restaurants")
        df.write.option("compression", "zstd").partitionBy("kind").parquet(self.at)
        self.df = spark.read.schema(df.schema).parquet(self.at)
        if old:
            self.delete(old)
        del df
        spark._jvm.System.gc()  # the cleaner drops shuffles whose plans are gone

    def delete(self, at: str) -> None:
        path = self.df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop(self, kind: str) -> None:
        """Gives up the messages of a kind; those of others stay."""
        self.delete(f"{self.at}/kind={kind}")

    def of(self, kind: str) -> DataFrame:
        return self.df.where(F.col("kind") == kind).select(*[x.split()[0] for x in _MESSAGE.split(", ")])


def _homes(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by home, the homes there are, and where each one's start."""
    home = (mixed(hashes) % np.uint64(n)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    found, cuts = np.unique(home[order], return_index=True)
    return order, found, np.append(cuts, len(home))


def _addressed(number: int, sides: list[tuple[np.ndarray, list[np.ndarray]]], deal: Dealing) -> list[tuple]:
    """Messages to the homes of hashes, with the numbers of each. sides: words, split contexts."""
    parts: dict[int, list] = {}
    for side, (hashes, numbers) in enumerate(sides):
        order, found, cuts = _homes(hashes, deal.n)
        for h, x, y in zip(found.tolist(), cuts[:-1], cuts[1:], strict=True):
            at = order[x:y]
            parts.setdefault(h, [None, None])[side] = (deal.coded(hashes[at]), [_small(v[at]) for v in numbers])
    return [(number, h, "sent", pickle.dumps(both), None) for h, both in parts.items()]


def _placed(rows: list[dict], hashes: np.ndarray, n: int, width: int, side: int = 0) -> list[np.ndarray]:
    """The homes' numbers for each hash; those that were not sent are 0."""
    order, found, cuts = _homes(hashes, n)
    out = [np.zeros(len(hashes), np.int64) for _ in range(width)]
    where = {h: order[x:y] for h, x, y in zip(found.tolist(), cuts[:-1], cuts[1:], strict=True)}
    for r in rows:
        if r["home"] in where:
            for o, x in zip(out, pickle.loads(r["data"])[side], strict=False):
                o[where[r["home"]]] = _large(x)
    return out


def _summed(parts: list, deal: Dealing) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct hashes, the sums and the maxima of each number, and the place of each entry."""
    hashes = [deal.decoded(x[0]) for x in parts]
    found, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
    numbers = [np.concatenate([_large(x[1][k]) for x in parts]) for k in range(len(parts[0][1]))] if parts else []
    sums = [np.bincount(of, x, len(found)).astype(np.int64) for x in numbers]
    most = []
    for x in numbers:
        m = np.zeros(len(found), np.int64)
        np.maximum.at(m, of, x)
        most.append(m)
    return found, sums, most, of


def homes(sent: DataFrame, model: Model, deal: Dealing) -> DataFrame:
    """Answers to all buckets: kind "answer". sums: words, words with one and two customers in the root, customers and tables there."""
    i = len(model.history)

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        data = [pickle.loads(r["data"]) for r in rows]
        word_parts, ctx_parts = ([d[side] for d in data if d[side] is not None] for side in (0, 1))
        found, sums, most, of = _summed(word_parts, deal)
        t = np.zeros(0, np.int64)
        if len(found):
            c, seen = sums[0], np.flatnonzero(sums[0])
            if i:
                t = np.zeros(len(found), np.int64)
                t[seen] = sample_tables(c[seen], model.history[-1][1] - most[1][seen], np.full(len(seen), model.base()), model.root_d, ROOT_STRENGTH, mixed(found[seen] ^ _ROOT), SEED << 8 | i)
                replies = [c, t]
            else:
                t, replies = (c > 0).astype(np.int64), [c, sums[1]]
            stats = [np.count_nonzero(c), np.count_nonzero(c == 1), np.count_nonzero(c == 2), c.sum(), t.sum()]
        else:
            replies, stats = [], [0] * 5
        _, ctx_sums, _, ctx_of = _summed(ctx_parts, deal)
        out, at, ctx_at = [], 0, 0
        for k, (r, (own, ctx)) in enumerate(zip(rows, data, strict=True)):
            both = []
            if own is not None:
                n = int.from_bytes(own[0][:8], "little")
                both.append([_small(x[of[at : at + n]]) for x in replies])
                at += n
            else:
                both.append([])
            if ctx is not None:
                n = int.from_bytes(ctx[0][:8], "little")
                both.append([_small(x[ctx_of[ctx_at : ctx_at + n]]) for x in ctx_sums])
                ctx_at += n
            else:
                both.append([])
            out.append((r["bucket"], r["home"], "answer", pickle.dumps(both), None if k else np.array(stats, "<i8").tobytes()))
        return _table(out, _MESSAGE)

    return sent.groupBy("home").applyInArrow(answer, _MESSAGE)


def dealing(docs: DataFrame) -> Dealing:
    """Buckets by the size of all texts; contexts to split by a sample."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(size // BUCKET_BYTES) + 1, min(slots(docs.sparkSession), 8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, w, ctx, _ in read_blocks(batches):
            found, sizes = np.unique(ctx, return_counts=True)
            yield pa.record_batch([pa.array([None, *found.view(np.int64).tolist()], pa.int64()), pa.array([len(ctx), *sizes.tolist()], pa.int64())], names=["ctx", "n"])

    some = _prepared(docs.select("doc_id", "text").sample(min(1.0, SAMPLE_BYTES / max(size, 1)), SEED)).mapInArrow(count, "ctx long, n long")
    heaviest = some.groupBy("ctx").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.col("ctx").asc_nulls_first()).limit(max(SPLIT * n, COMMON) + 1).collect()  # all tokens, then contexts
    everything, hashes, sizes = heaviest[0].n if heaviest else 0, np.array([r.ctx for r in heaviest[1:]], np.int64).view(np.uint64), np.array([r.n for r in heaviest[1:]], np.int64)
    heavy = np.flatnonzero(sizes * SPLIT * n > everything)
    heavy = heavy[np.argsort(hashes[heavy])]
    return Dealing(n, hashes[heavy], np.minimum(n, -(-sizes[heavy] * SPLIT * n // max(everything, 1))).astype(np.uint64), np.unique(np.append(hashes[:COMMON], END)))


def bucketed(df: DataFrame, deal: Dealing) -> DataFrame:
    """df as a table in the shared folder that is bucketed by `bucket`: what meets it moves, the table does not."""
    spark, at = df.sparkSession, scratch(df.sparkSession, "buckets")
    name = "buckets_" + at.rpartition("-")[2]
    df.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(min(deal.n, MOST_FILES), "bucket").saveAsTable(name)
    table = spark.table(name)
    table.schema  # analysed: the files are all it needs
    spark.sql(f"DROP TABLE {name}")
    return table


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, Model, Dealing]:
    """The buckets, their last state and the homes' last answers, what all share and how pairs are dealt. Held-out pairs are there too,
    with a count of 0."""
    deal = dealing(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held, _, w, ctx, doc in read_blocks(batches):
            found, at = grouped(w, ctx, deal)
            taught = np.concatenate([[0], np.cumsum(~held[doc[at]])])
            yield _rows([(b, deal.coded(own), _small(pairs), deal.coded(words_), _small(np.diff(taught[np.append(first, last)]))) for b, own, pairs, words_, first, last in found], _PARTS)

    def combine(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        number = rows[0]["bucket"]
        words_, at = np.unique(np.concatenate([deal.decoded(r["words"]) for r in rows]), return_inverse=True)
        contexts, of = np.unique(np.concatenate([deal.decoded(r["contexts"]) for r in rows]), return_inverse=True)
        key = np.repeat(of, np.concatenate([_large(r["pairs"]) for r in rows]))
        key *= len(words_)
        key += at
        c = np.concatenate([_large(r["counts"]).astype(np.uint32) for r in rows])
        del rows, of, at
        order = np.argsort(key)
        key, c = key[order], c[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair, c = key[first], np.add.reduceat(c, first, dtype=np.int64)
        del key, first
        data = {"words": deal.coded(words_), "contexts": deal.coded(contexts), "pairs": _small(np.bincount(pair // len(words_), minlength=len(contexts))), "at": _small(pair % len(words_)), "counts": _small(c), "split": _small(np.flatnonzero(np.isin(contexts, deal.split)))}
        sums = np.array([np.count_nonzero(c == 1), np.count_nonzero(c == 2), c.sum()], "<i8")  # pairs with one and two customers, and tokens
        return _table([(number, pickle.dumps(data), sums.tobytes())], _BUCKET)

    def told(b: Bucket, number: int, first: bool) -> list[tuple]:
        by_word, by_ctx = b.sent(first)
        return _addressed(number, [(b.words, by_word), (b.contexts[b.split], by_ctx)], deal)

    def begin(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        return _table(told(Bucket(table.column("data")[0].as_py(), None, deal), number, True), _MESSAGE)

    def sweeper(i: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def sweep(own: pa.Table, messages: pa.Table) -> pa.Table:
            number, b = received(own, messages.to_pylist(), deal, i == 0, i > BURN)
            b.sweep(model, i)
            return _table([(number, -1, "state", _dumped(b.data), None), *told(b, number, False)], _MESSAGE)

        return sweep

    buckets = bucketed(_prepared(docs).mapInArrow(count, _PARTS).groupBy("bucket").applyInArrow(combine, _BUCKET), deal)
    n1, n2, tokens = (int(x) for x in total(buckets, "sums", 3))
    buckets = buckets.select("bucket", "data")
    model = Model(Model.ratio(n1, n2), tokens)
    answers = Kept(homes(buckets.groupBy("bucket").applyInArrow(begin, _MESSAGE), model, deal))
    messages, state = answers.of("answer"), None
    for i in range(SWEEPS + 1):
        known, one, two, customers, tables = (int(x) for x in total(answers.of("answer").where("sums is not null"), "sums", 5))
        if not i:
            model.v, model.root_d = known, Model.ratio(one, two)
        model.history.append((customers, tables))
        if i < SWEEPS:
            swept = buckets.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInArrow(sweeper(i), _MESSAGE)
            if state is None:
                state = Kept(swept)
            else:
                state.put(swept)
            answers.put(homes(state.of("sent"), model, deal))
            state.drop("sent")
            messages = state.of("state").unionByName(answers.of("answer"))
    return buckets, messages, model, deal


def received(own: pa.Table, rows: list[dict], deal: Dealing, first: bool, keep: bool) -> tuple[int, Bucket]:
    """A bucket's number, and the bucket with the homes' answers."""
    now = next((r["data"] for r in rows if r["kind"] == "state"), None)
    b = Bucket(own.column("data")[0].as_py(), now, deal)
    b.take([r for r in rows if r["kind"] == "answer"], deal.n, first, keep)
    return own.column("bucket")[0].as_py(), b


_SENT = "block long, contexts binary, words binary, rest binary, header binary"
_PARTIAL = "block long, bucket int, docs binary, unknown binary, sums binary, header binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every document."""
    buckets, messages, model, deal = train(docs)
    both = f"{_MESSAGE}, {_SENT}"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, held, counts, w, ctx, doc in read_blocks(batches):
            found, at = grouped(w, ctx, deal)
            doc = doc[at].astype("<u2")
            header = pickle.dumps((ids, held, counts))
            yield _rows([(b, None, "asked", None, None, block, deal.coded(own), deal.coded(words_), _dumped((_small(pairs), _small(np.diff(np.append(first, last))), doc[first[0] : last].tobytes())), None if k else header) for k, (b, own, pairs, words_, first, last) in enumerate(found)], both)

    def answer(own: pa.Table, table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        number, b = received(own, table.filter(pa.array([k != "asked" for k in kind])).select(["home", "kind", "data"]).to_pylist(), deal, SWEEPS == 0, True)
        known = _large(b.data["tokens"])[b.at]
        key = b.of * len(b.words) + b.at
        values = [np.log10(known + 1.0), b.log_probabilities(model)]
        unknown = (known == 0).astype(float)
        out = []
        for batch in table.filter(pa.array([k == "asked" for k in kind])).to_batches(max_chunksize=16):
            for r in batch.to_pylist():
                pairs, n, docs_ = _loaded(r["rest"])
                n, docs_ = _large(n), np.frombuffer(docs_, "<u2")
                of = np.repeat(np.searchsorted(b.contexts, deal.decoded(r["contexts"])), _large(pairs))
                at = np.searchsorted(key, of * len(b.words) + np.searchsorted(b.words, deal.decoded(r["words"])))
                if int(docs_.max()) < 8 * len(docs_):
                    named, of = np.flatnonzero(np.bincount(docs_)), docs_
                    place = named
                else:
                    named, of = np.unique(docs_, return_inverse=True)
                    place = slice(None)
                sums = np.stack([np.bincount(of, np.repeat(v[at], n))[place] for v in values])
                out.append((r["block"], number, _set(named), _small(np.bincount(of, np.repeat(unknown[at], n))[place]), sums.tobytes(), r["header"]))
        return _table(out, _PARTIAL)

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        ids, held, counts = pickle.loads(next(r["header"] for r in rows if r["header"] is not None))
        sums = np.zeros((3, len(ids)))
        for r in rows:
            sums[:, _members(r["docs"])] += np.vstack([np.frombuffer(r["sums"], "<f8").reshape(2, -1), _large(r["unknown"])])
        n, v = model.n, model.v
        cols = [pa.array(ids, pa.int64()), pa.array(held), pa.array(counts), pa.array(counts - np.rint(sums[2]).astype(np.int64)), pa.array(np.full(len(ids), n, np.int64)), pa.array(sums[0] - counts * np.log10(n + v + 1.0)), pa.array(sums[1])]
        return pa.table(cols, names=[x.split()[0] for x in _SCORED.split(", ")])

    told = messages.unionByName(_prepared(docs).mapInArrow(send, both), allowMissingColumns=True)
    return buckets.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(answer, _PARTIAL).groupBy("block").applyInArrow(gather, _SCORED)
