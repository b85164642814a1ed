"""Phrase collocations by stripes: a prefix keys a counter of the words that follow it, and stripes are merged elementwise.

Documents are read once, into blocks of a language, as numbers of the block's own words. A block's stripe of the empty prefix is its
word counts; merged, these give the frequent words, the language's total, and each block its own frequent words back. Then each block
sends the stripes of its frequent words (for pairs), and, after the frequent pairs came back, the stripes of prefixes of two to
four words over places where all pairs are frequent. An entry of a merged stripe is at once an extension of its prefix, the prefix
total of the next longer phrase, and what subsumes its prefix and its suffix: a phrase's greatest one-word extension is the greatest
entry of its own stripe, or of a stripe that continues one word before it. Longer phrases need not be looked at, as a part of a
phrase is never rarer than the phrase.

Stripes go to parts by the hash of their prefix. A prefix that occurs often enough to fill a part is split by the word that
follows, into as many slices as its count asks, so no part grows with one prefix.

Defined results: a null text counts as empty; a null language is `und`, together with a language of that name; repeated rows count
each; an empty table, or one without frequent phrases, gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import slots, texts, written
from tidewright.llm.packed import BLOCK, pack, unpack

#: Bytes of text a part of the stripes is laid out for; occurrences of a prefix from which its stripe is split.
PART, WHOLE = 32 << 20, 1 << 19
#: A word's number is that of a block and a place in it.
PLACE_BITS = 27
#: Bytes that end a piece; each becomes a full stop of its own.
_BREAKS = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d", b"." * 9)
#: So many languages at most are joined by broadcast.
FEW = 10_000


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, and `.` where a piece ends."""
    return text.lower().translate(_BREAKS).replace(b".", b" . ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _new_rows(rows: np.ndarray) -> np.ndarray:
    """Where a row of a sorted matrix differs from the one before."""
    return np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)


def stripes(words: np.ndarray, counts: np.ndarray, most: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
    """(part, words a phrase has, packed prefixes, entries of each, following words, counts). words: a phrase each row, all different;
    most: a bound of how often the prefix occurs anywhere."""
    if not len(words):
        return
    m = words.shape[1]
    spread = np.zeros(len(words), np.uint64)
    for c in range(m - 1):
        spread = _mixed(spread ^ words[:, c].astype(np.uint64))
    slices = np.uint64(1) << np.ceil(np.log2(np.maximum(most / WHOLE, 1))).astype(np.uint64)
    part = (_mixed(spread + (_mixed(words[:, -1]) & (slices - np.uint64(1)))) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort([*(words[:, c] for c in reversed(range(m))), part])
    words, counts, part = words[order], counts[order], part[order]
    cuts = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        prefix = words[a:b, :-1]
        first = np.flatnonzero(_new_rows(prefix))
        yield int(part[a]), m, pack(prefix[first].T.reshape(-1)), pack(np.diff([*first, b - a])), pack(words[a:b, -1]), pack(counts[a:b])


def _entries(m: int, prefixes: bytes, sizes: bytes, nexts: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What stripes() packed: phrases and counts."""
    sized = unpack(sizes)
    prefix = unpack(prefixes).reshape(m - 1, -1).T
    return np.column_stack([np.repeat(prefix, sized, axis=0), unpack(nexts)]), unpack(counts)


STRIPES = "part int, m int, block long, prefixes binary, sizes binary, nexts binary, counts binary"
MERGED = "words array<long>, f long, block long, firsts binary, seconds binary, fs binary"


def merge(sent: DataFrame, least: int, reply: bool) -> DataFrame:
    """Stripes of a part added up elementwise. Gives phrases (words, f) that occur `least` times, and if asked, for each block that sent
    one of two words, its own such entries."""

    def add(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = list(zip(*(table.column(c).to_pylist() for c in ("m", "block", "prefixes", "sizes", "nexts", "counts")), strict=True))
        for m in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == m]
            parts = [_entries(m, *r[2:]) for r in own]
            words, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            source = np.repeat(np.arange(len(own)), [len(p[1]) for p in parts])
            order = np.lexsort([words[:, c] for c in reversed(range(m))])
            words, counts, source = words[order], counts[order], source[order]
            new = _new_rows(words)
            sums = np.add.reduceat(counts, np.flatnonzero(new))
            frequent = sums >= least
            out += [(w, int(f), None, None, None, None) for w, f in zip(words[new][frequent].tolist(), sums[frequent], strict=True)]
            if reply:
                group = np.cumsum(new) - 1
                kept = np.flatnonzero(frequent[group])
                kept = kept[np.argsort(source[kept], kind="stable")]
                cuts = np.searchsorted(source[kept], np.arange(len(own) + 1))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a < b:
                        at = kept[a:b]
                        out.append((None, None, own[i][1], pack(words[at, 0]), pack(words[at, 1]), pack(sums[group[at]])))
        kinds = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["words", "f", "block", "firsts", "seconds", "fs"])

    return sent.groupBy("part").applyInArrow(add, MERGED)


def _read(docs: DataFrame, lang: str, text: str, block: int) -> DataFrame:
    """(block, lang, words, counts, codes): the texts in blocks of a language; codes are places in words, 1 at first, and 0 where a piece
    ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        opened: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def close(of: str) -> pa.RecordBatch:
            nonlocal seq
            place, parts = opened.pop(of)
            sizes.pop(of)
            names, codes = list(place), np.concatenate(parts)
            counts = np.bincount(codes, minlength=len(names))
            order = np.concatenate([[0], 1 + np.argsort(-counts[1:], kind="stable")])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            codes = rank[codes]
            codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one end of a piece is enough
            number, seq = TaskContext.get().partitionId() << 12 | seq, seq + 1
            if seq > 1 << 12 or len(order) >= 1 << PLACE_BITS:
                raise ValueError("a partition has too many blocks, or a block too many words, to be numbered")
            row = [[number], [of], [[names[i].decode("utf-8", "replace") for i in order[1:].tolist()]], [counts[order[1:]]], [pack(codes)]]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["block", "lang", "words", "counts", "codes"])

        for batch in batches:
            for of, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                place, parts = opened.setdefault(of, ({b".": 0}, []))
                words = [*tokens(raw), b"."]
                new = [w for w in dict.fromkeys(words) if w not in place]
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                parts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                sizes[of] = sizes.get(of, 0) + len(raw) + 1
                if sizes[of] >= block:
                    yield close(of)
                elif sum(sizes.values()) >= 4 * block:
                    yield close(max(sizes, key=sizes.get))
        while opened:
            yield close(next(iter(opened)))

    kept = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, codes binary")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang: str = "lang", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The stripes' entries: (lang, words, f) of each phrase of one to `longest` words that occurs `least` times, and (lang, n)."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(slots(docs.sparkSession), -(-size // PART))
    read = written(_read(docs, lang, text, block), "phrases-blocks")
    totals = read.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))

    entries = read.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "entry")).select("block", "lang", F.col("entry.words").alias("word"), F.col("entry.counts").alias("count"), (F.shiftleft("block", PLACE_BITS) + F.col("place") + 1).alias("own"))
    word = Window.partitionBy("lang", "word")
    summed = entries.withColumns({"f": F.sum("count").over(word), "id": F.min("own").over(word)}).where(F.col("f") >= least)
    known = written(summed.select("block", "lang", "word", "f", "id", "own"), "phrases-words")
    words = known.where("own = id").select("lang", "word", "f", "id")

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            at = left.column("block")[0].as_py()
            codes = unpack(left.column("codes")[0].as_py())
            ids, f, place = (right.column(c).to_numpy() for c in ("id", "f", "place"))
            order = np.argsort(ids)
            ids, f, place = ids[order], f[order], place[order]
            local = np.full(int(max(codes.max(), place.max())) + 1, -1, np.int64)
            local[place] = np.arange(len(ids))
            here = np.concatenate([local[codes], [-1]])
            both = (here[:-1] >= 0) & (here[1:] >= 0)
            pair, counts = np.unique(here[:-1][both] * len(ids) + here[1:][both], return_counts=True)
            first, second = pair // len(ids), pair % len(ids)
            out += [(p, m, at, *x, None, None) for p, m, *x in stripes(np.column_stack([ids[first], ids[second]]), counts, f[first], parts)]
            used = both | np.concatenate([[False], both[:-1]])  # words of a pair; a gap is left after each stretch of them
            gap = ~used & np.concatenate([[False], used[:-1]])
            out.append((None, None, at, None, None, None, None, pack(np.where(used, here[:-1], -1)[used | gap] + 1), pack(ids)))
        kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["part", "m", "block", "prefixes", "sizes", "nexts", "counts", "state", "ids"])

    own = known.select("block", "id", "f", F.expr(f"own & {(1 << PLACE_BITS) - 1}").alias("place"))
    sent = written(read.select("block", "codes").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(pairs, f"{STRIPES}, state binary, ids binary"), "phrases-pairs")
    columns = [c.split()[0] for c in STRIPES.split(", ")]
    two = written(merge(sent.where("part is not null").select(*columns), least, True), "phrases-two")

    def longer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            at = left.column("block")[0].as_py()
            here, ids = unpack(left.column("state")[0].as_py()) - 1, unpack(left.column("ids")[0].as_py())
            firsts, seconds, fs = (np.concatenate([unpack(x) for x in right.column(c).to_pylist()]) for c in ("firsts", "seconds", "fs"))
            pair = np.searchsorted(ids, firsts) * len(ids) + np.searchsorted(ids, seconds)
            order = np.argsort(pair)
            pair, fs = pair[order], fs[order]
            both = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
            wanted = here[both] * len(ids) + here[both + 1]
            found = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
            hit = pair[found] == wanted
            chain = np.full(len(here) + longest, -1, np.int64)  # the frequent pair that begins at each place
            chain[both[hit]] = found[hit]
            gram, places = chain.copy(), both[hit]
            for m in range(3, longest + 1):  # gram: the phrase of m - 1 words that begins at each place
                places = places[(gram[places] >= 0) & (chain[places + m - 2] >= 0)]
                if not len(places):
                    break
                keys, first, which, counts = np.unique(gram[places] * len(pair) + chain[places + m - 2], return_index=True, return_inverse=True, return_counts=True)
                start = places[first]
                phrases = ids[np.column_stack([here[start + k] for k in range(m)])]
                out += [(p, m, at, *x) for p, m, *x in stripes(phrases, counts, fs[chain[start]], parts)]
                gram = np.full_like(chain, -1)
                gram[places] = which.reshape(-1)
        kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=columns)

    state = sent.where("state is not null").select("block", "state", "ids")
    answers = two.where("block is not null").select("block", "firsts", "seconds", "fs")
    more = merge(state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(longer, STRIPES), least, False)
    numbered = two.where("words is not null").select("words", "f").unionByName(more.select("words", "f"))
    spelled = numbered.select(F.col("words").alias("phrase"), "f", F.posexplode("words").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    joined = spelled.groupBy("phrase", "f", "lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    return words.select("lang", F.array("word").alias("words"), "f").unionByName(joined.select("lang", "words", "f")), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, subsumed: int = 100, lang: str = "lang", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The operator: the `top` phrases of each language by score (1000 a n / (l r), floored, of the worst cut in two), without those
    that a longer phrase has in `subsumed` percent of their occurrences. Columns: lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent_phrases(docs, least, longest, lang, text, block)
    spelled = lambda words: F.array_join(words, " ")
    table = written(found.select("lang", "words", spelled("words").alias("phrase"), "f"), "phrases")
    langs = written(totals, "phrases-totals")
    langs = F.broadcast(langs) if langs.count() <= FEW else langs
    long = table.where(F.size("words") > 1)
    inner = F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)))
    covers = long.where(F.size("words") > 2).select("lang", "f", inner.alias("part")).groupBy("lang", spelled("part").alias("phrase")).agg(F.max("f").alias("cover"))
    cut = long.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    sides = cut.select("lang", "phrase", "a", "k", spelled(F.slice("words", F.lit(1), F.col("k"))).alias("left"), spelled(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    lefts, rights = table.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), table.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    met = sides.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(langs, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = met.withColumns({"above": (F.lit(1000).cast("decimal(4,0)") * whole("a")).cast("decimal(19,0)") * whole("n"), "below": whole("l") * whole("r")}).withColumn("score", F.expr("above div below"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    free = worst.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < subsumed * F.col("a")))
    kept = free.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
