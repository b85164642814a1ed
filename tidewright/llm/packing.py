"""Packing: vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

An example is a run of tokens of which some bear loss. It fills whole sequences as long as it is longer than one; what is left
is placed, largest first, by the dot-product heuristic: of the open sequences it fits, the one whose remaining room, as a
vector of the three limits, has the largest dot product with the example's demand, both in units of the limits. Where it fits
none it is cut: the sequence with the most room takes the part that fits and the rest goes on, so sequences fill up exactly.
Each task packs blocks of its own rows: no shuffle, memory bounded by a block. Of a block's last, partly filled
sequences the emptiest fill the others' gaps; what is left of them is cut into power-of-two lengths, which take no padding.

Defined results: a null or empty text is its end id alone; equal rows are packed apart; an empty table gives no row; further
columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import texts
from tidewright.llm.tokens import encoder as encoder_of

LENGTH, SEGMENTS = 2048, 256
#: Tokens a block gathers before it is packed, and sequences open at once.
BLOCK, OPEN = 2_000_000, 512


def pack(tokens: np.ndarray, loss: np.ndarray | None = None, length: int = LENGTH, segments: int = SEGMENTS, most_loss: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (example, start, length, sequence, offset) of examples given by their token and loss-bearing counts. Loss-bearing
    tokens are taken to lie at an example's end, as an answer does, or to be all of it where `loss` is None.

    Sequences are numbered from 0; each is gapless, and within the limits."""
    tokens = np.asarray(tokens, np.int64)
    loss = tokens if loss is None else np.minimum(np.asarray(loss, np.int64), tokens)
    most_loss = most_loss or length
    limits = np.array([length, segments, most_loss], float)
    pieces: list[tuple[int, int, int, int, int]] = []
    used = np.zeros((OPEN, 3), np.int64)  # tokens, segments, loss of each open sequence
    number = np.full(OPEN, -1, np.int64)
    sequences = 0
    top = np.array([length, segments, most_loss], np.int64)

    def bears(e: int, start: int, n: int) -> int:
        return max(0, start + n - max(start, int(tokens[e] - loss[e])))

    def fits(e: int, start: int, n: int, room: np.ndarray) -> int:
        """The longest run from start that the room takes."""
        n = min(n, int(room[0]))
        plain = max(0, min(n, int(tokens[e] - loss[e]) - start))
        return 0 if room[1] < 1 else min(n, plain + int(room[2]))

    def put(slot: int, e: int, start: int, n: int) -> None:
        pieces.append((e, start, n, int(number[slot]), int(used[slot, 0])))
        used[slot] += (n, 1, bears(e, start, n))
        if (used[slot] >= top).any():  # full in one of its limits
            number[slot] = -1

    def opened() -> int:
        nonlocal sequences
        slot = int(np.argmin(number >= 0))
        number[slot], used[slot] = sequences, 0
        sequences += 1
        return slot

    rest = []
    for e, n in enumerate(tokens.tolist()):
        start = 0
        while n - start >= length and (take := fits(e, start, n - start, top)) == length:
            pieces.append((e, start, length, sequences, 0))
            sequences += 1
            start += length
        if n > start:
            rest.append((n - start, e, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = int(sum(x[0] for x in rest))
    # As many sequences as the rest must at least take are open from the start, so that the long and the short meet.
    reserve = min(OPEN, total // length + 1)
    for n, e, start in rest:
        end = start + n
        while start < end:
            live = number >= 0
            room = np.where(live[:, None], top - used, 0)
            demand = np.array([end - start, 1, bears(e, start, end - start)], np.int64)
            able = live & (room >= demand).all(axis=1)
            if able.any():
                score = np.where(able, (room / limits) @ (demand / limits), -1.0)
                put(int(np.argmax(score)), e, start, end - start)
                break
            if live.sum() < reserve:
                slot = opened()
            else:
                slot = int(np.argmax(np.where(live & (room[:, 1] > 0) & (room[:, 2] > 0), room[:, 0], -1)))
                if room[slot, 0] <= 0 or not live[slot]:
                    slot = opened() if live.sum() < OPEN else slot
            take = fits(e, start, end - start, top - used[slot])
            if take <= 0:  # only plain tokens may enter and none are left: close it
                number[slot] = -1
                continue
            put(slot, e, start, take)
            start += take
    return _without_gaps(pieces, length, segments, most_loss, loss, tokens)


def _without_gaps(pieces: list, length: int, segments: int, most_loss: int, loss: np.ndarray, tokens: np.ndarray) -> list:
    """Sequences left short are filled from the emptiest of them, cut where need be; what is left of these is cut into powers of two."""
    filled: dict[int, int] = {}
    for _, _, n, s, _ in pieces:
        filled[s] = filled.get(s, 0) + n
    short = {s: [] for s, n in sorted(filled.items(), key=lambda x: (x[1], x[0])) if n & (n - 1)}  # not a power of two: it would be padded
    if not short:
        return pieces
    out = [p for p in pieces if p[3] not in short]
    for p in pieces:
        if p[3] in short:
            short[p[3]].append(p)
    order, loose = list(short), []
    lo, hi = 0, len(order) - 1
    while lo <= hi:  # the fullest first
        s, gap = order[hi], length - filled[order[hi]]
        while lo < hi and sum(p[2] for p in loose) < gap:
            loose += [p[:3] for p in short[order[lo]]]
            lo += 1
        rest, added, count = loose.copy(), [], len(short[s])
        bearing = sum(max(0, x + n - max(x, int(tokens[e] - loss[e]))) for e, x, n, _, _ in short[s])
        while gap and rest and count < segments:
            e, start, n = rest.pop()
            plain = max(0, min(n, int(tokens[e] - loss[e]) - start))
            take = min(n, gap, plain + most_loss - bearing)
            if take <= 0:
                break
            added.append((e, start, take, s, length - gap))
            bearing += max(0, take - plain)
            gap, count = gap - take, count + 1
            if take < n:
                rest.append((e, start + take, n - take))
        if gap:  # too little is left, or another limit is met
            loose += [p[:3] for p in short[s]]
        else:
            out, loose = out + short[s] + added, rest
        hi -= 1
    loose.sort()
    sequence = max(filled) + 1
    left = sum(p[2] for p in loose)
    room, count, bearing, offset = 0, 0, 0, 0
    for e, start, n in loose:
        while n:
            if not room or count >= segments or bearing >= most_loss:
                sequence += 1
                room = min(length, 1 << (left.bit_length() - 1))
                count = bearing = offset = 0
            plain = max(0, min(n, int(tokens[e] - loss[e]) - start))
            take = min(n, room, plain + most_loss - bearing)
            out.append((e, start, take, sequence, offset))
            bearing += max(0, take - plain)
            start, n, room, left, offset, count = start + take, n - take, room - take, left - take, offset + take, count + 1
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, segments: int = SEGMENTS, most_loss: int | None = None, with_ids: bool = False) -> DataFrame:
    """Packs docs (doc_id, text): one row a piece. with_ids adds `ids`, the piece's token ids."""
    schema = _PIECES + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, sequence = encoder_of(tokenizer), part << 36
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held, size
            cols: list[list] = [[] for _ in range(7 + with_ids)]
            dense: dict[int, int] = {}
            for e, start, n, s, offset in pack(np.array([len(x[1]) + 1 for x in held]), None, length, segments, most_loss):
                doc_id, ids = held[e]
                own = ids[start : start + n]
                if start + n > len(ids):
                    own = np.append(own, np.array([end_id], own.dtype))
                values = (doc_id, start, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids) + 1, sequence + dense.setdefault(s, len(dense)), offset)
                for c, v in zip(cols, (*values, own.astype(np.int32)) if with_ids else values, strict=True):
                    c.append(v)
            sequence += len(dense)
            held, size = [], 0
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts(batch.column(1))), strict=True):
                held.append((doc_id, ids))
                size += len(ids) + 1
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, segments: int = 16, most_loss: int | None = None) -> DataFrame:
    """Packs instruction data (conv_id, turn, role, text): an example is a conversation with its turns in order; the tokens of
    its closing assistant turn bear loss, and so does the end. One row a piece: conv_id, start, length, sequence_id, offset, loss.

    Defined results: a null text counts as empty, a null turn as the first, a null role as none; rows without conv_id are one
    conversation; a turn that is repeated counts as often as it is there; an empty table gives no row."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            yield pa.record_batch([*batch.columns[:3], pa.array(map(len, encoder.encode_all(texts(batch.column(3)))), pa.int64())], names=["conv_id", "turn", "role", "n"])

    # only counts meet by conversation: a long one is sums, not a list
    sized = turns.select("conv_id", "turn", "role", "text").mapInArrow(sizes, "conv_id long, turn long, role string, n long")
    last = F.max_by(F.struct("role", "n"), F.struct(F.coalesce("turn", F.lit(-1)), "role", "n"))
    examples = sized.groupBy("conv_id").agg((F.sum("n") + 1).alias("tokens"), last.alias("last"))
    examples = examples.select("conv_id", "tokens", F.when(F.col("last.role") == "assistant", F.col("last.n") + 1).otherwise(0).alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            names, (counts, losses) = batch.column(0).to_pylist(), (batch.column(i).to_numpy() for i in (1, 2))
            found = pack(counts, losses, length, segments, most_loss)
            rows = [(names[e], start, n, sequence + s, offset, max(0, start + n - max(start, int(counts[e] - losses[e])))) for e, start, n, s, offset in found]
            sequence += max((p[3] for p in found), default=-1) + 1
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=["conv_id", "start", "length", "sequence_id", "offset", "loss"])

    return examples.mapInArrow(run, "conv_id long, start long, length long, sequence_id long, offset long, loss long")
