"""Integer and byte columns packed for a shuffle or a file, and the walk over documents in blocks that the block-wise operators share."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from tidewright.llm.common import texts

#: Bytes of text after which a block is closed. A longer text is a block of its own.
BLOCK = 8 << 20


def pack(values) -> bytes:
    """Integers of 0 and more by planes of bytes, compressed."""
    v = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<QB", len(v), width) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    """What pack() packed, as int64."""
    n, width = struct.unpack_from("<QB", raw)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:]), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<i8")


def pack_bytes(parts: list[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, parts), np.int64, len(parts)))
    return struct.pack("<Q", len(lengths)) + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack_bytes(raw: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<Q", raw)
    ends = np.cumsum(unpack(raw[8 : 8 + n])).tolist()
    data = zstandard.ZstdDecompressor().decompress(raw[8 + n :])
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def gathered(values: np.ndarray, lengths: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The pieces `take`, one after another, of values cut into pieces of these lengths."""
    starts = np.cumsum(lengths) - lengths
    wanted = lengths[take]
    ends = np.cumsum(wanted)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts[take] - (ends - wanted), wanted)]


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[bytes, list, list[bytes]]]:
    """The partition's rows (id, text) in blocks of about `most` bytes: key, ids, texts. The key names the partition, the block and its
    content, so a scan that deals the rows out otherwise gives other keys."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    held: list[bytes] = []

    def key() -> bytes:
        mark = hashlib.blake2b(struct.pack("<qq", part, seq), digest_size=16)
        for i, text in zip(ids, held, strict=True):
            mark.update(f"{i} {len(text)} ".encode())
            mark.update(text)
        return mark.digest()

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if held and size + len(text) > most:
                yield key(), ids, held
                ids, held, size, seq = [], [], 0, seq + 1
            ids.append(i)
            held.append(text)
            size += len(text)
    if held:
        yield key(), ids, held
