"""Texts of an Arrow column as flat byte arrays, and hashes of their n-grams and words, a bounded block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidewright.llm.common import texts

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK = 1 << 18
_SOLID = np.ones(256, bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER = LOWER.astype(np.uint64) + np.uint64(1)
_POWERS = np.random.default_rng(20_240_229).integers(1 << 63, size=1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts): consecutive texts, a space behind each; row first + i is bytes[starts[i] : starts[i + 1] - 1]."""
    first, held, size = 0, [], 0

    def out() -> tuple[int, np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])])
        return first, np.frombuffer(b" ".join(held) + b" ", np.uint8), starts

    for text in texts(column):
        held.append(text)
        size += len(text)
        if size >= most:
            yield out()
            first, held, size = first + len(held), [], 0
    if held:
        yield out()


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i] : starts[i + 1]]; 0 where that is empty."""
    whole = np.concatenate([np.zeros(1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else np.float64), np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)])
    return whole[starts[1:]] - whole[starts[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space-delimited word, and where each text's words start. Equal words have equal hashes; A-Z is lowered."""
    solid = _SOLID[raw]
    edge = np.flatnonzero(np.diff(solid, prepend=False))  # begins and ends in turn; a space comes last
    begins, ends = edge[::2], edge[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    runs = begins if begins[0] == 0 else np.concatenate([[0], begins])
    sizes = np.diff(runs, append=len(raw))
    place = np.arange(len(raw))
    place -= np.repeat(runs, sizes)
    if sizes.max() <= len(_POWERS):
        value = _POWERS[place]
    else:
        value = _POWERS[place & 0xFFFF] + ((place >> 16) << 1).astype(np.uint64)
    value *= _LETTER[raw]
    np.cumsum(value, out=value)
    return mixed(value[ends - 1] - np.where(begins, value[begins - 1], np.uint64(0))), np.searchsorted(begins, starts)


def grams(raw: np.ndarray, n: int = 4) -> np.ndarray:
    """The n bytes from each place on, as an integer; there are len(raw) - n + 1 of them."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    wide = raw.astype(np.uint32 if n <= 4 else np.uint64)
    out = wide[:m].copy()
    for i in range(1, n):
        out |= wide[i : m + i] << (8 * i)
    return out
