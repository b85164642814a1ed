"""Decoders of binary forecast formats, on numpy arrays."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np


def lz4_block(src: bytes, size: int) -> bytes:
    """An LZ4 block of known decompressed size."""
    out, at = bytearray(), 0
    while at < len(src):
        token = src[at]
        at += 1
        n = token >> 4
        if n == 15:
            while True:
                n += src[at]
                at += 1
                if src[at - 1] != 255:
                    break
        out += src[at : at + n]
        at += n
        if at >= len(src):
            break
        offset = src[at] | src[at + 1] << 8
        at += 2
        n = (token & 15) + 4
        if n == 19:
            while True:
                n += src[at]
                at += 1
                if src[at - 1] != 255:
                    break
        if not 0 < offset <= len(out):
            raise ValueError("an LZ4 match points before the block")
        while n > 0:  # a match may overlap what it makes
            piece = out[len(out) - offset : len(out) - offset + min(n, offset)]
            out += piece
            n -= len(piece)
    if len(out) != size:
        raise ValueError(f"an LZ4 block has {len(out)} bytes, not {size}")
    return bytes(out)


def unshuffle(block: bytes, width: int) -> bytes:
    """Byte planes back to elements; bytes past the last whole element stay."""
    n = len(block) // width
    return np.frombuffer(block, np.uint8, n * width).reshape(width, n).T.tobytes() + block[n * width :]


def bit_unshuffle(block: bytes, width: int) -> bytes:
    """Bit planes back to elements, eight elements at a time."""
    n = len(block) // width // 8 * 8
    bits = np.unpackbits(np.frombuffer(block, np.uint8, n * width).reshape(width * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T.reshape(n, width, 8), axis=2, bitorder="little").tobytes() + block[n * width :]


def blosc_decompress(src: bytes) -> bytes:
    """A Blosc 1 frame: LZ4, Zstandard or Zlib blocks, byte or bit shuffle, or a plain copy."""
    version, _, flags, width = src[:4]
    size, block_size, total = struct.unpack_from("<3I", src, 4)
    if total > len(src):
        raise ValueError("a Blosc frame is cut short")
    if flags & 2:
        return src[16 : 16 + size]
    if not size:
        return b""
    codec = flags >> 5
    n = -(-size // block_size)
    out = []
    for i, start in enumerate(struct.unpack_from(f"<{n}I", src, 16)):
        length = min(block_size, size - i * block_size)
        short = i == n - 1 and size % block_size
        splits = width if not flags & 16 and not short and width > 1 and block_size // width >= 128 and codec in (0, 1) else 1
        parts, at = [], start
        for _ in range(splits):
            (packed,) = struct.unpack_from("<i", src, at)
            at += 4
            piece, want = src[at : at + packed], length // splits
            at += packed
            parts.append(piece if packed == want else _inner(codec, piece, want))
        block = b"".join(parts)
        if width > 1 and flags & 1:
            block = unshuffle(block, width)
        elif flags & 4:
            block = bit_unshuffle(block, width)
        out.append(block)
    return b"".join(out)


def _inner(codec: int, piece: bytes, size: int) -> bytes:
    if codec == 1:
        return lz4_block(piece, size)
    if codec == 3:
        import zlib

        return zlib.decompress(piece)
    if codec == 4:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(piece, size)
    raise ValueError(f"Blosc codec {codec} is not supported")


def _signed(x: int, bits: int) -> int:
    """GRIB's sign and magnitude."""
    top = 1 << (bits - 1)
    return -(x & (top - 1)) if x & top else x


def grib2_scan(f, size: int, wanted: Callable[[int, dict], bool]) -> Iterator[tuple[int, dict]]:
    """(number, metadata and values) of the messages in a file that seeks whose number and metadata `wanted` accepts. Of the others neither the
    bytes of their values are read nor these unpacked; their bitmaps are, for later messages may use them."""
    at, number, present = 0, 0, None
    while at + 16 <= size:
        f.seek(at)
        head = f.read(16)
        if head[:4] != b"GRIB":
            f.seek(at)
            place = (f.read(1 << 16)).find(b"GRIB")
            at += place if place >= 0 else (1 << 16) - 3
            continue
        if head[7] != 2:
            raise ValueError("only edition 2 of GRIB is read")
        (total,) = struct.unpack_from(">Q", head, 8)
        parts, here = [head], at + 16
        while here < at + total - 4:
            f.seek(here)
            length, section = struct.unpack(">IB", f.read(5))
            if section == 7:
                break
            f.seek(here)
            parts.append(f.read(length))
            here += length
        before = b"".join(parts)
        found = grib2_message(before + b"7777", present)
        if wanted(number, found):
            f.seek(here)
            found = grib2_message(before + f.read(at + total - here), present)
        present = found["present"] if found["present"] is not None else present
        if "values" in found:
            yield number, found
        at, number = at + total, number + 1


def grib2_messages(buf: bytes) -> Iterator[dict]:
    at, present = 0, None
    while (at := buf.find(b"GRIB", at)) >= 0 and at + 16 <= len(buf):
        if buf[at + 7] != 2:
            raise ValueError("only edition 2 of GRIB is read")
        (total,) = struct.unpack_from(">Q", buf, at + 8)
        found = grib2_message(buf[at : at + total], present)
        present = found.get("present") if found.get("present") is not None else present
        yield found
        at += total


def grib2_message(m: bytes, before: np.ndarray | None = None) -> dict:
    """A message's metadata and `values`; `present` is its bitmap, if any. before: the bitmap of an earlier message, which it may use."""
    out = {"discipline": m[6], "category": None, "parameter": None, "step_h": None, "member": None, "interval_h": None, "n_lon": 0, "n_lat": 0, "lat0": 0.0, "lon0": 0.0, "d_lat": 0.0, "d_lon": 0.0}
    at, packing, present = 16, None, None
    while m[at : at + 4] != b"7777":
        length, number = struct.unpack_from(">IB", m, at)
        s = m[at : at + length]
        if number == 3:
            if (template := struct.unpack_from(">H", s, 12)[0]) != 0:
                raise ValueError(f"grid template 3.{template} is not supported")
            out["n_lon"], out["n_lat"] = struct.unpack_from(">2I", s, 30)
            lat1, lon1 = (_signed(x, 32) / 1e6 for x in struct.unpack_from(">2I", s, 46))
            lat2 = _signed(struct.unpack_from(">I", s, 55)[0], 32) / 1e6
            d_lon, d_lat = (x / 1e6 for x in struct.unpack_from(">2I", s, 63))
            out |= {"lat0": lat1, "lon0": lon1, "d_lat": d_lat if lat2 >= lat1 else -d_lat, "d_lon": d_lon}
        elif number == 4:
            template = struct.unpack_from(">H", s, 7)[0]
            if template not in (0, 1, 8):
                raise ValueError(f"product template 4.{template} is not supported")
            hours = {0: 1 / 60, 1: 1.0, 2: 24.0, 10: 3.0, 11: 6.0, 12: 12.0, 13: 1 / 3600}
            out |= {"category": s[9], "parameter": s[10], "step_h": struct.unpack_from(">I", s, 18)[0] * hours[s[17]]}
            if template == 1:
                out["member"] = s[35]
            if template == 8:
                out["interval_h"] = struct.unpack_from(">I", s, 49)[0] * hours[s[48]]
                out["step_h"] += out["interval_h"]
        elif number == 5:
            n, template = struct.unpack_from(">IH", s, 5)
            if template not in (0, 42):
                raise ValueError(f"packing template 5.{template} is not supported")
            reference, e, d, bits = *struct.unpack_from(">f", s, 11), *(_signed(x, 16) for x in struct.unpack_from(">2H", s, 15)), s[19]
            packing = (n, template, reference, e, d, bits, s[21:])
        elif number == 6:
            if s[5] == 0:
                present = np.unpackbits(np.frombuffer(s, np.uint8, offset=6))[: out["n_lon"] * out["n_lat"]].astype(bool)
            elif s[5] == 254:
                present = before
            elif s[5] != 255:
                raise ValueError(f"predefined bitmap {s[5]} is not supported")
        elif number == 7:
            n, template, reference, e, d, bits, rest = packing
            if bits == 0:
                x = np.zeros(n)
            elif template == 0:
                x = unpack_bits(s[5:], bits, n)
            else:
                x = aec_decode(s[5:], bits, rest[0], rest[1], struct.unpack_from(">H", rest, 2)[0], n)
            x = (np.float64(reference) + x * 2.0**e) / 10.0**d
            if present is not None:
                full = np.full(len(present), np.nan)
                full[present] = x[: present.sum()]
                x = full
            out["values"] = x
        at += length
    out["present"] = present
    return out


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """n unsigned integers of so many bits each, most significant first."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype("f8")
    raw = np.unpackbits(np.frombuffer(data, np.uint8, -(-n * bits // 8)))[: n * bits].reshape(n, bits)
    return raw @ (2.0 ** np.arange(bits - 1, -1, -1))


class _Bits:
    """Reads bits from a place on; what a read costs does not depend on the place."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)

    def take(self, n: int) -> int:
        first, self.at = self.at, self.at + n
        if self.at > len(self.bits):
            raise ValueError("the coded data end early")
        last = (self.at + 7) >> 3
        return int.from_bytes(self.data[first >> 3 : last], "big") >> (last * 8 - self.at) & ((1 << n) - 1)

    def takes(self, count: int, n: int) -> np.ndarray:
        """count integers of n bits each."""
        first, self.at = self.at, self.at + count * n
        if self.at > len(self.bits):
            raise ValueError("the coded data end early")
        return self.bits[first : self.at].reshape(count, n) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))

    def unaries(self, count: int) -> np.ndarray:
        """count numbers of zeros, each up to the next one."""
        first = int(np.searchsorted(self.ones, self.at))
        ends = self.ones[first : first + count]
        if len(ends) < count:
            raise ValueError("the coded data end early")
        before, self.at = self.at - 1, int(ends[-1]) + 1 if count else self.at
        return np.diff(ends, prepend=before) - 1

    def unary(self) -> int:
        return int(self.unaries(1)[0])


def aec_decode(data: bytes, bits: int, flags: int, block: int, interval: int, n: int) -> np.ndarray:
    """CCSDS 121.0-B adaptive entropy coding: blocks of samples coded by splitting, second extension, zero runs or as they are,
    then mapped prediction residuals. flags: 8 for the preprocessor, 1 for signed samples. A block's codes are read together."""
    signed, predicts = bool(flags & 1), bool(flags & 8)
    id_bits = 3 if bits <= 8 else 4 if bits <= 16 else 5
    if flags & 16 and bits <= 4:  # restricted code set
        id_bits = 1 if bits <= 2 else 2
    top = (1 << bits) - 1
    r, out = _Bits(data), []
    while len(out) < n:
        samples: list[int] = []
        reference = None
        want = interval * block
        while len(samples) < want and len(out) + len(samples) < n:
            has_reference = predicts and not samples
            ident = r.take(id_bits)
            if ident == (1 << id_bits) - 1:  # as they are
                got = r.takes(block, bits).tolist()
                if has_reference:
                    reference = got[0]
            elif ident == 0:
                second = r.take(1)
                if has_reference:
                    reference = r.take(bits)
                if second:
                    got = [0] if has_reference else []
                    k = 1 if has_reference else 0
                    while k < block:
                        m, beta = r.unary(), 0
                        while (beta + 1) * (beta + 2) // 2 <= m:
                            beta += 1
                        delta1 = m - beta * (beta + 1) // 2
                        if k % 2 == 0:
                            got.append(beta - delta1)
                            k += 1
                        got.append(delta1)
                        k += 1
                else:
                    zeros = r.unary() + 1
                    if zeros == 5:
                        left = interval - len(samples) // block
                        zeros = min(left, 64 - len(samples) // block % 64)
                    elif zeros > 5:
                        zeros -= 1
                    got = [0] * (zeros * block)
            else:
                k = ident - 1
                if has_reference:
                    reference = r.take(bits)
                first = 1 if has_reference else 0
                high = r.unaries(block - first)
                got = [0] * first + ((high << k) | r.takes(block - first, k) if k else high).tolist()
            samples += got
        samples = samples[:want]
        if predicts:
            low, most = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, top)
            x = reference - (1 << bits) if signed and reference >> (bits - 1) else reference
            values = [x]
            for d in samples[1:]:
                theta = min(x - low, most - x)
                delta = (d >> 1 if not d & 1 else -((d + 1) >> 1)) if d <= 2 * theta else (d - theta if theta == x - low else theta - d)
                x += delta
                values.append(x)
            samples = values
        out += samples
    return np.array(out[:n], "f8")
