import json
import struct

import numpy as np
import pytest
import zstandard

from tidewright.sources import codecs, readers


@pytest.fixture(scope="module")
def sources(spark):
    readers.register(spark)
    return spark


def test_npz(sources, tmp_path):
    np.savez(tmp_path / "a.npz", m=np.array([[1.0, np.nan], [3.0, 4.0]]), names=np.array(["M2", "S2"]), k=np.arange(3, dtype="i4"))
    got = {r.array: r for r in sources.read.format("npz").load(str(tmp_path)).collect()}
    assert got["m"].shape == [2, 2] and got["m"]["values"] == [1.0, None, 3.0, 4.0]
    assert got["names"].texts == ["M2", "S2"] and got["k"]["values"] == [0.0, 1.0, 2.0]


def test_polar(sources, tmp_path):
    (tmp_path / "boat.pol").write_text("twa/tws\t6\t10\n40\t4\t5\n80\t\t7\n120\t6\t8\n")
    got = {(r.twa, round(r.tws / readers.KNOT)): r.speed / readers.KNOT for r in sources.read.format("polar").load(str(tmp_path / "boat.pol")).collect()}
    assert len(got) == 6 and abs(got[80.0, 6] - 5.0) < 1e-9 and abs(got[120.0, 10] - 8) < 1e-9
    with pytest.raises(ValueError, match="row 2"):
        readers.parse_polar("twa,6\nx,1", ",")
    with pytest.raises(ValueError, match="column 2"):
        readers.parse_polar("twa,6\n40,", ",")


def shapefile(records):
    body = b""
    for i, rings in enumerate(records, 1):
        points = [p for r in rings for p in r]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        starts = np.cumsum([0, *(len(r) for r in rings)])[:-1]
        content = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + np.array(starts, "<i4").tobytes() + np.array(points, "<f8").tobytes()
        body += struct.pack(">2i", i, len(content) // 2) + content
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def test_shapefile(sources, tmp_path):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    (tmp_path / "a.shp").write_bytes(shapefile([[square(0, 0, 10), square(2, 2, 3)], [square(50, 50, 5)]]))
    df = sources.read.format("shapefile").load(str(tmp_path / "a.shp"))
    assert df.count() == 12 and df.where("poly = 1 and ring = 1").count() == 4
    assert {r.poly for r in sources.read.format("shapefile").option("bbox", "40,40,60,60").load(str(tmp_path / "a.shp")).collect()} == {2}


def blosc(data: bytes, width: int, shuffled: int, codec: int = 4, block: int = 0) -> bytes:
    block = block or len(data)
    if shuffled == 1:
        data = b"".join(np.frombuffer(data[i : i + block], np.uint8).reshape(-1, width).T.tobytes() for i in range(0, len(data), block))
    starts, packed, at = [], b"", 16 + 4 * -(-len(data) // block)
    for i in range(0, len(data), block):
        starts.append(at + len(packed))
        piece = zstandard.ZstdCompressor().compress(data[i : i + block])
        packed += struct.pack("<i", len(piece)) + piece
    head = bytes([2, 1, shuffled | 16 | codec << 5, width]) + struct.pack("<3I", len(data), block, at + len(packed))
    return head + struct.pack(f"<{len(starts)}I", *starts) + packed


def test_codecs():
    data = np.arange(500, dtype="<f4").tobytes()
    assert codecs.blosc_decompress(blosc(data, 4, 1)) == data and codecs.blosc_decompress(blosc(data, 4, 0, block=512)) == data
    assert codecs.blosc_decompress(bytes([2, 1, 2, 4]) + struct.pack("<3I", 5, 5, 21) + b"plain") == b"plain"
    # literals, then a match that overlaps itself
    assert codecs.lz4_block(bytes([0x35]) + b"abc" + bytes([3, 0]) + bytes([0x10]) + b"z", 13) == b"abcabcabcabcz"
    with pytest.raises(ValueError):
        codecs.lz4_block(bytes([0x10]) + b"a" + bytes([9, 0]), 5)
    raw = np.random.default_rng(0).integers(0, 256, 64, dtype=np.uint8)
    planes = np.packbits(np.unpackbits(raw.reshape(-1, 4), axis=1, bitorder="little").reshape(16, 32).T.reshape(32, 16), axis=1, bitorder="little").tobytes()
    assert codecs.bit_unshuffle(planes, 4) == raw.tobytes()
    x = np.random.default_rng(1).integers(0, 1 << 11, 33)
    bits = np.unpackbits(x.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 5:].ravel()
    assert (codecs.unpack_bits(np.packbits(bits).tobytes(), 11, 33) == x).all()


def test_zarr(sources, tmp_path):
    root = tmp_path / "z" / "u"
    root.mkdir(parents=True)
    values = np.arange(30, dtype="<f4").reshape(5, 6)
    values[1, 1] = 9e36
    (root / ".zarray").write_text(json.dumps({"shape": [5, 6], "chunks": [3, 4], "dtype": "<f4", "fill_value": 9e36, "compressor": {"id": "blosc"}, "order": "C", "zarr_format": 2}))
    for i in range(2):
        for j in range(2):
            chunk = np.full((3, 4), 9e36, "<f4")
            part = values[i * 3 : i * 3 + 3, j * 4 : j * 4 + 4]
            chunk[: part.shape[0], : part.shape[1]] = part
            (root / f"{i}.{j}").write_bytes(blosc(chunk.tobytes(), 4, 1))
    got = {r.idx: r.v for r in sources.read.format("zarr").option("array", "u").load(str(tmp_path / "z")).collect()}
    assert got == {i: (None if i == 7 else float(i)) for i in range(30)}
    (root / "1.1").unlink()
    gone = {r.idx: r.v for r in sources.read.format("zarr").option("array", "u").load(f"file://{tmp_path}/z").collect()}
    assert gone == {i: (None if i in (7, 22, 23, 28, 29) else float(i)) for i in range(30)}  # a chunk that is not there is all null
    some = sources.read.format("zarr").option("array", "u").option("select", "0:2,4:6").load(str(tmp_path / "z"))
    assert {r.chunk for r in some.collect()} == {"0.1"}


def grib(values, bits, present=None, packing=0):
    n_lon, n_lat = 4, 2
    s1 = struct.pack(">IB", 21, 1) + bytes(16)
    s3 = bytearray(72)
    s3[:5] = struct.pack(">IB", 72, 3)
    struct.pack_into(">I", s3, 6, 8)
    struct.pack_into(">2I", s3, 30, n_lon, n_lat)
    struct.pack_into(">2I", s3, 46, (1 << 31) | 10_000_000, 20_000_000)
    struct.pack_into(">2I", s3, 55, (1 << 31) | 11_000_000, 23_000_000)
    struct.pack_into(">2I", s3, 63, 1_000_000, 1_000_000)
    s4 = bytearray(37)
    s4[:5] = struct.pack(">IB", 37, 4)
    struct.pack_into(">H", s4, 7, 1)
    s4[9], s4[10], s4[17], s4[35] = 2, 3, 1, 7
    struct.pack_into(">I", s4, 18, 12)
    reference, d = min(values), 1
    coded = [round((v - reference) * 10) for v in values]
    body = np.packbits(np.array([[c >> i & 1 for i in range(bits - 1, -1, -1)] for c in coded]).ravel()).tobytes()
    s5 = struct.pack(">IBIHfHHBB", 21, 5, len(values), packing, reference * 10, 0, d, bits, 0)
    s6 = struct.pack(">IBB", 6, 6, present or 255) if present is None or present == 254 else struct.pack(">IBB", 7, 6, 0) + np.packbits(present).tobytes()
    s7 = struct.pack(">IB", 5 + len(body), 7) + body
    rest = s1 + bytes(s3) + bytes(s4) + s5 + s6 + s7 + b"7777"
    return b"GRIB\0\0" + bytes([0, 2]) + struct.pack(">Q", 16 + len(rest)) + rest


def test_grib(sources, tmp_path):
    whole, holed = [1.0, 2.5, 3.0, 0.5, 9.0, 4.0, 2.0, 1.5], [True] * 5 + [False] + [True] * 2
    (tmp_path / "a.grib2").write_bytes(grib(whole, 7) + grib([v for v, p in zip(whole, holed, strict=True) if p], 9, holed))
    a, b = sources.read.format("grib2").load(str(tmp_path)).orderBy("message").collect()
    assert np.allclose(a["values"], whole) and (a.category, a.parameter, a.step_h, a.member, a.n_lon, a.lat0, a.d_lat) == (2, 3, 12.0, 7, 4, -10.0, -1.0)
    assert b["values"][5] is None and np.allclose([v for v in b["values"] if v is not None], [v for v, p in zip(whole, holed, strict=True) if p])
    few = [v for v, p in zip(whole, holed, strict=True) if p]
    again = list(codecs.grib2_messages(grib(few, 9, holed) + grib(whole, 7) + grib(few, 7, 254)))  # the bitmap of the first message
    assert [np.isnan(m["values"]).tolist() for m in again] == [[not p for p in holed], [False] * 8, [not p for p in holed]]
    with pytest.raises(ValueError, match="5.3"):
        list(codecs.grib2_messages(grib(whole, 7, packing=3)))


def test_entropy_coding_round_trip():
    """Blocks coded by splitting, as they are, in zero runs and by second extension, after the preprocessor."""
    rng = np.random.default_rng(2)
    bits, block, interval = 8, 8, 4
    values = np.concatenate([np.cumsum(rng.integers(-3, 4, 24)) + 100, np.full(16, 90), rng.integers(0, 256, 16), 50 + rng.integers(0, 2, 8)]).clip(0, 255).astype(int)
    out, at = "", 0
    b = lambda v, n: format(v, f"0{n}b") if n else ""
    while at < len(values):
        part = values[at : at + block * interval]
        mapped = [0]
        for p, v in zip(part, part[1:], strict=False):
            theta, d = min(p, 255 - p), v - p
            mapped.append((2 * d if d >= 0 else -2 * d - 1) if abs(d) <= theta else theta + abs(d))
        for k, s in enumerate(range(0, len(part), block)):
            m, ref = mapped[s : s + block], b(int(part[0]), bits) if k == 0 else ""
            if k and not any(m):
                out += b(0, 3) + "0" + "1"  # one block of zeros
            elif k and max(m) <= 2:
                pairs = [(x, y) for x, y in zip(m[::2], m[1::2], strict=True)]
                out += b(0, 3) + "1" + "".join("0" * ((x + y) * (x + y + 1) // 2 + y) + "1" for x, y in pairs)
            elif max(m) > 60:
                out += b(7, 3) + "".join(b(int(v), bits) for v in ([int(part[0])] if k == 0 else []) + m[1 if k == 0 else 0 :])
            else:
                rest = m[1:] if k == 0 else m
                out += b(2, 3) + ref + "".join("0" * (x >> 1) + "1" for x in rest) + "".join(b(x & 1, 1) for x in rest)
        at += block * interval
    data = int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")
    assert codecs.aec_decode(data, bits, 8, block, interval, len(values)).tolist() == values.tolist()


def test_entropy_decoding_of_a_large_field():
    """Split codes alone, written as arrays; what a read costs does not grow with its place."""
    rng = np.random.default_rng(4)
    block, interval, k, n = 16, 8, 3, 160_000
    residuals = rng.integers(0, 60, n)
    parts = []
    for s in range(0, n, block):
        d = residuals[s : s + block]
        first = s % (block * interval) == 0
        d = d[1:] if first else d
        unary = np.zeros((d >> k).sum() + len(d), np.uint8)
        unary[np.cumsum((d >> k) + 1) - 1] = 1
        head = np.unpackbits(np.array([k + 1], np.uint8))[4:]
        reference = np.unpackbits(np.array([0x80, 0x00], np.uint8)) if first else np.zeros(0, np.uint8)
        parts += [head, reference, unary, (d[:, None] >> np.arange(k - 1, -1, -1) & 1).astype(np.uint8).ravel()]
    got = codecs.aec_decode(np.packbits(np.concatenate(parts)).tobytes(), 16, 8, block, interval, n).astype(int)
    want = np.where(residuals % 2 == 0, residuals // 2, -(residuals + 1) // 2)
    for s in range(0, n, block * interval):
        assert got[s] == 0x8000 and (np.diff(got[s : s + block * interval]) == want[s + 1 : s + block * interval]).all()
