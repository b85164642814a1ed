"""Conditions that sources apply as they read, and the tile sink."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import grib, sources  # noqa: F401

from tidewright.sources import codecs, files, readers, tiles
from tidewright.sources.pushdown import where


def test_grib_reads_what_is_asked(sources, tmp_path):  # noqa: F811
    few = [1.0, 2.5, 3.0, 0.5, 9.0, 4.0, 2.0]
    other = bytearray(grib([float(i) for i in range(8)], 7))
    at = other.find(bytes([2, 3, 0]), 100)
    other[at + 1] = 77  # another parameter
    holed = [True] * 5 + [False] + [True] * 2
    data = b"junk" * 3 + grib(few, 7, holed) + bytes(other) + b"\0" * 70_000 + grib(few, 7, 254)
    (tmp_path / "a.grib2").write_bytes(data)
    (tmp_path / "b.grib2").write_bytes(b"")
    whole = sources.read.format("grib2").load(str(tmp_path))
    rows = whole.orderBy("message").collect()
    assert [r.parameter for r in rows] == [3, 77, 3] and [r["values"].index(None) if None in r["values"] else -1 for r in rows] == [5, -1, 5]
    read = lambda *conditions: sources.read.format("grib2").option("where", where(*conditions)).load(str(tmp_path))
    some = read(("parameter", "=", 77), ("step_h", ">=", 6), ("member", "is not null"))
    assert [(r.message, r["values"]) for r in some.collect()] == [(1, rows[1]["values"])]
    # two loads of one query keep their own conditions
    assert some.unionByName(read(("parameter", "=", 3))).select("message").orderBy("message").collect() == [(0,), (1,), (2,)]
    # the bitmap of a message that is left out is still that of a later one
    assert [r["values"] for r in read(("message", "=", 2)).collect()] == [rows[2]["values"]]
    for c in (("parameter", "<>", 3), ("parameter", "in", [77, 5]), ("interval_h", "is null"), ("member", ">", 7), ("interval_h", "<>", 1), ("interval_h", "=", None), ("path", "=", rows[0].path), ("path", "<", "a")):
        literal = [] if len(c) < 3 else ["(77, 5)" if c[1] == "in" else "null" if c[2] is None else repr(c[2])]
        assert read(c).count() == whole.where(" ".join([*c[:2], *literal])).count(), c
    for c in (("n_lon", "=", 4), ("parameter", "like", "x"), ("parameter", "="), ("parameter", "is null", 3)):
        with pytest.raises(Exception, match="condition"):
            read(c).count()

    class Counting:
        def __init__(self, f):
            self.f, self.seek, self.bytes = f, f.seek, 0

        def read(self, n):
            got = self.f.read(n)
            self.bytes += len(got)
            return got

    large = grib([0.0, 1.0] * 4, 7)
    path = tmp_path / "c.bin"
    body = large[:-4] + bytes(200_000)  # a long last section
    start = body.find(bytes([7]), len(large) - 20)
    body = bytearray(body + b"7777")
    body[start - 4 : start] = (int.from_bytes(body[start - 4 : start], "big") + 200_000).to_bytes(4, "big")
    body[8:16] = len(body).to_bytes(8, "big")
    path.write_bytes(bytes(body) * 3)
    with open(path, "rb") as f:
        counting = Counting(f)
        assert [i for i, _ in codecs.grib2_scan(counting, path.stat().st_size, lambda i, m: i == 1)] == [1]
        assert counting.bytes < len(body) + 3000


def test_zarr_chunks_are_pruned(sources, tmp_path):  # noqa: F811
    values = np.arange(30, dtype="<f4").reshape(5, 6)
    (tmp_path / ".zarray").write_text(json.dumps({"shape": [5, 6], "chunks": [2, 4], "dtype": "<f4", "fill_value": None, "compressor": None, "order": "C", "zarr_format": 2}))
    for i in range(3):
        for j in range(2):
            chunk = np.zeros((2, 4), "<f4")
            part = values[i * 2 : i * 2 + 2, j * 4 : j * 4 + 4]
            chunk[: part.shape[0], : part.shape[1]] = part
            (tmp_path / f"{i}.{j}").write_bytes(chunk.tobytes())
    whole = {r.idx: r.v for r in sources.read.format("zarr").load(str(tmp_path)).collect()}
    assert whole == {i: float(i) for i in range(30)}
    for conditions, chunks, want in (
        ([("idx", "<", 5)], 2, range(5)),
        ([("idx", ">=", 12), ("idx", "<=", 20)], 2, range(12, 21)),
        ([("idx", "in", [3, 29])], 2, [3, 29]),
        ([("chunk", "=", "1.1")], 1, [16, 17, 22, 23]),
        ([("chunk", "=", "9.9")], 1, []),  # one without rows
        ([("idx", ">=", 24), ("chunk", "<>", "2.0")], 1, [28, 29]),
        ([("idx", ">", 100)], 1, []),
        ([("idx", "<>", 4)], 6, [i for i in range(30) if i != 4]),
        ([("idx", "is null")], 1, []),
    ):
        got = sources.read.format("zarr").option("where", where(*conditions)).load(str(tmp_path))
        assert got.rdd.getNumPartitions() == chunks, conditions
        assert {r.idx: r.v for r in got.collect()} == {i: float(i) for i in want}


def test_tile_sink(sources, tmp_path, monkeypatch):  # noqa: F811
    root = str(tmp_path / "tiles")
    assert sources.read.format("tiles").load(root).count() == 0
    rows = [(f"wind/{i % 2}", 3 + i % 3, i % 7, i // 7, 490_000 + i % 2, None if i == 9 else json.dumps({"v": i, "s": "é" * (i % 50)})) for i in range(210)]
    df = sources.createDataFrame(rows, "layer string, z int, x int, y int, hour long, body string").withColumn("more", F.lit(1))
    tiles.write_tiles(df, root)
    whole = sources.read.format("tiles").load(root)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in whole.collect()), key=key) == sorted(rows, key=key)
    some = sources.read.format("tiles").option("where", where(("layer", "=", "wind/1"), ("z", "=", 4), ("x", ">=", 3))).load(root)
    assert sorted((tuple(r)[:6] for r in some.collect()), key=key) == sorted((r for r in rows if r[0] == "wind/1" and r[1] == 4 and r[2] >= 3), key=key)
    reader = lambda *c: tiles.TilesReader({"path": root, "where": where(*c)}).partitions()
    paths = lambda *c: [f[0] for p in reader(*c) for f in p.files]
    assert len(reader()) == 1 and len(paths()) >= 6 and all("layer=wind%2F1/z=4/" in f for f in paths(("layer", "=", "wind/1"), ("z", "=", 4)))
    assert not paths(("hour", ">", 490_001)) and 0 < len(paths(("hour", "=", 490_000))) <= len(paths())
    for c, left in ((("hour", "=", 490_001), lambda r: r[4] == 490_001), (("y", "<", 3), lambda r: r[3] < 3)):
        got = sources.read.format("tiles").option("where", where(c)).load(root).collect()
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(filter(left, rows), key=key)
    # a second job's tiles are newer; one that fails leaves what was there
    tiles.write_tiles(df.where("x = 1").withColumn("body", F.lit("{}")), root)
    last = tiles.newest(sources.read.format("tiles").load(root))
    assert sorted((tuple(r)[:6] for r in last.collect()), key=key) == sorted(((*r[:5], "{}") if r[2] == 1 else r for r in rows), key=key)
    with pytest.raises(Exception, match="a tile's z is null"):
        tiles.write_tiles(df.withColumn("z", F.when(F.col("x") != 5, F.col("z"))), root)
    assert tiles.newest(sources.read.format("tiles").load(root)).count() == len(rows)
    (tmp_path / "tiles" / "layer=wind%2F1" / "z=4" / "lost-0.tiles").write_bytes(b"left by a lost task")
    assert tiles.newest(sources.read.format("tiles").load(root)).count() == len(rows)
    tiles.write_tiles(df.where("x = 2"), root, overwrite=True)
    assert sources.read.format("tiles").load(root).count() == 30
    tiles.write_tiles(df.where("false"), root, overwrite=True)
    assert sources.read.format("tiles").load(root).count() == 0


def test_sink_rolls_and_takes_rows_in_any_order(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tiles, "ROLL", 60)
    writer = tiles.TilesWriter(str(tmp_path), False)
    batch = pa.record_batch({"layer": ["a", "b", "a", "a", "a"], "z": [1] * 5, "x": [0, 1, 2, 3, 4], "y": [0] * 5, "hour": [7] * 5, "body": ["{}"] * 5})
    message = writer.write(iter([batch, batch.slice(0, 0)]))
    names = [f[0] for f in message.files]
    assert len(names) == 4 == len(set(names))
    writer.commit([message, None])
    reader = tiles.TilesReader({"path": str(tmp_path)})
    assert sorted(r[:4] for p in reader.partitions() for r in reader.read(p)) == [("a", 1, x, 0) for x in (0, 2, 3, 4)] + [("b", 1, 1, 0)]
    writer.abort([message])
    assert not any(files.exists(f"{tmp_path}/{n}") for n in names) and readers.TilesSource is tiles.TilesSource
