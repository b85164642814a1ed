"""Python data sources for the binary and text formats of gridded forecasts and boats: register(spark), then
spark.read.format("npz" | "grib2" | "zarr" | "shapefile" | "polar").load(path).

Each has one partition a file (a chunk, for Zarr), listed on the driver and read by the tasks, and yields Arrow batches or rows of plain
columns. Paths may be local, mounted on every executor, or URIs of an object store. The option `where` (see pushdown) is known to `grib2`, on path,
message and the message's metadata: values of other messages are neither read nor unpacked; to `zarr`, on chunk and idx: other chunks are
no partitions; and to `tiles`."""

from __future__ import annotations

import io
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewright.sources import codecs, files
from tidewright.sources.pushdown import Conditions
from tidewright.sources.tiles import TilesSource


class FilePartition(InputPartition):
    def __init__(self, path: str, extra: object = None):
        self.path, self.extra = path, extra


class _Reader(DataSourceReader):
    pattern = "*"

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in files.listed(self.options["path"], self.pattern)] or [FilePartition("")]


class NpzSource(DataSource):
    """Arrays of .npz files: path, array, shape, and the values in C order as doubles (null for NaN)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, array string, shape array<int>, values array<double>, texts array<string>"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options)


class NpzReader(_Reader):
    pattern = "*.npz"

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with np.load(io.BytesIO(files.read(partition.path)), allow_pickle=False) as found:
            for name in found.files:
                a = found[name]
                if a.dtype.kind in "US":
                    yield partition.path, name, list(a.shape), None, [str(x) for x in a.ravel()]
                else:
                    flat = a.astype("f8").ravel()
                    yield partition.path, name, list(a.shape), [None if x != x else float(x) for x in flat], None


class PolarSource(DataSource):
    """Boat-speed tables (.csv comma, .pol or .tsv tab): a header of wind speeds in knots, rows of angle and speeds in knots.
    polar, twa, tws (m/s), speed (m/s). Empty cells are filled linearly along the angle; a bad row's error names it."""

    @classmethod
    def name(cls) -> str:
        return "polar"

    def schema(self) -> str:
        return "polar string, twa double, tws double, speed double"

    def reader(self, schema) -> DataSourceReader:
        return PolarReader(self.options)


KNOT = 1852.0 / 3600.0


def parse_polar(text: str, delimiter: str, label: str = "polar") -> list[tuple[float, float, float]]:
    """(twa, tws, speed) of a table; speeds in m/s."""
    lines = [(n, line.split(delimiter)) for n, line in enumerate(text.replace("\r", "").split("\n"), 1) if line.strip()]
    if len(lines) < 2:
        raise ValueError(f"{label}: a header and at least one row are needed")
    tws = [float(x) * KNOT for x in lines[0][1][1:] if x.strip()]
    angles, grid = [], []
    for n, cells in lines[1:]:
        try:
            angles.append(float(cells[0]))
            grid.append([float(c) * KNOT if c.strip() else np.nan for c in (cells[1:] + [""] * len(tws))[: len(tws)]])
        except ValueError:
            raise ValueError(f"{label}: row {n} is not numbers: {delimiter.join(cells)[:60]}") from None
    order = np.argsort(angles, kind="stable")
    a, g = np.array(angles)[order], np.array(grid)[order]
    for j in range(len(tws)):
        has = np.isfinite(g[:, j])
        if not has.any():
            raise ValueError(f"{label}: column {j + 2} is empty")
        g[:, j] = np.interp(a, a[has], g[has, j])
    return [(float(a[i]), tws[j], float(g[i, j])) for i in range(len(a)) for j in range(len(tws))]


class PolarReader(_Reader):
    pattern = "*.[cpt][sol][vl]"

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition.path:
            name = os.path.splitext(os.path.basename(partition.path))[0]
            for row in parse_polar(files.read(partition.path).decode("utf-8-sig"), "," if partition.path.endswith(".csv") else "\t", name):
                yield (name, *row)


class ShapefileSource(DataSource):
    """Polygon edges (types 5, 15, 25): path, poly, ring, i, x0, y0, x1, y1. Option bbox = "west,south,east,north" skips records whose box lies outside."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "path string, poly int, ring int, i int, x0 double, y0 double, x1 double, y1 double"

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options)


class ShapefileReader(_Reader):
    pattern = "*.shp"

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        box = [float(x) for x in self.options["bbox"].split(",")] if self.options.get("bbox") else None
        with files.opened(partition.path) as f:
            head = f.read(100)
            if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
                raise ValueError(f"{partition.path} is not a shapefile")
            while len(record := f.read(8)) == 8:
                number, words = struct.unpack(">2i", record)
                body = f.read(2 * words)
                kind = struct.unpack_from("<i", body)[0]
                if kind not in (5, 15, 25):
                    continue
                w, s, e, n = struct.unpack_from("<4d", body, 4)
                if box and (w > box[2] or e < box[0] or s > box[3] or n < box[1]):
                    continue
                n_parts, n_points = struct.unpack_from("<2i", body, 36)
                starts = np.append(np.frombuffer(body, "<i4", n_parts, 44), n_points)
                xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
                for ring in range(n_parts):
                    p = xy[starts[ring] : starts[ring + 1]]
                    m = len(p) - 1
                    if m > 0:
                        full = lambda v, t="i4", m=m: pa.array(np.full(m, v, t))
                        yield pa.record_batch([pa.array([partition.path] * m), full(number), full(ring), pa.array(np.arange(m, dtype="i4")), *(pa.array(np.ascontiguousarray(c)) for c in (p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1]))], names=["path", "poly", "ring", "i", "x0", "y0", "x1", "y1"])


class ZarrSource(DataSource):
    """A Zarr v2 array (option array, or the path's own): one partition a chunk; idx (element in C order), v (null for fill). Blosc or raw chunks."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> str:
        return "chunk string, idx long, v double"

    def reader(self, schema) -> DataSourceReader:
        return ZarrReader(self.options)


class ZarrReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.where = Conditions(self.options, ["chunk", "idx"])
        self.root = os.path.join(options["path"], options.get("array", ""))
        own, whole = os.path.join(self.root, ".zarray"), os.path.join(options["path"], ".zmetadata")
        if files.exists(own):
            self.meta = json.loads(files.read(own))
        else:  # consolidated
            self.meta = json.loads(files.read(whole))["metadata"][f"{options.get('array', '')}/.zarray"]

    def _may_hold(self, key: tuple[int, ...]) -> bool:
        shape, chunks = self.meta["shape"], self.meta["chunks"]
        ends = [([k * c for k, c in zip(key, chunks, strict=True)]), [min((k + 1) * c, n) - 1 for k, c, n in zip(key, chunks, shape, strict=True)]]
        low, high = (int(np.ravel_multi_index(e, shape)) for e in ends)
        return self.where.accept(chunk=".".join(map(str, key))) and self.where.may_meet("idx", low, high)

    def partitions(self) -> list[InputPartition]:
        """Chunks that bear on the option `select`, "lo:hi,lo:hi,…" by axis, and on the option `where`."""
        shape, chunks = self.meta["shape"], self.meta["chunks"]
        asked = [tuple(int(x) for x in s.split(":")) if ":" in s else (0, n) for s, n in zip((self.options.get("select") or ",".join("*" for _ in shape)).split(","), shape, strict=True)]
        counts = [range(lo // c, -(-min(hi, n) // c)) for (lo, hi), c, n in zip(asked, chunks, shape, strict=True)]
        keys = [()]
        for r in counts:
            keys = [(*k, i) for k in keys for i in r]
        return [FilePartition(os.path.join(self.root, ".".join(map(str, k))), k) for k in keys if self._may_hold(k)] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        shape, chunks, fill = self.meta["shape"], self.meta["chunks"], self.meta.get("fill_value")
        if not partition.path:
            return
        if files.exists(partition.path):
            raw = files.read(partition.path)
            compressor = self.meta.get("compressor")
            if compressor:
                if compressor["id"] != "blosc":
                    raise ValueError(f"compressor {compressor['id']} is not supported")
                raw = codecs.blosc_decompress(raw)
            a = np.frombuffer(raw, self.meta["dtype"]).reshape(chunks).astype("f8")
        else:  # a chunk that was not written is all fill
            a = np.full(chunks, np.nan)
        origin = [k * c for k, c in zip(partition.extra, chunks, strict=True)]
        index = np.ravel_multi_index(np.meshgrid(*(np.minimum(o + np.arange(c), n - 1) for o, c, n in zip(origin, chunks, shape, strict=True)), indexing="ij"), shape)
        inside = np.ones(chunks, bool)
        for axis, (o, c, n) in enumerate(zip(origin, chunks, shape, strict=True)):
            inside &= (o + np.arange(c) < n).reshape([-1 if i == axis else 1 for i in range(len(shape))])
        v = a[inside]
        missing = ~np.isfinite(v) | (v == np.float64(np.dtype(self.meta["dtype"]).type(fill)) if fill is not None and fill != "NaN" else False)
        batch = pa.record_batch([pa.array([os.path.basename(partition.path)] * len(v)), pa.array(index[inside].astype("i8")), pa.array(v, mask=missing)], names=["chunk", "idx", "v"])
        if any(c[0] == "idx" for c in self.where.all):
            batch = batch.filter(pa.array([self.where.accept(idx=i) for i in batch["idx"].to_pylist()], pa.bool_()))
        yield batch


class GribSource(DataSource):
    """GRIB2 messages: path, message, discipline, category, parameter, step_h, member, the grid's geometry, and values (null where
    masked), rows as stored. Grid template 3.0; product templates 4.0, 4.1 and 4.8; packing 5.0 and 5.42."""

    @classmethod
    def name(cls) -> str:
        return "grib2"

    def schema(self) -> str:
        return "path string, message int, discipline int, category int, parameter int, step_h double, member int, interval_h double, n_lon int, n_lat int, lat0 double, lon0 double, d_lat double, d_lon double, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return GribReader(self.options)


class GribReader(_Reader):
    pattern = "*.gri*b*"
    described = ("discipline", "category", "parameter", "step_h", "member", "interval_h")

    def __init__(self, options: dict):
        super().__init__(options)
        self.where = Conditions(self.options, ["path", "message", *self.described])

    def partitions(self) -> list[InputPartition]:
        return [p for p in super().partitions() if p.path and self.where.accept(path=p.path)] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition.path:
            wanted = lambda i, m: self.where.accept(message=i, **{k: m[k] for k in self.described})
            with files.opened_at(partition.path) as f:
                for i, m in codecs.grib2_scan(f, files.size(partition.path), wanted):
                    values = m.pop("values")
                    m.pop("present")
                    yield (partition.path, i, *m.values(), [None if x != x else float(x) for x in values])


def register(spark) -> None:
    for source in (NpzSource, PolarSource, ShapefileSource, ZarrSource, GribSource, TilesSource):
        spark.dataSource.register(source)


_RUN = re.compile(r"(\d{8})T?(\d{2})")


def run_of(name: str) -> str | None:
    """The cycle named in a file's name: yyyymmddhh."""
    m = _RUN.search(name)
    return m and m[1] + m[2]
