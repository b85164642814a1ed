"""Encoded map tiles: df.write.format("tiles").mode("append" | "overwrite").save(path) and spark.read.format("tiles").load(path).

A tile is layer, z, x, y, hour (hours since 1970 in UTC) and body, its JSON text. Each task packs its tiles, gzipped, into files under
layer=…/z=…, a new one for each change of these and beyond `ROLL` bytes, so that it holds one tile at a time whatever the order of the
rows; write_tiles() lays rows out in ranges, so that files are few and hold few hours. A job's files count once its record in `_commits`,
written last, names them with their hours and sizes: what a failed or repeated task left behind is never read. An overwriting job's
record takes the place of all before it; `commit` orders the rest, and newest() keeps the last written of a tile.

The option `where` (see pushdown) prunes files by layer, z and hour, and passes over tiles that hour, x or y leave out without unpacking them. Files are
read together up to `ROLL` bytes a partition.
A null body stays null; a null in any other column fails the write; no tiles, or no folder, is an empty table.
"""

from __future__ import annotations

import gzip
import json
import struct
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewright.sources import files
from tidewright.sources.pushdown import Conditions

KEYS = ["layer", "z", "x", "y", "hour"]
ROLL, OPENING = 128 << 20, 1 << 20  # bytes of a file or partition, and those that opening a file is taken to cost
_HEAD = struct.Struct(">qqqq")  # hour, x, y, bytes of the body (-1: null)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int, int]]  # name, first and last hour, bytes


@dataclass
class TileFiles(InputPartition):
    files: list[tuple[str, str, int, int]]  # path, layer, z, commit


class TilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return "layer string, z int, x long, y long, hour long, body string, commit long"

    def reader(self, schema) -> DataSourceReader:
        return TilesReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TilesWriter(self.options["path"].rstrip("/"), overwrite)


class TilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, int, int, int]] = []
        group, out, name, hours = None, None, "", []
        task = uuid.uuid4().hex  # a repeated task writes files of its own
        try:
            for batch in iterator:
                columns = [batch.column(k) for k in (*KEYS, "body")]
                for k, c in zip(KEYS, columns, strict=False):
                    if c.null_count:
                        raise ValueError(f"a tile's {k} is null")
                for layer, z, x, y, hour, body in zip(*columns, strict=True):
                    at = hour.as_py()
                    if group != (layer, z) or out.tell() >= ROLL:
                        if out:
                            done.append((name, *hours, out.tell()))
                            out.close()
                        group, hours = (layer, z), [at, at]
                        name = f"layer={quote(layer.as_py(), safe='')}/z={z}/{self.job}-{task}-{len(done)}.tiles"
                        out = files.created(f"{self.root}/{name}")
                    hours = [min(hours[0], at), max(hours[1], at)]
                    packed = None if not body.is_valid else gzip.compress(body.as_py().encode(), mtime=0)
                    out.write(_HEAD.pack(at, x.as_py(), y.as_py(), -1 if packed is None else len(packed)) + (packed or b""))
            if out:
                done.append((name, *hours, out.tell()))
        finally:
            if out:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        stamp = time.time_ns()
        record = {"commit": stamp, "overwrite": self.overwrite, "files": sorted(f for m in messages if m for f in m.files)}
        name = f"{self.root}/_commits/{stamp:020d}-{self.job}.json"
        with files.created(f"{name}.part") as out:
            out.write(json.dumps(record).encode())
        files.moved(f"{name}.part", name)  # a record is seen whole

    def abort(self, messages: list[Written | None]) -> None:
        for name, *_ in (f for m in messages if m for f in m.files):
            files.deleted(f"{self.root}/{name}")


class TilesReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root, self.where = options["path"].rstrip("/"), Conditions(options, KEYS)

    def partitions(self) -> list[InputPartition]:
        found: list[tuple] = []
        for path in files.listed(f"{self.root}/_commits", "*.json"):
            record = json.loads(files.read(path))
            found = [] if record["overwrite"] else found
            for name, first, last, size in record["files"]:
                layer, z = (part.partition("=")[2] for part in name.split("/")[:2])
                found.append((f"{self.root}/{name}", unquote(layer), int(z), record["commit"], first, last, size))
        together: list[TileFiles] = []
        room = 0
        for path, layer, z, commit, first, last, size in found:
            if self.where.accept(layer=layer, z=z) and self.where.may_meet("hour", first, last):
                if size > room or not together:
                    together.append(TileFiles([]))
                    room = ROLL
                together[-1].files.append((path, layer, z, commit))
                room -= size + OPENING
        return together or [TileFiles([])]

    def read(self, partition: TileFiles) -> Iterator[tuple]:
        for path, layer, z, commit in partition.files:
            with files.opened_at(path) as f:
                while head := f.read(_HEAD.size):
                    hour, x, y, n = _HEAD.unpack(head)
                    if self.where.accept(hour=hour, x=x, y=y):
                        yield layer, z, x, y, hour, None if n < 0 else gzip.decompress(f.read(n)).decode(), commit
                    else:
                        f.seek(max(n, 0), 1)


def write_tiles(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """df: layer, z, x, y, hour, body. Rows are dealt out in ranges of layer, zoom, hour and place, so that no task has a whole layer or
    hour because it holds most tiles, and a task's files are few and hold hours next to each other."""
    rows = df.select("layer", F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"), F.col("hour").cast("long"), F.col("body").cast("string"))
    order = ("layer", "z", "hour", "y", "x")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.format("tiles").mode("overwrite" if overwrite else "append").save(path)


def newest(tiles: DataFrame) -> DataFrame:
    """The last written of each tile; of those that one job wrote, the greatest body (null before all)."""
    return tiles.groupBy(*KEYS).agg(F.max(F.struct("commit", "body")).alias("m")).select(*KEYS, "m.body", "m.commit")
