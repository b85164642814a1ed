"""What the operators of this subpackage share: table access, the shared folder, ordered blocks and whole-partition Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the token contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh temporary one where none is set and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, columns can be pruned, and a lost executor loses nothing."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def slots(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, columns: list[str]) -> str:
    """A column name like `name` that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_order(docs: DataFrame, by: list, columns: list[str], text: str = "text", most: int = 128 << 20) -> DataFrame:
    """Rows range-partitioned by the first key and sorted by all, so that partition number, then place, is the order. There are as many
    partitions as make `most` bytes of text each, and the session's at least. Only the first key is sampled for the bounds; rows
    equal in it share a partition."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(slots(docs.sparkSession), -(-size // most))
    return docs.select(*columns).repartitionByRange(n, by[0]).sortWithinPartitions(*by)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column; null counts as empty. No copy of the column is made."""
    kind = pa.large_string() if pa.types.is_large_string(column.type) else pa.string()
    column = column.cast(kind)
    import numpy as np

    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(kind) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(len(column) + 1, width)
    raw = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(raw[at[i] : at[i + 1]]) if valid is None or valid[i] else b""


def crc_mod(column: str, n: int):
    """crc32 of the value as text, mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def total(df: DataFrame, column: str, n: int, dtype: str = "<i8"):
    """The sum of binary columns that each hold n numbers. Groups of rows are added up on the executors first."""
    import numpy as np

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n, dtype)
        for batch in batches:
            for x in batch.column(0):
                out += np.frombuffer(x.as_buffer(), dtype)
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["part"])

    parts = df.select(column).repartition(max(2, int(slots(df.sparkSession) ** 0.5))).mapInArrow(add, "part binary")
    return sum((np.frombuffer(r[0], dtype) for r in parts.collect()), np.zeros(n, dtype))
