"""Token-ID output: Arrow files of equal-length sequences and masks.

A file is an Arrow IPC file (a stream with a footer) whose batches hold `ids`, a fixed-size list of the smallest unsigned
type the vocabulary fits, and `mask`, a fixed-size list of booleans (a bitmap) that are true where an id is real. Nothing is compressed, so a
memory-mapped file gives sequence i as a slice of the mapped bytes, without a copy and without reading another. Only a
file's last sequence is padded. Beside it lies a document index, `<file>.docs`: doc_id, start within the file, n_tokens.

Writing takes one pass: documents are range-partitioned by doc_id and sorted, each task streams its range into one file under
a name of its own attempt, and returns a manifest row. Only files of successful attempts are in the manifest, so a lost or
repeated task does no harm. Order of files, then of ids within, is the order of doc_id.

Defined results: a null or empty text is its end id alone; rows with an equal doc_id lie in the order of their text; a null
doc_id comes first; an empty table gives no file and no row; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import in_order, scratch, texts, written
from tidewright.llm.tokens import encoder as encoder_of

LENGTH = 2048
#: Sequences a record batch holds.
ROWS = 256


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class SequenceWriter:
    """Streams ids into one file; holds at most one batch of them."""

    def __init__(self, sink, dtype: np.dtype, length: int = LENGTH):
        self.length, self.dtype, self.pending, self.held, self.total = length, np.dtype(dtype), [], 0, 0
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"length": str(length)})
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * ROWS:
            flat = np.concatenate(self.pending)
            whole = len(flat) // (self.length * ROWS) * self.length * ROWS
            for at in range(0, whole, self.length * ROWS):
                self._batch(flat[at : at + self.length * ROWS], self.length * ROWS)
            self.pending, self.held = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.pending)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.out.close()


class SequenceFile:
    """Random access to a file of sequences. On a memory map or a buffer, `sequence` and `mask` are views."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(source)
        self.length = int(self.reader.schema.metadata[b"length"])
        self.batch: tuple[int, np.ndarray, pa.BooleanArray] | None = None

    def _at(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if self.batch is None or self.batch[0] != number:
            got = self.reader.get_batch(number)
            self.batch = (number, got.column(0).flatten().to_numpy(zero_copy_only=True), got.column(1).flatten())
        return self.batch[1:]

    def sequence(self, i: int) -> np.ndarray:
        return self._at(i // ROWS)[0][i % ROWS * self.length : (i % ROWS + 1) * self.length]

    def mask(self, i: int) -> pa.BooleanArray:
        return self._at(i // ROWS)[1].slice(i % ROWS * self.length, self.length)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """n ids from place `start`, by runs within a batch; padding is never among them."""
        per = self.length * ROWS
        while n > 0:
            flat, mask = self._at(start // per)
            run = flat[start % per : min(start % per + n, len(flat))]
            if not len(run) or not mask[start % per + len(run) - 1].as_py():
                raise ValueError("the file ends before these ids")
            yield run
            start, n = start + len(run), n - len(run)


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part int, path string, docs long, tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Writes docs' ids, each document's followed by end_id, and returns the manifest: part, path, docs, tokens."""
    folder = folder or scratch(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        writer = None
        index: dict[str, list[int]] = {"doc_id": [], "start": [], "n_tokens": []}
        n_docs = 0
        for batch in batches:
            if batch.num_rows and writer is None:
                fs, at = _filesystem(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                encoder = encoder_of(tokenizer)
                sink, side = fs.open_output_stream(at), fs.open_output_stream(at + ".docs")
                writer, docs_out = SequenceWriter(sink, encoder.dtype, length), pa.ipc.new_file(side, _INDEX)
                end = np.array([end_id], encoder.dtype)
            found = encoder.encode_all(texts(batch.column(1))) if batch.num_rows else ()
            for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                for k, v in (("doc_id", doc_id), ("start", writer.total), ("n_tokens", len(ids) + 1)):
                    index[k].append(v)
                writer.add(ids)
                writer.add(end)
            if batch.num_rows:
                n_docs += batch.num_rows
                docs_out.write_batch(pa.record_batch(index, schema=_INDEX))
                index = {k: [] for k in index}
        if writer is not None:
            writer.close()
            docs_out.close()
            sink.close()
            side.close()
            yield pa.record_batch({"part": pa.array([task.partitionId()], pa.int32()), "path": [path], "docs": pa.array([n_docs], pa.int64()), "tokens": pa.array([writer.total], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    return written(in_order(docs, order, ["doc_id", "text"]).mapInArrow(run, _MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """The documents of the files in a manifest: doc_id, start over all files, n_tokens, ids_crc32. A task maps one file at a time."""
    spark = manifest.sparkSession
    files = sorted(tuple(r) for r in manifest.select("part", "path", "tokens").collect())  # one row a file
    before, rows = 0, []
    for part, path, tokens in files:
        rows.append((part, path, before))
        before += tokens
    todo = spark.createDataFrame(rows, "part int, path string, before long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fs, at = _filesystem(path)
                opened = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
                ids = SequenceFile(opened)
                listed = pa.ipc.open_file(fs.open_input_file(at + ".docs"))
                for index in map(listed.get_batch, range(listed.num_record_batches)):
                    sums = []
                    for start, n in zip(index.column(1).to_pylist(), index.column(2).to_pylist(), strict=True):
                        crc = 0
                        for piece in ids.ids(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(index.column(1).to_numpy() + first, pa.int64())
                    yield pa.record_batch([index.column(0), starts, index.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
