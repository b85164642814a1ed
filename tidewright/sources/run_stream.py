"""A stream of finished forecast runs: register(spark), then spark.readStream.format("runs").load(root).

A row is a run of a store that runs.write_run() fills, as its manifest has it, once it is finished: run, params, steps, cells, written. The
offset is the manifest's runs with the times they were written, so it is bounded by the runs that are kept; a batch has the runs that
are new or were written anew since the offset before. A restart from a checkpoint repeats and loses none. Nothing finished: no rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewright.sources import files

SCHEMA = "run string, params array<string>, steps array<int>, cells long, written timestamp"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def finished(root: str) -> dict[str, tuple]:
    """The last manifest row of each run."""
    found: dict[str, tuple] = {}
    for path in files.listed(f"{root.rstrip('/')}/manifest", "*.parquet"):
        rows = pq.read_table(io.BytesIO(files.read(path)), columns=_COLUMNS)
        for row in rows.set_column(4, "written", rows["written"].cast(pa.timestamp("us", "UTC"))).to_pylist():
            if row["run"] not in found or found[row["run"]][-1] < row["written"]:
                found[row["run"]] = tuple(row[c] for c in _COLUMNS)
    return found


class Run(InputPartition):
    def __init__(self, row: tuple):
        self.row = row


class RunsSource(DataSource):
    """Finished runs, as they come."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return RunsReader(self.options["path"])


class RunsReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {run: row[-1].isoformat() for run, row in sorted(finished(self.root).items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = finished(self.root)
        return [Run(known[run]) for run in sorted(end) if start.get(run) != end[run] and run in known]

    def read(self, partition: Run) -> Iterator[tuple]:
        yield partition.row


def register(spark) -> None:
    spark.dataSource.register(RunsSource)
