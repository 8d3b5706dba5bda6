"""A sink of signal samples in CSV files that commits: rows of a task that fails, or is tried again, never show twice.

Each task writes a file of its own under `_staged`, which readers pass over; only the files that the finished tasks name
are moved beside the others. A micro-batch's files bear its number, so a batch that is written again replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "signal_samples"
STAGED = "_staged"


@dataclass
class Written(WriterCommitMessage):
    name: str | None  # of the staged file; None for a task without rows


class _Files:
    def __init__(self, path: str):
        self.path = path

    def open(self) -> tuple[fs.FileSystem, str]:
        found, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return found, root.rstrip("/")

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = self.open()
        out = name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{uuid.uuid4().hex}.csv"
                files.create_dir(f"{root}/{STAGED}", recursive=True)
                sink = files.open_output_stream(f"{root}/{STAGED}/{name}")
                out = pyarrow.csv.CSVWriter(sink, batch.schema)
            out.write(batch)
        if out is not None:
            out.close()
            sink.close()
        return Written(name)

    def drop(self, messages: list[Written | None]) -> None:
        files, root = self.open()
        for m in messages:
            if m is not None and m.name and files.get_file_info(f"{root}/{STAGED}/{m.name}").type != fs.FileType.NotFound:
                files.delete_file(f"{root}/{STAGED}/{m.name}")

    def publish(self, messages: list[Written | None], prefix: str) -> None:
        files, root = self.open()
        files.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.name:
                files.move(f"{root}/{STAGED}/{m.name}", f"{root}/{prefix}{m.name}")

    def forget(self, prefix: str) -> None:
        files, root = self.open()
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(prefix):
                files.delete_file(info.path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.files, self.overwrite = _Files(path), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.stage(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            self.files.forget("rows-")
            self.files.forget("batch-")
        self.files.publish(messages, "rows-")

    def abort(self, messages: list[Written | None]) -> None:
        self.files.drop(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.files = _Files(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.stage(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.files.forget(f"batch-{batchId:012d}-")
        self.files.publish(messages, f"batch-{batchId:012d}-")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.files.drop(messages)


class SignalSamples(DataSource):
    """`df.write.format("signal_samples").save(folder)` and `writeStream`; `spark.read.csv(folder, header=True)` reads it."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SignalSamples)
