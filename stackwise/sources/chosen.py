"""Contents of chosen files: tasks open the files that they are dealt, and no others, and read what a format's reader asks for."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schema import EXTRACTED
from . import readers

#: Files of a task: so many, or more where that would make more than TASKS tasks.
TASK_FILES, TASKS = 100, 10_000
#: Rows and characters of a batch that goes back to Spark.
BATCH_ROWS, BATCH_CHARS = 256, 4 << 20
READ = StructType([StructField("path", StringType()), StructField("own", EXTRACTED), StructField("side", EXTRACTED), StructField("bytes_read", LongType())])


class _Counted(io.RawIOBase):
    """A file that counts the bytes that are read from it."""

    def __init__(self, file: BinaryIO, counts: list[int]):
        self.file, self.counts = file, counts

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        self.counts[0] += len(data)
        return len(data)

    def seek(self, at: int, whence: int = 0) -> int:
        self.file.seek(at, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        if not self.closed:
            self.file.close()
            super().close()


def open_file(path: str) -> BinaryIO:
    """A seekable file: a path that all machines share, or an address of a store that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return open(path, "rb", buffering=0)  # noqa: SIM115  the caller closes it
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class _Reported(AccumulatorParam):
    """Adds up on the driver and tells each sum; tasks only add."""

    def __init__(self, report: Callable[[int], None] | None = None):
        self.report = report

    def __getstate__(self) -> dict:
        return {"report": None}

    def zero(self, value: int) -> int:
        return 0

    def addInPlace(self, a: int, b: int) -> int:  # noqa: N802  Spark's name
        if self.report and b:
            self.report(b)
        return a + b


def read_files(files: DataFrame, with_text: bool = True, report: Callable[[int], None] | None = None) -> DataFrame:
    """READ rows of ``files`` (path, ext, opf: a sidecar's path or null): the file's own fields, its sidecar's (null: none), bytes read.

    No other file is opened, and none whose format has no reader. What a reader takes of a file is bounded, so files are
    dealt by number. A file that can't be opened or read has scan_error, 240 characters; a bad sidecar has no fields.
    ``report`` gets the number of files of each task that ends (again if Spark repeats the task).
    """
    spark = files.sparkSession
    n = files.count()
    dealt = files.select("path", "ext", "opf").repartition(max(1, min(TASKS, -(-n // TASK_FILES))))
    done = spark.sparkContext.accumulator(0, _Reported(report)) if report else None
    schema = to_arrow_schema(READ)

    def opened(path: str, counts: list[int]) -> Callable[[], BinaryIO]:
        return lambda: io.BufferedReader(_Counted(open_file(path), counts), 1 << 16)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for given in batches:
            for path, ext, opf in zip(*(c.to_pylist() for c in given.columns), strict=True):
                counts = [0]
                own = readers.read_file(ext, opened(path, counts), with_text)
                side = readers.opf_or_nothing(opened(opf, counts)) if opf else None
                rows.append({"path": path, "own": own, "side": side, "bytes_read": counts[0]})
                chars += sum(len(v) for v in own.values() if isinstance(v, str))
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch(rows)
                    rows, chars = [], 0
            if done is not None:
                done.add(given.num_rows)
        if rows:
            yield batch(rows)

    return dealt.mapInArrow(run, READ)
