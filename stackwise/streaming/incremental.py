"""Structured Streaming: files as they arrive, and throttled persistence of job updates with state per job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import INTERVAL_SECONDS, PROGRESS, TERMINAL
from ..sources.files import EXTENSIONS

FILES = "path string, modificationTime timestamp, length long, content binary"
THROTTLED = "id string, seq long, at double, status string, processed long"
_STATE = "at double, processed long, status string"


def arriving_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """New book files below root, with content, as a stream."""
    raw = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)\z", 1))
    return raw.select("path", name.alias("filename"), ext.alias("ext"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content").where(F.col("ext").isin(*EXTENSIONS))


def scan_stream(spark: SparkSession, root: str, merge_batch: Callable[[DataFrame, int], None], checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Hands each batch of new files to merge_batch (say an upsert into the next snapshot), until all that is there is done."""
    return arriving_files(spark, root, max_files).writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _persist(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The updates of one job that are due, by what was persisted last; a batch's updates are sorted, its rows fit memory by trigger size."""
    rows = pd.concat(list(batches)).sort_values("seq")
    known = state.exists
    at, processed, status = state.get if known else (0.0, 0, "")
    keep = []
    for r in rows.itertuples(index=False):
        due = not known or r.status != status or r.status in TERMINAL or r.at - at >= INTERVAL_SECONDS or r.processed - processed >= PROGRESS
        known, status = True, r.status
        if due:
            at, processed = r.at, r.processed
        keep.append(due)
    state.update((at, processed, status))
    yield rows[keep]


def throttle_stream(updates: DataFrame) -> DataFrame:
    """A stream of job updates (id, seq, at, status, processed) reduced to those that are persisted."""
    return updates.groupBy("id").applyInPandasWithState(_persist, THROTTLED, _STATE, "append", GroupStateTimeout.NoTimeout)


class Spaced:
    """Tells ``report(files so far, "running" or "finished")`` at least EVERY_FILES files or EVERY_SECONDS apart."""

    EVERY_FILES, EVERY_SECONDS = 100, 2.0

    def __init__(self, report: Callable[[int, str], None], clock: Callable[[], float] = time.monotonic):
        self.report, self.clock = report, clock
        self.begin()

    def begin(self) -> None:
        self.files = self.told = 0
        self.at = self.clock()

    def seen(self, files: int) -> None:
        self.files += files
        now = self.clock()
        if self.files - self.told >= self.EVERY_FILES or (now - self.at >= self.EVERY_SECONDS and self.files > self.told):
            self.told, self.at = self.files, now
            self.report(self.files, "running")

    def end(self) -> None:
        self.report(self.files, "finished")


class ScanProgress(StreamingQueryListener):
    """Tells the progress of a file stream, spaced."""

    def __init__(self, report: Callable[[int, str], None], clock: Callable[[], float] = time.monotonic):
        self.spaced = Spaced(report, clock)
        self.seen = self.spaced.seen

    def onQueryStarted(self, event) -> None:
        self.spaced.begin()

    def onQueryProgress(self, event) -> None:
        self.seen(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        """Nothing arrives, so there is nothing to tell."""

    def onQueryTerminated(self, event) -> None:
        self.spaced.end()
