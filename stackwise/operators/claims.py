"""Claims that hold beyond one machine: a mark that only one writer can create, and leases of ids that are being worked on.

A claim is a lease: its holder renews nothing, and when its end has passed, another may take it over by the next mark, which
again only one can create. A claim that is done is never given again.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that a claim holds unless it is done before.
LEASE_SECONDS = 6 * 3600.0
LEASES = "id long, owner string, until double"


class Marks(Protocol):
    """Small files in one folder; ``create`` succeeds for one caller a name."""

    def create(self, name: str, text: str) -> bool: ...

    def read(self, name: str) -> str | None: ...

    def names(self) -> list[str]: ...


class LocalMarks:
    """In a folder of a file system: a mark appears with its text, by a link."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def create(self, name: str, text: str) -> bool:
        os.makedirs(self.folder, exist_ok=True)
        own = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, os.path.join(self.folder, name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)

    def read(self, name: str) -> str | None:
        try:
            with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                return f.read()
        except OSError:
            return None

    def names(self) -> list[str]:
        return os.listdir(self.folder) if os.path.isdir(self.folder) else []


class StoreMarks:
    """In any store that Spark writes, by Hadoop's file system, whose exclusive creation is atomic in stores such as HDFS."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def create(self, name: str, text: str) -> bool:
        try:
            out = self.fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(self._path(name)):
                return False
            raise
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        file = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.folder)] if self.fs.exists(self.folder) else []


def marks_in(folder: str, spark: SparkSession | None = None) -> Marks:
    if "://" in folder and not folder.startswith("file://"):
        if spark is None:
            raise ValueError(f"marks in {folder} need a session")
        return StoreMarks(spark, folder)
    return LocalMarks(folder)


def _generations(marks: Marks, key: str) -> list[int]:
    return sorted(int(n.removeprefix(f"{key}.claim-")) for n in marks.names() if n.startswith(f"{key}.claim-"))


def _until(text: str | None) -> float:
    """A mark's end; one whose text isn't there yet holds."""
    try:
        return float(json.loads(text or "")["until"])
    except (ValueError, KeyError, TypeError):
        return float("inf")


def claim(marks: Marks, key: str, owner: str, now: float, seconds: float = LEASE_SECONDS) -> bool:
    """Whether owner holds key from now on: it was free, or the last claim's end has passed, and nobody was faster."""
    if marks.read(f"{key}.done") is not None:
        return False
    made = _generations(marks, key)
    if made and _until(marks.read(f"{key}.claim-{made[-1]}")) > now:
        return False
    return marks.create(f"{key}.claim-{made[-1] + 1 if made else 1}", json.dumps({"owner": owner, "until": now + seconds}))


def holder(marks: Marks, key: str, now: float) -> str:
    """Who holds key, '' if nobody does."""
    made = _generations(marks, key)
    text = marks.read(f"{key}.claim-{made[-1]}") if made and marks.read(f"{key}.done") is None else None
    return json.loads(text)["owner"] if text and _until(text) > now else ""


def finish(marks: Marks, key: str, owner: str, now: float) -> bool:
    """Ends owner's claim for good; false if it isn't the holder any more."""
    return holder(marks, key, now) == owner and marks.create(f"{key}.done", json.dumps({"owner": owner, "at": now}))


def lease(ids: DataFrame, leases: DataFrame, owner: str, now: float, seconds: float = LEASE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(the ids that owner may work on, the next table of leases): those that no other owner holds; leases that have ended go.

    The table is published like a catalog: of two owners with the same version, the second fails and asks again.
    """
    held = leases.where(F.col("until") > now)
    others = held.where(F.col("owner") != owner).select("id")
    granted = ids.select(F.col("id").cast("long").alias("id")).distinct().join(others, "id", "left_anti")
    new = granted.select("id", F.lit(owner).alias("owner"), F.lit(now + seconds).alias("until"))
    return granted, held.join(granted, "id", "left_anti").select("id", "owner", "until").unionByName(new)


def release(done: DataFrame, leases: DataFrame, owner: str) -> DataFrame:
    """The table without owner's leases of ids that are done."""
    mine = done.select(F.col("id").cast("long").alias("id"), F.lit(owner).alias("owner"))
    return leases.join(mine, ["id", "owner"], "left_anti").select("id", "owner", "until")
