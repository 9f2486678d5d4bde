"""Files as tables: a recursive listing as a Python data source, sidecars by joins, and readers of book formats."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Formats that are read, covers, folders that are left out.
EXTENSIONS = (".azw", ".azw3", ".doc", ".docx", ".epub", ".fb2", ".md", ".mobi", ".pdf", ".rtf", ".txt")
COVERS = (".jpg", ".jpeg", ".png", ".webp")
SKIPPED_FOLDERS = ("$recycle.bin", ".git", "__macosx", "stackwise_copies", "stackwise_quarantine", "system volume information")

LISTING = "path string, dir string, filename string, stem string, ext string, size long, mtime double, is_file boolean"


#: Partitions of the folders of one depth, at most.
PARTITIONS = 256


class _Folders(InputPartition):
    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


def kept_folder(name: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> bool:
    return not name.startswith(".") and name.lower() not in skipped


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").load(root)``: all files below root, whatever their names begin with.

    Skipped and hidden folders are pruned, linked folders not followed. The folders two levels below the root are dealt to
    partitions with all that is below them, so one large folder right below the root is the work of many.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"].removeprefix("file://"))


class _ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    @staticmethod
    def _below(folder: str) -> list[str]:
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and kept_folder(e.name))

    def partitions(self) -> list[InputPartition]:
        first, second = self._below(self.root), []
        for folder in first:
            try:
                second += self._below(folder)
            except OSError:  # as in the walk, a folder that can't be read has nothing below it
                continue
        dealt = ((folders[i::PARTITIONS], deep) for folders, deep in (([self.root, *first], False), (second, True)) for i in range(min(PARTITIONS, len(folders))))
        return [_Folders(paths, deep) for paths, deep in dealt]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        for top in partition.paths:
            for folder, inner, files in os.walk(top):
                inner[:] = sorted(n for n in inner if kept_folder(n)) if partition.deep else []
                for name in sorted(files):
                    path, p = os.path.join(folder, name), PurePath(name)
                    try:
                        s = os.stat(path)
                    except OSError:
                        continue
                    yield path, folder, name, p.stem, p.suffix.lower(), s.st_size, s.st_mtime, os.path.isfile(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below root; ``supported`` tells which have a book's extension."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").load(root).withColumn("supported", F.col("ext").isin(*EXTENSIONS))


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """The same columns for a store that only Spark reads: names beginning with ``_`` or ``.`` aren't listed there, mtime has milliseconds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index("path", "/", -1)
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]+)\z", 1)
    return files.select(
        "path",
        F.regexp_replace("path", r"/[^/]*\z", "").alias("dir"),
        name.alias("filename"),
        F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "").alias("stem"),
        F.lower(suffix).alias("ext"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"),
        F.lit(True).alias("is_file"),
        F.lower(suffix).isin(*EXTENSIONS).alias("supported"),
    )


def sidecars(listing: DataFrame) -> DataFrame:
    """path of each book file with ``opf`` (the .opf of its stem, else its folder's only one) and ``cover`` (null: none).

    Covers: ``cover.*``, then ``folder.*``, then ``<stem>.*``; the first image by name.
    """
    books = listing.where("supported").select("path", "dir", "stem")
    opf = listing.where("ext = '.opf'").select("dir", "stem", F.col("path").alias("opf"))
    exact = opf.groupBy("dir", "stem").agg(F.min("opf").alias("exact"))
    only = opf.groupBy("dir").agg(F.count("*").alias("n"), F.min("opf").alias("only")).where("n = 1").select("dir", "only")
    images = listing.where(F.col("ext").isin(*COVERS)).select("dir", F.col("stem").alias("image"), F.col("filename").alias("image_name"), F.col("path").alias("image_path"))
    general = images.where(F.col("image").isin("cover", "folder")).groupBy("dir").agg(F.min_by("image_path", F.struct("image", "image_name")).alias("general"))
    own = images.groupBy("dir", F.col("image").alias("stem")).agg(F.min_by("image_path", "image_name").alias("own"))
    out = books.join(exact, ["dir", "stem"], "left").join(only, "dir", "left").join(general, "dir", "left").join(own, ["dir", "stem"], "left")
    return out.select("path", F.coalesce("exact", "only").alias("opf"), F.coalesce("general", "own").alias("cover"))
