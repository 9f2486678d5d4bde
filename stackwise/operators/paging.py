"""Pages far down an order: ids kept sorted in files of bounded size, so that a page reads the file or two that it lies in."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import LEAST_PAGE, MOST_PAGE, PAGE, SearchSpec, filtered, ordering, rank, term_groups
from .search import SEARCHED as FIELDS

#: Rows of a file.
RANGE = 100_000
RANGES = "file string, first long, n long"


def ordered(catalog: DataFrame, book_tags: DataFrame | None, spec: SearchSpec) -> DataFrame:
    """Ids of the rows that fit, in the search's order."""
    found = filtered(catalog, book_tags, spec)
    if term_groups(spec.query):
        found = found.withColumn("rank", rank(spec.query, {f: F.col(f) for f in FIELDS}))
    return found.orderBy(*ordering(spec)).select("id")


def _place(file: str) -> tuple[int, int]:
    """Files in the order in which Spark's writers made them: by task, then by number in the task."""
    part, more = re.search(r"part-(\d+)-", file), re.search(r"-c(\d+)\.", file)
    return int(part[1]) if part else -1, int(more[1]) if more else -1


def build(rows: DataFrame, folder: str, most: int = RANGE) -> int:
    """Writes ids in their order below folder, and the files' ranges of positions; returns how many rows there are.

    One sort by ranges, whose tasks write their part. The driver gets a row per file.
    """
    spark = rows.sparkSession
    rows.select("id").write.option("maxRecordsPerFile", most).parquet(f"{folder}/ids")
    ids = spark.read.schema("id long").parquet(f"{folder}/ids")
    counts = ids.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect()
    table, first = [], 0
    for r in sorted(counts, key=lambda r: _place(r["file"])):
        table.append((r["file"], first, r["n"]))
        first += r["n"]
    spark.createDataFrame(table, RANGES).coalesce(1).write.parquet(f"{folder}/ranges")
    return first


def page_ids(spark: SparkSession, folder: str, page: int = 1, page_size: int = PAGE) -> DataFrame:
    """pos (of all rows, from 0) and id of a page's rows; only the files that hold them are read."""
    page, size = max(1, page), min(MOST_PAGE, max(LEAST_PAGE, page_size or PAGE))
    begin, end = (page - 1) * size, page * size
    ranges = spark.read.schema(RANGES).parquet(f"{folder}/ranges")
    parts = []
    for r in ranges.where((F.col("first") < end) & (F.col("first") + F.col("n") > begin)).collect():  # two or so, as a page has 200 rows at most
        rows = spark.read.schema("id long").parquet(f"{folder}/ids/{r['file']}").select((F.col("_metadata.row_index") + r["first"]).alias("pos"), "id")
        parts.append(rows.where((F.col("pos") >= begin) & (F.col("pos") < end)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "pos long, id long")


def page_rows(catalog: DataFrame, folder: str, page: int = 1, page_size: int = PAGE) -> DataFrame:
    """The catalog's rows of a page, in order, with ``pos``."""
    wanted = page_ids(catalog.sparkSession, folder, page, page_size).withColumnRenamed("id", "page_id")
    return catalog.join(F.broadcast(wanted), catalog["id"] == F.col("page_id")).drop("page_id").orderBy("pos")  # a page has 200 rows at most
