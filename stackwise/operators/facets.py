"""Facets and statistics: counts that take one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import enrich


def tag_facet(catalog: DataFrame, book_tags: DataFrame) -> DataFrame:
    """Tags of active books with counts, most frequent first; filters don't matter."""
    active = catalog.where("status = 'active'").select("id")
    return book_tags.join(active, book_tags["book_id"] == active["id"]).groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag")


def format_facet(catalog: DataFrame) -> DataFrame:
    return catalog.where("status = 'active'").groupBy("ext").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ext")


def status_histogram(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("status").agg(F.count("*").alias("count"))


def active_size(catalog: DataFrame) -> DataFrame:
    return catalog.where("status = 'active'").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def _having(condition: Column) -> Column:
    return F.count_if(condition)


def lookup_stats(catalog: DataFrame, now: float | Column) -> DataFrame:
    """Counts of active books by the state of their rating, and how many are due: one pass."""
    rating, status = F.trim("douban_rating"), F.col("douban_rating_status")
    none = rating == ""
    return catalog.where("status = 'active'").agg(
        F.count("*").alias("total"),
        _having(~none).alias("rated"),
        _having(none & status.isin("", enrich.PENDING)).alias("pending"),
        _having(none & status.isin(enrich.FAILED, enrich.LIMITED)).alias("failed"),
        _having(none & (status == enrich.LIMITED)).alias("access_limited"),
        _having(none & status.isin(enrich.NOT_FOUND, enrich.UNRATED)).alias("not_found_or_unrated"),
        _having(enrich.due_in_set(now)).alias("due"),
    )


def selection_totals(rows: DataFrame) -> DataFrame:
    """Count, size and the first twelve titles (by position) of a selection with pos, size, title; twelve rows at most are gathered."""
    sample = rows.orderBy("pos").limit(12).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("sample"))
    return rows.agg(F.count("*").alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")).join(sample)


def scan_counters(classified: DataFrame) -> DataFrame:
    """Counters of a scan from its classified files: column ``action`` (skip, touch, index), remote_due, scan_error."""
    found = F.col("action") != "skip"
    return classified.agg(
        F.count("*").alias("processed"),
        _having(found).alias("found"),
        _having(~found).alias("skipped"),
        _having(F.col("action") == "index").alias("indexed"),
        _having(F.col("action") == "touch").alias("unchanged"),
        _having(found & F.col("remote_due")).alias("remote_queued"),
        _having(found & ~F.col("remote_due")).alias("remote_skipped"),
        _having(F.coalesce("scan_error", F.lit("")) != "").alias("error_count"),
    )
