"""Identical copies of a file share what was looked up for one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARED = ("douban_rating", "douban_url", "douban_rating_status", "remote_source", "remote_url", "last_remote_lookup_at", "remote_lookup_version")


def signature() -> list[Column]:
    """What identical copies have in common: name, size, mtime to the millisecond (half to even), title, authors."""
    return [F.col("filename").alias("s_filename"), F.col("size").alias("s_size"), F.bround(F.col("mtime") * 1000).cast("long").alias("s_mtime"), F.col("title").alias("s_title"), F.col("authors").alias("s_authors")]


def rated_signatures(catalog: DataFrame) -> DataFrame:
    """Signatures whose rated active rows agree in rating and url, with the values of the first (by id).

    Partial aggregates meet in the shuffle, so a signature that many rows share is no hot key.
    """
    rated = catalog.where("status = 'active' and douban_rating <> ''").select(*signature(), "id", *SHARED)
    keys = ["s_filename", "s_size", "s_mtime", "s_title", "s_authors"]
    pair = F.struct("douban_rating", "douban_url")
    return rated.groupBy(*keys).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"), F.min_by(F.struct(*SHARED), "id").alias("src")).where("lo = hi").select(*keys, "src")


def propagate(catalog: DataFrame, now: float) -> DataFrame:
    """The next snapshot: unrated active rows with the values of their signature's rated rows, and ``changed``."""
    keys = ["s_filename", "s_size", "s_mtime", "s_title", "s_authors"]
    out = catalog.select("*", *signature()).join(rated_signatures(catalog), keys, "left")
    hit = F.col("src").isNotNull() & (F.col("status") == "active") & (F.col("douban_rating") == "")
    new = {c: F.col("src")[c] for c in SHARED} | {"updated_at": F.lit(now)}
    return out.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in catalog.columns), hit.alias("changed"))
