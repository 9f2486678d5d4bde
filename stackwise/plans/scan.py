"""Scanning a folder into the catalog: listing against snapshot, extraction of what changed, one new snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, tags
from ..functions import text as t
from ..operators import enrich, merge
from ..schema import CATALOG, EXTRACTED, evolve
from ..sources import chosen as chosen_files
from ..sources import files, readers

SAME_SECONDS = 0.01
DEFAULT_DESCRIPTION, NO_TAG = "尚未分类", "未分类"


def same_file(size: Column, mtime: Column, seen_size: Column, seen_mtime: Column) -> Column:
    """Equal size and mtime; an empty file never counts as the same, so it is read on every scan."""
    return (F.when(size == 0, -1).otherwise(size) == seen_size) & (F.abs(F.when(mtime == 0, -1.0).otherwise(mtime) - seen_mtime) < SAME_SECONDS)


def refresh_reason(title: Column, description: Column, tags_text: Column) -> Column:
    """Why an unchanged file is read again, '' if it isn't."""
    return (
        F.when(classify.suspicious_title(title), "bad_title")
        .when(F.contains(description, F.lit(DEFAULT_DESCRIPTION)) | F.contains(tags_text, F.lit(NO_TAG)), "default_description")
        .when(t.strip(tags_text) == "", "missing_tags")
        .otherwise("")
    )


def classify_files(listing: DataFrame, catalog: DataFrame, now: float) -> DataFrame:
    """The listing with ``action`` (skip, touch, index), id, reason, same, remote_due, and what the catalog says of tags."""
    old, o_reason = evolve(catalog), refresh_reason(F.col("title"), F.col("description"), F.col("tags_text"))
    known = old.select(
        F.col("path").alias("o_path"),
        "id",
        F.col("size").alias("o_size"),
        F.col("mtime").alias("o_mtime"),
        o_reason.alias("o_reason"),
        enrich.due_row(now).alias("o_due"),
        F.when(o_reason == "missing_tags", tags.infer_tags(F.col("title"), F.col("authors"), F.col("description"), F.col("filename"))).alias("o_inferred"),
    )
    out = listing.join(known, listing["path"] == known["o_path"], "left")
    same = F.coalesce(same_file(F.col("o_size"), F.col("o_mtime"), F.col("size"), F.col("mtime")), F.lit(False))
    reason = F.when(same, F.col("o_reason")).otherwise("")
    out = out.withColumns({"same": same, "reason": reason})
    action = F.when(~F.col("supported"), "skip").when(F.col("same") & (F.col("reason") == ""), "touch").otherwise("index")
    due = F.col("id").isNull() | ~F.col("same") | F.col("reason").isin("bad_title", "missing_tags") | F.coalesce("o_due", F.lit(False))
    return out.withColumns({"action": action, "remote_due": F.when(action == "touch", F.coalesce("o_due", F.lit(False))).otherwise(due)}).drop("o_path", "o_size", "o_mtime", "o_reason", "o_due")


def written(df: DataFrame, path: str | None) -> DataFrame:
    """df, written down once at path if there is one."""
    if not path:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extract(chosen: DataFrame, listing: DataFrame, with_text: bool = True, work: str | None = None, report: Callable[[int], None] | None = None) -> DataFrame:
    """path and final metadata of chosen files: sidecar by preference, then the file's own fields, then the sidecar again.

    Only the chosen files and their sidecars are opened; what was read is written to ``work``, so it is read once.
    """
    wanted = chosen.join(files.sidecars(listing), "path", "left")
    read = written(chosen_files.read_files(wanted, with_text, report), work)
    out = wanted.withColumn("opf_dir", F.regexp_replace("opf", r"/[^/]*\z", "")).join(read, "path")
    guess = classify.guess_from_filename(F.col("filename"))
    out = out.withColumn("guess", guess)
    plain = F.col("ext").isin(".txt", ".md") & F.col("own.description").isNotNull()
    p = readers.plain_text_fields(F.coalesce("own.description", F.lit("")))
    out = out.withColumn("plain", F.when(plain, p))
    mobi = F.col("ext").isin(".mobi", ".azw", ".azw3")
    own_title = F.when(plain, F.col("plain.title")).when(mobi & classify.suspicious_title(F.coalesce("own.title", F.lit(""))), F.when(F.col("own.description").isNotNull(), F.nullif(classify.title_from_text(F.col("own.description")), F.lit("")))).otherwise(F.col("own.title"))
    own_authors = F.when(plain, F.col("plain.authors")).when(mobi, t.clean_author(F.col("own.authors"))).otherwise(F.col("own.authors"))
    own = {"title": own_title, "authors": own_authors, "description": F.when(plain, F.col("plain.description")).otherwise(F.col("own.description"))}
    guessed = {"title": F.col("guess.title"), "authors": F.col("guess.author")}
    start = F.struct(*(guessed.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in EXTRACTED.fields))
    out = out.withColumn("m0", F.when(F.col("side").isNotNull(), merge.merge_extracted(start, F.col("side"))).otherwise(start))
    # the file's own fields replace what is there, whatever it is
    out = out.withColumn("m1", F.struct(*(F.coalesce(own.get(f.name, F.col(f"own.{f.name}")), F.col(f"m0.{f.name}")).alias(f.name) for f in EXTRACTED.fields)))
    out = out.withColumn("m", F.when(F.col("side").isNotNull(), merge.merge_extracted(F.col("m1"), F.col("side"))).otherwise(F.col("m1")))
    text = lambda c: t.text_of(F.col(f"m.{c}"))
    out = out.withColumn("title", classify.final_title(text("title"), F.col("guess.title"), text("description"), F.col("guess.author")))
    out = out.withColumns({"authors": classify.final_author(text("authors"), F.col("guess.author")), "description": t.clean_description(text("description"))})
    subjects = F.coalesce("m.subjects", F.expr(tags.NO_TAGS))
    inferred = tags.infer_tags(F.col("title"), F.col("authors"), F.col("filename"), F.substring("description", 1, 240), subjects=subjects)
    cover = F.when(text("cover_path") != "", F.when(text("cover_path").startswith("/"), text("cover_path")).otherwise(F.concat("opf_dir", F.lit("/"), text("cover_path")))).otherwise(F.coalesce("cover", F.lit("")))
    out = out.withColumns({"tags": tags.merge_tags(subjects, inferred), "cover_path": cover})
    out = out.withColumn("description", F.when(F.col("description") == "", t.simple_description(F.col("title"), F.col("authors"), F.col("tags"), F.col("ext"))).otherwise(F.col("description")))
    return out.select("path", "title", "authors", "description", *(text(c).alias(c) for c in ("language", "publisher", "published_year", "isbn")), text("scan_error").alias("scan_error"), "cover_path", F.lit("local").alias("source"), "tags")


def scan(spark: SparkSession, root: str, catalog: DataFrame, now: float, with_text: bool = True, work: str | None = None, progress: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, classified files). Files that are gone stay in the catalog; quarantined rows become active if theirs is back.

    In a folder ``work`` the classified listing (``found``), what was read of files (``read``) and the rows to merge
    (``incoming``) are written down, so that snapshot and counters are of one listing, and each file is opened once. ``progress`` gets numbers of files as they are done.
    """
    found = written(classify_files(files.list_files(spark, root), catalog, now), work and f"{work}/found")
    chosen = found.where("action = 'index'")
    if progress:
        progress(found.where("action <> 'index'").count())
    metadata = extract(chosen, found, with_text, work and f"{work}/read", progress)
    marks = chosen.select("path", "size", "mtime", "id", "reason", "same", "remote_due", "o_inferred")
    extra = F.when(F.col("reason") == "missing_tags", F.col("o_inferred")).otherwise(F.expr(tags.NO_TAGS))
    incoming = metadata.join(marks, "path").withColumns({
        "tags": tags.merge_tags(F.col("tags"), F.coalesce(extra, F.expr(tags.NO_TAGS))),
        "douban_rating_status": F.when(F.col("remote_due"), enrich.PENDING).otherwise(""),
        "reset_remote": F.col("id").isNotNull() & (~F.col("same") | (F.col("reason") == "bad_title")),
    }).drop("id", "reason", "same", "remote_due", "o_inferred")
    incoming = written(incoming, work and f"{work}/incoming")
    touched = merge.touch(catalog, found.where("action = 'touch'").select("path", "size", "mtime"), now)
    return merge.upsert(touched, incoming, now), found


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG)


def publish(snapshot: DataFrame, folder: str, version: int) -> str:
    """Writes a snapshot beside the others, whole or not at all; readers take the one they are told of."""
    path = f"{folder.rstrip('/')}/version={version:012d}"
    snapshot.write.mode("errorifexists").parquet(path)
    return path


def daily_backup(snapshot: DataFrame, folder: str, day: str) -> str:
    """One copy a day: a later one on the same day changes nothing."""
    path = f"{folder.rstrip('/')}/snapshot_date={day}"
    snapshot.write.mode("ignore").parquet(path)
    return path
