"""Upserts by preference: how new values meet old ones. Each is one join and one projection, written as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, tags
from ..functions import text as t
from ..schema import CATALOG, evolve
from .enrich import OBTAINED, PENDING, VERSION

KEPT_IF_BLANK = ("description", "language", "publisher", "published_year", "isbn", "source", "cover_path")
#: Ranges that new rows are numbered in, values sampled for their bounds, and rows of a range where all values are sampled.
RANGES, SAMPLE, RANGE_ROWS = 1024, 16_384, 4_096
REMOTE = ("remote_source", "remote_url", "douban_rating", "douban_url")


def prefer(new: Column, old: Column) -> Column:
    """The new value unless it is blank."""
    value = t.strip(t.text_of(new))
    return F.when(value != "", value).otherwise(t.text_of(old))


def _prefer_checked(new: Column, old: Column, unknown: str, bad) -> Column:
    both = F.struct(t.strip(t.text_of(new)).alias("n"), t.strip(t.text_of(old)).alias("o"))
    return t.let(both, lambda x: F.when((x["n"] == "") | (x["n"] == unknown), x["o"]).when(x["o"] == "", x["n"]).when(bad(x["n"]), x["o"]).otherwise(x["n"]))


def prefer_title(new: Column, old: Column) -> Column:
    """The new title if it isn't blank or unknown, and isn't suspicious while there is an old one."""
    return _prefer_checked(new, old, t.UNKNOWN_TITLE, classify.suspicious_title)


def prefer_author(new: Column, old: Column) -> Column:
    return _prefer_checked(new, old, t.UNKNOWN_AUTHOR, classify.suspicious_author)


def rating_status(new_rating: Column, new_status: Column, old_rating: Column, old_status: Column) -> Column:
    """The status that goes with the rating that is kept."""
    status = lambda c: F.nullif(t.strip(t.text_of(c)), F.lit(""))
    return F.when(t.strip(t.text_of(new_rating)) != "", F.coalesce(status(new_status), F.lit(OBTAINED))).when(t.strip(t.text_of(old_rating)) != "", F.coalesce(status(old_status), F.lit(OBTAINED))).otherwise(F.coalesce(status(new_status), status(old_status), F.lit("")))


def split_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(t.text_of(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def upsert(catalog: DataFrame, incoming: DataFrame, now: float, keep_better_description: bool = False) -> DataFrame:
    """The next snapshot of the catalog: incoming files (path, size, mtime, extracted fields, tags array, reset_remote) by path.

    Known paths take new values by preference and become active; new ones get ids after the greatest, by path; other rows
    stay. One row per path on both sides; of repeated incoming paths, the one with the latest mtime counts.
    ``keep_better_description`` keeps an old description of a higher quality score.
    """
    fields = ("title", "authors", *KEPT_IF_BLANK, *REMOTE, "douban_rating_status", "scan_error")
    have = set(incoming.columns)
    value = lambda c: t.text_of(F.col(c)) if c in have else F.lit("")
    new = incoming.groupBy("path").agg(F.max_by(F.struct(*incoming.columns), F.struct("mtime", "size")).alias("r")).select("path", F.lit(True).alias("n_known"), *(F.col(f"r.{c}").alias(c) for c in incoming.columns if c != "path"))
    new = new.select("path", "n_known", F.col("size").cast("long").alias("n_size"), F.col("mtime").cast("double").alias("n_mtime"), *(value(c).alias(f"n_{c}") for c in fields), (F.coalesce(F.col("tags"), F.expr(tags.NO_TAGS)) if "tags" in have else F.expr(tags.NO_TAGS)).alias("n_tags"), (F.coalesce(F.col("reset_remote"), F.lit(False)) if "reset_remote" in have else F.lit(False)).alias("n_reset"))
    old = evolve(catalog)
    both = old.join(new, "path", "full_outer")
    is_new, touched = F.col("id").isNull(), F.col("n_known").isNotNull()
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")
    n, o = (lambda c: F.col(f"n_{c}")), F.col
    reset = F.col("n_reset")
    updated: dict[str, Column] = {"title": prefer_title(n("title"), o("title")), "authors": prefer_author(n("authors"), o("authors"))}
    updated |= {c: prefer(n(c), o(c)) for c in KEPT_IF_BLANK}
    if keep_better_description:
        updated["description"] = F.when(t.description_quality(o("description")) > t.description_quality(n("description")), o("description")).otherwise(updated["description"])
    updated |= {c: F.when(reset, "").otherwise(prefer(n(c), o(c))) for c in REMOTE}
    updated["douban_rating_status"] = F.when(reset, F.coalesce(F.nullif(n("douban_rating_status"), F.lit("")), F.lit(PENDING))).otherwise(rating_status(n("douban_rating"), n("douban_rating_status"), o("douban_rating"), o("douban_rating_status")))
    updated |= {"scan_error": n("scan_error"), "status": F.lit("active"), "quarantine_path": F.lit(""), "remote_lookup_version": F.when(reset, 0).otherwise(o("remote_lookup_version")), "added_at": o("added_at"), "last_remote_lookup_at": o("last_remote_lookup_at")}
    inserted: dict[str, Column] = {c: n(c) for c in fields if c not in ("remote_source", "remote_url")}
    inserted |= {"title": F.coalesce(F.nullif(n("title"), F.lit("")), stem), "source": F.coalesce(F.nullif(n("source"), F.lit("")), F.lit("local")), "remote_source": F.lit(""), "remote_url": F.lit(""), "status": F.lit("active"), "quarantine_path": F.lit(""), "remote_lookup_version": F.lit(0), "added_at": F.lit(now), "last_remote_lookup_at": F.lit(0.0)}
    ext = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)\z", 1))
    stamp = {"filename": name, "ext": ext, "size": n("size"), "mtime": n("mtime"), "updated_at": F.lit(now), "last_scanned_at": F.lit(now)}
    merged = both.select("id", "path", "n_tags", "tags_text", touched.alias("touched"), *((F.when(is_new, inserted[c]).when(touched, updated[c]).otherwise(o(c)) if c in inserted else F.when(touched, stamp[c]).otherwise(o(c))).alias(f"x_{c}") for c in [*inserted, *stamp]))
    merged = merged.withColumn("x_tags", tags.refine_tags(F.col("x_title"), F.col("x_authors"), F.col("x_description"), F.concat(split_tags(F.col("tags_text")), F.col("n_tags"))))
    merged = merged.withColumn("x_tags_text", F.when(F.col("touched"), F.array_join("x_tags", ", ")).otherwise(F.col("tags_text")))
    known, fresh = merged.where("id is not null"), merged.where("id is null").drop("id")
    columns = [F.col(f"x_{f.name}").cast(f.dataType).alias(f.name) if f.name not in ("id", "path") else F.col(f.name) for f in CATALOG.fields]
    return known.select(columns).unionByName(with_new_ids(fresh, old, "path").select(columns))


def value_range(order: str, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at most the value: a binary search, so a row's range depends on its value alone."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    table = F.array(*map(F.lit, bounds))

    def halve(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(bounds)) & (F.try_element_at(table, at + step) <= F.col(order)), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def with_new_ids(rows: DataFrame, catalog: DataFrame, order: str) -> DataFrame:
    """rows with ids after the catalog's greatest, by ``order`` (distinct values): ranks inside ranges plus the ranges' offsets.

    The ranges are cut at RANGES values of a sample of the SAMPLE least hashes, so that no task sees all rows. They're
    functions of the value, not of how Spark dealt the rows: ranking and counting agree whatever the plan of either.
    """
    sample = sorted(r[0] for r in rows.select(order).orderBy(F.xxhash64(order), order).limit(SAMPLE).collect())
    bounds = sorted(set(sample[:: max(1, -(-len(sample) // RANGES))])) if len(sample) == SAMPLE else sample[RANGE_ROWS::RANGE_ROWS]
    parts = rows.withColumn("_part", value_range(order, bounds))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return ranked.join(F.broadcast(before), "_part").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("_before") + F.col("_r")).drop("_part", "_r", "_before", "top")


def bridge_of(catalog: DataFrame) -> DataFrame:
    """(book_id, tag) rows of the catalog's tags."""
    return catalog.select(F.col("id").alias("book_id"), F.explode(F.array_distinct(split_tags(F.col("tags_text")))).alias("tag"))


def replace_tag_sets(book_tags: DataFrame, replaced: DataFrame) -> DataFrame:
    """The bridge with new tag sets (book_id, tags array) for some books."""
    rows = replaced.select("book_id", F.explode(F.array_distinct("tags")).alias("tag"))
    return book_tags.join(replaced.select("book_id"), "book_id", "left_anti").select("book_id", "tag").unionByName(rows)


def touch(catalog: DataFrame, seen: DataFrame, now: float) -> DataFrame:
    """Rows whose file (path, size, mtime) is unchanged: stamps refreshed, updated_at only if the row wasn't active."""
    s = seen.select("path", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"))
    hit = F.col("s_size").isNotNull()
    out = evolve(catalog).join(s, "path", "left")
    new = {"size": F.col("s_size"), "mtime": F.col("s_mtime"), "status": F.lit("active"), "last_scanned_at": F.lit(now), "updated_at": F.when(F.col("status") != "active", F.lit(now)).otherwise(F.col("updated_at"))}
    return out.select(*(F.when(hit, new[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name) for f in CATALOG.fields))


def apply_lookup(catalog: DataFrame, found: DataFrame, now: float) -> DataFrame:
    """Rows with a lookup's result (id and any of the catalog's text fields, tags array): blank values change nothing."""
    plain = ("title", "authors", "description", "language", "publisher", "published_year", "isbn", "cover_path", *REMOTE)
    have = set(found.columns)
    r = found.select("id", F.lit(True).alias("r_hit"), *(t.text_of(F.col(c)).alias(f"r_{c}") if c in have else F.lit("").alias(f"r_{c}") for c in (*plain, "douban_rating_status")), (F.coalesce("tags", F.expr(tags.NO_TAGS)) if "tags" in have else F.expr(tags.NO_TAGS)).alias("r_tags"))
    out = evolve(catalog).join(r, "id", "left")
    hit = F.col("r_hit").isNotNull()
    new = {c: prefer(F.col(f"r_{c}"), F.col(c)) for c in plain}
    new["douban_rating_status"] = rating_status(F.col("r_douban_rating"), F.col("r_douban_rating_status"), F.col("douban_rating"), F.col("douban_rating_status"))
    new["tags_text"] = F.array_join(tags.refine_tags(new["title"], new["authors"], new["description"], F.concat(split_tags(F.col("tags_text")), F.col("r_tags"))), ", ")
    new |= {"updated_at": F.lit(now), "last_remote_lookup_at": F.lit(now), "remote_lookup_version": F.lit(VERSION)}
    return out.select(*(F.when(hit, new[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name) for f in CATALOG.fields))


def add_tags(catalog: DataFrame, book_tags: DataFrame, ids: DataFrame, names: list[str], now: float) -> tuple[DataFrame, DataFrame]:
    """(catalog, bridge) after tagging the known ones of ``ids`` (column id); tags outside the vocabulary are dropped.

    The bridge gets all tags, tags_text the first six merged ones. Ids that the catalog doesn't know are left out.
    """
    normal = tags.merge_tags(F.array(*map(F.lit, names)) if names else F.expr(tags.NO_TAGS))
    known = ids.select("id").distinct().join(catalog.select("id"), "id", "left_semi")
    rows = known.select(F.col("id").alias("book_id"), F.explode(normal).alias("tag"))
    bridge = book_tags.select("book_id", "tag").unionByName(rows.join(book_tags, ["book_id", "tag"], "left_anti"))
    mark = known.select("id", F.lit(True).alias("hit"))
    had = book_tags.join(known, book_tags["book_id"] == known["id"]).groupBy("book_id").agg(F.array_sort(F.collect_set("tag")).alias("had"))
    out = evolve(catalog).join(mark, "id", "left").join(had, F.col("id") == F.col("book_id"), "left")
    hit = F.col("hit").isNotNull() & (F.size(normal) > 0)
    new = {"tags_text": F.array_join(tags.merge_tags(F.coalesce("had", F.expr(tags.NO_TAGS)), normal), ", "), "updated_at": F.lit(now)}
    return out.select(*(F.when(hit, new[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name) for f in CATALOG.fields)), bridge


def merge_extracted(target: Column, incoming: Column) -> Column:
    """Two structs of extracted fields: titles and authors by their rules, the better description, other values if there is one."""
    has = lambda c: t.text_of(incoming[c]) != ""
    old_text, new_text = t.clean_description(target["description"]), t.clean_description(incoming["description"])
    chosen = {
        "title": F.when(has("title") & classify.replaces_title(t.text_of(target["title"]), incoming["title"]), incoming["title"]),
        "authors": F.when(has("authors") & classify.replaces_author(t.text_of(target["authors"]), incoming["authors"]), t.clean_author(incoming["authors"])),
        "description": F.when(has("description") & (t.description_quality(new_text) > t.description_quality(old_text)), new_text),
        **{c: F.when(has(c), incoming[c]) for c in ("language", "publisher", "published_year", "isbn", "cover_path")},
        "subjects": F.when(F.size(F.coalesce(incoming["subjects"], F.expr(tags.NO_TAGS))) > 0, incoming["subjects"]),
    }
    return F.struct(*(F.coalesce(c, target[name]).alias(name) for name, c in chosen.items()), target["scan_error"].alias("scan_error"))
