"""Repair of bad titles, authors and descriptions, as a preview and as a new snapshot; and the catalog's invariants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, tags
from ..functions import text as t
from ..operators import merge, search
from ..operators.enrich import PENDING
from ..schema import CATALOG, evolve

TITLE_REASON, AUTHOR_TITLE_REASON, AUTHOR_REASON = "书名疑似乱码/编号/章节名", "作者异常且本地正文/元数据给出不同书名", "作者疑似乱码/编号/随机字符"
REFRESHED, REBUILT = "刷新本地简介", "重建简短简介"
FIELDS = ("title", "authors", "description", "language", "publisher", "published_year", "isbn", "cover_path", "tags_text")


@dataclass(frozen=True)
class RepairOptions:
    allow_title_on_author_bad: bool = False
    allow_non_chinese_title: bool = False
    authors_only: bool = False
    refresh_description: bool = False
    strict_titles: bool = False


def bad_title(c: Column) -> Column:
    return (c == t.UNKNOWN_TITLE) | classify.suspicious_title(c)


def bad_author(c: Column) -> Column:
    return (c != "") & (c != t.UNKNOWN_AUTHOR) & classify.suspicious_author(c)


def needs_repair() -> Column:
    return bad_title(F.col("title")) | bad_author(F.col("authors"))


def title_allowed(c: Column, any_script: bool) -> Column:
    good = (c != "") & ~classify.suspicious_title(c)
    return (c == t.UNKNOWN_TITLE) | (good if any_script else good & t.has_cjk(c))


def strict_change(old: Column, new: Column) -> Column:
    """A plain short new title for an old one that is bad beyond doubt."""
    words = rf"(?iU)作者|著|译|目录|简介|正文|第一章|第[{classify.NUMERALS}\d]+[章节回集]|\bby\b|www\.|https?://"
    plain = title_allowed(new, False) & (F.length(new) <= 32) & ~new.rlike(r"[［］\[\]【】？?！!]") & ~new.rlike(words) & ~new.rlike("[。；;]") & (t.count_of(new, "[，,、]") <= 1)
    low = F.lower(old)
    hopeless = (old == t.UNKNOWN_TITLE) | F.contains(old, F.lit("�")) | old.rlike(f"[{classify.LATIN}]") | low.rlike(r"https?://|www\.") | old.rlike(r"(?U)^\d+(?:[ _-]\d+)*\z") | old.rlike(r"^[A-Z0-9_\-]{8,}\z") | low.rlike(r"(?U)\.(gif|jpg|jpeg|png|webp)\b")
    return plain & hopeless


def usable_description(c: Column, title: Column) -> Column:
    named = (title != "") & (title != t.UNKNOWN_TITLE) & F.contains(c, title)
    return (c != "") & ~c.startswith("《") & (t.count_of(c, "#") < 3) & ~c.rlike(r"(?U)目\s*录") & (named | ((F.length(c) >= 30) & t.has_cjk(c)))


def repair_preview(catalog: DataFrame, extracted: DataFrame, options: RepairOptions = RepairOptions()) -> DataFrame:
    """For active rows, what would change: id, filename, path, ``changes`` (field to new value), ``reasons``.

    ``extracted`` is plans.scan.extract's result for their files, by path.
    """
    o = {f: F.col(f) for f in FIELDS}
    m = extracted.select("path", *(t.strip(t.text_of(F.col(c))).alias(f"e_{c}") for c in ("title", "authors", "description", "language", "publisher", "published_year", "isbn", "cover_path")), F.col("tags").alias("e_tags"))
    rows = evolve(catalog).where("status = 'active'").join(m, "path")
    e = lambda c: F.col(f"e_{c}")
    no = F.lit(None).cast("string")
    title_bad, author_bad = bad_title(o["title"]), bad_author(o["authors"])
    allowed = title_allowed(e("title"), options.allow_non_chinese_title)
    if options.strict_titles:
        allowed = allowed & strict_change(o["title"], e("title"))
    differs = (e("title") != "") & (e("title") != o["title"]) & allowed
    by_title = title_bad & differs
    by_author = F.lit(options.allow_title_on_author_bad) & author_bad & (e("title") != t.UNKNOWN_TITLE) & classify.good_title(e("title")) & differs & ~by_title
    on = F.lit(not options.authors_only)
    rows = rows.withColumns({"by_title": on & by_title, "by_author": on & by_author})
    rows = rows.withColumn("c_title", F.when(F.col("by_title") | F.col("by_author"), e("title")).otherwise(no))
    final_title = F.coalesce("c_title", "title")
    usable = (e("authors") != "") & (e("authors") != o["authors"]) & ~((e("authors") == o["title"]) & F.col("c_title").isNull()) & (e("authors") != final_title) & ((e("authors") == t.UNKNOWN_AUTHOR) | ~bad_author(e("authors")))
    rows = rows.withColumn("c_authors", F.when(author_bad & usable, e("authors")))
    for c in ("language", "publisher", "published_year", "isbn", "cover_path"):
        rows = rows.withColumn(f"c_{c}", F.when(on & (e(c) != "") & (o[c] == ""), e(c)))
    refined = F.array_join(tags.refine_tags(final_title, F.coalesce("c_authors", "authors"), o["description"], F.concat(merge.split_tags(o["tags_text"]), F.col("e_tags"))), ", ")
    rows = rows.withColumn("c_tags_text", F.when(on & (refined != "") & (refined != o["tags_text"]), refined))
    simple = t.simple_description(final_title, F.coalesce("c_authors", "authors"), merge.split_tags(F.coalesce("c_tags_text", "tags_text")), F.col("ext"))
    fresh = usable_description(e("description"), final_title)
    refresh = F.lit(options.refresh_description)
    renamed = on & F.col("c_title").isNotNull()
    refreshed = ~renamed & refresh & fresh & (e("description") != o["description"])
    unrelated = (o["description"] == "") | ((final_title != "") & (final_title != t.UNKNOWN_TITLE) & ~F.contains(o["description"], final_title))
    rebuilt = ~renamed & ~refreshed & refresh & unrelated
    placeholder = (o["description"] == "") | (o["description"].startswith(F.concat(F.lit("《"), o["title"], F.lit("》是一本"))) & F.contains(o["description"], F.lit("本地文件格式为")))
    other = F.greatest(*(F.col(f"c_{f}").isNotNull() for f in FIELDS if f != "description"))
    rows = rows.withColumn("c_description", F.when(renamed, F.when(fresh, e("description")).otherwise(simple)).when(refreshed, e("description")).when(rebuilt | (placeholder & other), simple))
    reasons = F.array(F.when(F.col("by_title"), TITLE_REASON), F.when(F.col("by_author"), AUTHOR_TITLE_REASON), F.when(F.col("c_authors").isNotNull(), AUTHOR_REASON), F.when(refreshed, REFRESHED), F.when(rebuilt, REBUILT))
    pairs = F.array(*(F.struct(F.lit(f).alias("key"), F.col(f"c_{f}").alias("value")) for f in FIELDS))
    return rows.select("id", "filename", "path", F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("changes"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def repair_apply(catalog: DataFrame, preview: DataFrame, now: float) -> DataFrame:
    """The next snapshot with a preview's changes; a new title also clears what was looked up for the old one."""
    p = preview.where(F.size("changes") > 0).select(F.col("id").alias("p_id"), "changes")
    out = evolve(catalog).join(p, F.col("id") == F.col("p_id"), "left")
    hit, renamed = F.col("p_id").isNotNull(), F.coalesce(F.map_contains_key("changes", F.lit("title")), F.lit(False))
    new = {f: F.coalesce(F.try_element_at("changes", F.lit(f)), F.col(f)) for f in FIELDS}
    new["updated_at"] = F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))
    for c in merge.REMOTE:
        new[c] = F.when(renamed, "").otherwise(F.col(c))
    new["douban_rating_status"] = F.when(renamed, PENDING).otherwise(F.col("douban_rating_status"))
    new["remote_lookup_version"] = F.when(renamed, 0).otherwise(F.col("remote_lookup_version"))
    return out.select(*(new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CATALOG.fields))


def invariants(catalog: DataFrame, book_tags: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """check, violations, rows: shown descriptions of 150 characters at most, no "unclassified", a rating label, and an existing file.

    The first three are one pass over the rows as shown; a catalog without active rows violates the file check.
    """
    shown = search.display(catalog.where("status = 'active'"), book_tags)
    joined = F.array_join("tags", ",")
    counts = shown.agg(
        F.count("*").alias("rows"),
        F.count_if(F.length("description") > t.DISPLAY).alias("description_length"),
        F.count_if(F.contains("description", F.lit("未分类")) | F.contains(joined, F.lit("未分类"))).alias("no_uncategorized_label"),
        F.count_if(t.strip(F.col("rating_label")) == "").alias("rating_label_present"),
    )
    names = ("description_length", "no_uncategorized_label", "rating_label_present")
    out = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations"), F.col("rows").alias("rows")) for n in names))).alias("x")).select("x.*")
    if listing is not None:
        active = catalog.where("status = 'active'").select("path")
        gone = active.join(listing.select("path", F.lit(1).alias("there")), "path", "left")
        links = gone.agg(F.lit("source_links").alias("check"), F.greatest(F.count_if(F.col("there").isNull()), (F.count("*") == 0).cast("long")).alias("violations"), F.count("*").alias("rows"))
        out = out.unionByName(links)
    return out
