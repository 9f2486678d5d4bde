"""Ranked multi-field search, filters, paging and selection of catalog rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Searched fields, ranks, variants and limits.
SEARCHED = ("title", "authors", "filename", "tags_text", "isbn", "publisher")
RANKS = (("title", True, 130), ("authors", True, 120), ("title", False, 100), ("authors", False, 80), ("filename", False, 70), ("tags_text", False, 50), ("isbn", False, 45), ("publisher", False, 40))
FOLDED = (("鲁呐", "魯吶"), ("魯吶", "鲁呐"))
ALIASES = {"鲁迅": ("魯迅", "Lu Xun"), "魯迅": ("鲁迅", "Lu Xun"), "呐喊": ("吶喊", "Ne Han"), "吶喊": ("呐喊", "Ne Han")}
VARIANTS, TERMS = 16, 32
PAGE, LEAST_PAGE, MOST_PAGE = 50, 10, 200


@dataclass(frozen=True)
class SearchSpec:
    """What to look for. Unknown sorts mean ``updated``; the order is ascending only for exactly "asc"."""

    query: str = ""
    tags: Sequence[str] = field(default_factory=tuple)
    format: str = ""
    status: str = "active"
    sort: str = "updated"
    order: str = "desc"


def variants(term: str) -> list[str]:
    """Spellings of a term that count as the same, the term first."""
    out = [term] + [term.translate(str.maketrans(a, b)) for a, b in FOLDED]
    out += [term.replace(source, other) for source, others in ALIASES.items() if source in term for other in others]
    return list(dict.fromkeys(x for x in (" ".join(o.split()) for o in out) if x))[:VARIANTS]


def term_groups(query: str | None) -> list[list[str]]:
    """The variants of each word of a query."""
    return [variants(w) for w in (query or "").split()]


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether c has one of the terms, literally; letter case counts outside A-Z only."""
    low = t.ascii_lower(c)
    return reduce(or_, (F.contains(low, t.ascii_lower(F.lit(term))) for term in terms))


def rank(query: str, columns: dict[str, Column]) -> Column:
    """How well a row fits: the first of RANKS (field, whole value, rank) that one of the query's terms meets, else 0."""
    terms = list(dict.fromkeys(v for g in term_groups(query) for v in g))[:TERMS]
    if not terms:
        return F.lit(0)
    first, *rest = ((columns[f].isin(terms) if whole else contains_any(columns[f], terms), score) for f, whole, score in RANKS)
    return reduce(lambda w, r: w.when(*r), rest, F.when(*first)).otherwise(0)


def matches(query: str, columns: dict[str, Column]) -> Column:
    """Whether each word of the query is found in one of the searched fields."""
    groups = term_groups(query)
    return reduce(and_, (reduce(or_, (contains_any(columns[f], g) for f in SEARCHED)) for g in groups), F.lit(True))


def sort_keys() -> dict[str, Column]:
    return {
        "title": t.ascii_lower(F.col("title")),
        "author": t.ascii_lower(F.col("authors")),
        "path": t.ascii_lower(F.col("path")),
        "format": t.ascii_lower(F.col("ext")),
        "updated": F.col("updated_at"),
        "added": F.col("added_at"),
        "size": F.col("size"),
        "douban": t.numeric_text(F.col("douban_rating")),
    }


def wanted_tags(tags: str | Sequence[str] | None) -> list[str]:
    parts = tags.split(",") if isinstance(tags, str) else list(tags or [])
    return list(dict.fromkeys(p.strip() for p in parts if p and p.strip()))


def with_all_tags(catalog: DataFrame, book_tags: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows of the catalog that have all tags: one aggregation of the bridge's matching rows, one semi-join."""
    names = wanted_tags(tags)
    if not names:
        return catalog
    have = book_tags.where(F.col("tag").isin(names)).groupBy("book_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(names))
    return catalog.join(have, catalog["id"] == have["book_id"], "left_semi")


def filtered(catalog: DataFrame, book_tags: DataFrame | None, spec: SearchSpec) -> DataFrame:
    """Rows that fit status, format, query and tags."""
    out = catalog
    if (spec.status or "active") != "all":
        out = out.where(F.col("status") == (spec.status or "active"))
    if form := (spec.format or "").strip().lower():
        out = out.where(F.col("ext") == (form if form.startswith(".") else f".{form}"))
    if term_groups(spec.query):
        out = out.where(matches(spec.query, {f: F.col(f) for f in SEARCHED}))
    if wanted_tags(spec.tags):
        out = with_all_tags(out, book_tags, spec.tags)
    return out


def ordering(spec: SearchSpec) -> list[Column]:
    """Total: rank and title length first if there is a query, the sort key, then id descending. Nulls are least."""
    key = sort_keys().get(spec.sort, F.col("updated_at"))
    main = [key.asc_nulls_first() if spec.order == "asc" else key.desc_nulls_last(), F.col("id").desc()]
    return ([F.col("rank").desc(), F.length("title")] if term_groups(spec.query) else []) + main


def search(catalog: DataFrame, book_tags: DataFrame | None, spec: SearchSpec, page: int = 1, page_size: int = PAGE) -> DataFrame:
    """A page of matching rows with their rank: a bounded top-k, not a sort of all rows, on the first pages."""
    page, size = max(1, page), min(MOST_PAGE, max(LEAST_PAGE, page_size or PAGE))
    found = filtered(catalog, book_tags, spec).withColumn("rank", rank(spec.query, {f: F.col(f) for f in SEARCHED}))
    return found.orderBy(*ordering(spec)).offset((page - 1) * size).limit(size)


def total(catalog: DataFrame, book_tags: DataFrame | None, spec: SearchSpec) -> int:
    return filtered(catalog, book_tags, spec).count()


def select_ids(catalog: DataFrame, book_tags: DataFrame | None, spec: SearchSpec, exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Ids that fit, without those of ``exclude`` (column id), ascending."""
    out = filtered(catalog, book_tags, spec).select("id")
    if exclude is not None:
        out = out.join(exclude.select("id"), "id", "left_anti")
    out = out.orderBy("id")
    return out if limit is None else out.limit(limit)


def resolve_selection(catalog: DataFrame, book_tags: DataFrame | None, request: dict) -> DataFrame:
    """Ids of a request: those of ``ids`` as given (repeats and non-numbers out), or with ``allMatching`` all that fit ``filters`` less ``excludeIds``, up to ``limit``."""
    spark = catalog.sparkSession

    def numbers(values) -> list[tuple[int]]:
        return [(i,) for i in dict.fromkeys(int(x) for x in values or [] if str(x).isdigit())]

    if not request.get("allMatching"):
        return spark.createDataFrame(numbers(request.get("ids")), "id long")
    known = {k: v for k, v in (request.get("filters") or {}).items() if k in SearchSpec.__dataclass_fields__ and v is not None}
    exclude = numbers(request.get("excludeIds"))
    limit = request.get("limit")
    return select_ids(catalog, book_tags, SearchSpec(**known), spark.createDataFrame(exclude, "id long") if exclude else None, int(limit) if limit else None)


def in_request_order(catalog: DataFrame, ids: Sequence) -> DataFrame:
    """Rows of the asked ids in that order with ``pos``, repeats repeated; unknown ids and non-numbers are left out."""
    asked = [(i, int(x)) for i, x in enumerate(x for x in ids if str(x).isdigit())]
    wanted = catalog.sparkSession.createDataFrame(asked, "pos int, wanted long")
    return wanted.join(catalog, F.col("wanted") == catalog["id"]).drop("wanted").orderBy("pos")


def tags_of_books(book_tags: DataFrame) -> DataFrame:
    """book_id and its distinct tags in order."""
    return book_tags.groupBy("book_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def display(catalog: DataFrame, book_tags: DataFrame | None = None) -> DataFrame:
    """Rows as shown: tags, a description of 150 characters (a placeholder if there is none), rating label, size label."""
    out = catalog
    if book_tags is not None:
        grouped = tags_of_books(book_tags)
        out = out.join(grouped, out["id"] == grouped["book_id"], "left").drop("book_id")
    tags = F.coalesce("tags", F.expr("cast(array() as array<string>)")) if book_tags is not None else F.filter(F.split("tags_text", ", "), lambda x: x != "")
    short = t.short_description(F.col("description"))
    shown = F.when(short == "", t.simple_description(F.col("title"), F.col("authors"), tags, F.col("ext"))).otherwise(short)
    return out.withColumns({"tags": tags, "description": shown, "rating_label": rating_label(F.col("douban_rating"), F.col("douban_rating_status")), "size_label": t.format_bytes(F.col("size"))})


def rating_label(rating: Column, status: Column) -> Column:
    """The rating, else its status, else "not found"."""
    return F.coalesce(F.nullif(t.strip(t.text_of(rating)), F.lit("")), F.nullif(t.strip(t.text_of(status)), F.lit("")), F.lit(t.NOT_FOUND))
