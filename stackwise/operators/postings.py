"""Substring search by postings: which rows hold a run of three characters, or of two with a CJK one, by ranges of ids.

A query's terms are cut into the same runs. Rows that hold all runs of a term are looked up, then verified by the search's own
predicate, so the answer is that of a scan. Terms that are too short for a run don't narrow anything.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .search import SEARCHED, term_groups

#: Ids of a block: a run's postings in a block are one row.
BLOCK_BITS = 12
#: Blocks up to which their ranges of ids are pushed to the scan of the catalog.
PUSHED = 64
POSTINGS = "gram string, block long, ids array<int>"
_CJK = re.compile("[一-鿿]")
_NONE = "cast(array() as array<{}>)"


def block_of(ids: Column) -> Column:
    return F.shiftright(ids.cast("long"), BLOCK_BITS)


def _runs(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n))).otherwise(F.expr(_NONE.format("string")))


def grams(fields: dict[str, Column]) -> Column:
    """The distinct runs of all searched fields, A-Z as a-z."""
    lists = []
    for name in SEARCHED:
        lists += [t.let(t.ascii_lower(t.text_of(fields[name])), lambda x: F.concat(_runs(x, 3), F.when(t.has_cjk(x), F.filter(_runs(x, 2), t.has_cjk)).otherwise(F.expr(_NONE.format("string")))))]
    return F.array_distinct(F.concat(*lists))


def grams_of(term: str) -> list[str]:
    """The runs that a row with the term has; none if the term is too short."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in term)
    if len(low) >= 3:
        return list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))
    return [low] if len(low) == 2 and _CJK.search(low) else []


def build(catalog: DataFrame) -> DataFrame:
    """POSTINGS of all rows: an array has at most as many ids as a block."""
    rows = catalog.select("id", F.explode(grams({f: F.col(f) for f in SEARCHED})).alias("gram"))
    place = F.col("id").cast("long").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    return rows.groupBy("gram", block_of(F.col("id")).alias("block")).agg(F.sort_array(F.collect_set(place)).alias("ids"))


def update(postings: DataFrame, catalog: DataFrame, changed: DataFrame) -> DataFrame:
    """POSTINGS of the catalog from those before some ids (column id) were changed, added or removed: only their blocks are made anew."""
    touched = changed.select(block_of(F.col("id")).alias("block")).distinct()
    fresh = build(catalog.join(touched, block_of(catalog["id"]) == touched["block"], "left_semi"))
    return postings.join(touched, "block", "left_anti").select("gram", "block", "ids").unionByName(fresh)


def changed_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of rows that are in one of two snapshots only, or whose searched fields differ."""
    a, b = (x.select("id", F.struct(*SEARCHED).alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.join(b, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("id")


def candidates(postings: DataFrame, query: str) -> DataFrame | None:
    """block and id of the rows that may match each word of the query; None if no word is long enough to tell."""
    words = [[grams_of(v) for v in group] for group in term_groups(query)]
    words = [w for w in words if all(w)]
    if not words:
        return None
    wanted = list(dict.fromkeys(g for w in words for variant in w for g in variant))
    none = F.expr(_NONE.format("int"))
    held = F.map_from_entries(F.collect_list(F.struct("gram", "ids")))
    found = postings.where(F.col("gram").isin(wanted)).groupBy("block").agg(held.alias("held"))

    def of_variant(variant: list[str]) -> Column:
        return reduce(F.array_intersect, (F.coalesce(F.try_element_at("held", F.lit(g)), none) for g in variant))

    ids = reduce(F.array_intersect, (reduce(F.array_union, map(of_variant, w)) for w in words))
    return found.select("block", F.explode(ids).alias("place")).select("block", (F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("id"))


def narrowed(catalog: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """The catalog's rows that may match, for search.search and the like to verify. Few blocks are read as ranges of ids."""
    found = candidates(postings, query)
    if found is None:
        return catalog
    blocks = [r["block"] for r in found.select("block").distinct().limit(PUSHED + 1).collect()]
    if len(blocks) <= PUSHED:
        size = 1 << BLOCK_BITS
        catalog = catalog.where(reduce(lambda a, b: a | b, (F.col("id").between(b * size, (b + 1) * size - 1) for b in blocks), F.lit(False)))
    return catalog.join(found.select("id"), "id", "left_semi")
