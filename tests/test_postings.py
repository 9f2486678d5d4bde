"""Substring search by postings: the rows of a scan, from far fewer rows; updates are those of a new index."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackwise.library import Library
from stackwise.operators import postings, search
from stackwise.operators.search import SearchSpec
from stackwise.schema import CATALOG, evolve

QUERIES = ["abc", "ABC def", "ab", "x", "鲁迅", "魯迅 呐喊", "呐", "a%b", "a_b", "é日", "日本语", "z" * 40, "", "a b c", "0-306", "Lu Xun", "迅a", "  abc   吶喊 "]


def table(spark, n: int, seed: int):
    rnd = random.Random(seed)
    pieces = ["abc", "def", "ab", "鲁迅", "魯迅", "吶喊", "呐", "%", "_", "é", "日本", "语", "A", "B", "a%b", "a_b", " ", "0-306", "Xun", "Lu ", "x"]
    word = lambda k: "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, k)))
    rows = [(i * 37 + rnd.randint(0, 20), word(6), word(3), word(2), word(2) or None, word(2), word(1)) for i in range(n)]
    return evolve(spark.createDataFrame(rows, "id long, title string, authors string, filename string, tags_text string, isbn string, publisher string"))


@pytest.mark.parametrize("pushed", [64, 0])
def test_rows_of_a_scan(spark, monkeypatch, pushed):
    monkeypatch.setattr(postings, "PUSHED", pushed)
    catalog = table(spark, 1500, 1).cache()
    index = postings.build(catalog).cache()
    for q in QUERIES:
        spec = SearchSpec(q, status="all")
        whole = sorted(r["id"] for r in search.filtered(catalog, None, spec).select("id").collect())
        assert sorted(r["id"] for r in search.filtered(postings.narrowed(catalog, index, q), None, spec).select("id").collect()) == whole, q
    rare = catalog.unionByName(catalog.limit(1).withColumns({"id": F.lit(7_000_000).cast("long"), "title": F.lit("quite rare")}))
    index = postings.build(rare)
    assert postings.candidates(index, "rare quite").count() == 1 and postings.candidates(index, "nowhere").count() == 0
    assert postings.candidates(index, "no") is None and postings.candidates(index, "x 鲁迅") is not None


def test_updates_touch_their_blocks(spark):
    before = table(spark, 1200, 2).cache()
    after = before.where("id % 11 <> 0 or id < 20000").withColumn("title", F.when(F.col("id").between(5000, 5400), F.lit("changed 鲁迅")).otherwise(F.col("title")))
    after = after.unionByName(before.limit(3).withColumn("id", F.col("id") + 9_000_000)).cache()
    changed = postings.changed_ids(before, after).cache()
    old = postings.build(before).cache()
    new = postings.update(old, after, changed)
    assert {tuple(map(str, r)) for r in new.collect()} == {tuple(map(str, r)) for r in postings.build(after).collect()}
    blocks = {r["b"] for r in changed.select(postings.block_of(F.col("id")).alias("b")).distinct().collect()}
    assert 1 < len(blocks) < old.select("block").distinct().count()


def test_a_library_searches_by_its_postings(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "c"))
    lib.publish(table(spark, 300, 3).select(CATALOG.names))
    spec = SearchSpec("abc 鲁迅")
    total, page = lib.search(spec)
    rows = [r["id"] for r in page.collect()]
    assert lib.postings() is None
    lib.index()
    assert lib.postings().count() > 0
    again, page = lib.search(spec)
    assert (again, [r["id"] for r in page.collect()]) == (total, rows)
    lib.publish(lib.catalog.withColumn("title", F.when(F.col("id") < 2000, F.lit("abc 鲁迅")).otherwise(F.col("title"))))
    assert lib.postings() is None  # of an older version
    lib.index()
    scanned = search.total(lib.catalog, None, spec)
    assert lib.search(spec)[0] == scanned > total
    assert {tuple(map(str, r)) for r in lib.postings().collect()} == {tuple(map(str, r)) for r in postings.build(lib.catalog).collect()}
