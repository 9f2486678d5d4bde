"""Pages far down: those of an offset, from the files that hold them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackwise.library import Library
from stackwise.operators import paging, search
from stackwise.operators.search import SearchSpec
from stackwise.schema import CATALOG, evolve


@pytest.fixture(scope="module")
def catalog(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["abc x", "ABD", "é", "", "zz abc"]) + str(rnd.randint(0, 30)), rnd.choice(["", "7.1", "x", "9"]), rnd.randint(0, 5), float(rnd.randint(0, 9))) for i in rnd.sample(range(100_000), 1234)]
    return evolve(spark.createDataFrame(rows, "id long, title string, douban_rating string, size long, updated_at double")).cache()


@pytest.mark.parametrize("spec", [SearchSpec(), SearchSpec("abc", sort="title", order="asc"), SearchSpec(sort="douban", order="asc"), SearchSpec(sort="douban"), SearchSpec(sort="size", format=".none")])
def test_pages_are_those_of_an_offset(spark, catalog, tmp_path, spec):
    folder = str(tmp_path / "o")
    n = paging.build(paging.ordered(catalog, None, spec), folder, 90)
    assert n == search.total(catalog, None, spec)
    for page, size in ((1, 50), (2, 50), (7, 37), (12, 100), (13, 100), (400, 50), (0, 3)):
        whole = [r["id"] for r in search.search(catalog, None, spec, page, size).collect()]
        rows = paging.page_rows(catalog, folder, page, size).collect()
        assert [r["id"] for r in rows] == whole
        assert [r["pos"] for r in rows] == list(range((max(1, page) - 1) * max(10, size), (max(1, page) - 1) * max(10, size) + len(rows)))


def test_a_page_reads_its_files(spark, catalog, tmp_path):
    folder = str(tmp_path / "o")
    paging.build(paging.ordered(catalog, None, SearchSpec()), folder, 100)
    files = {f for page in (1, 9) for f in [tuple(paging.page_ids(spark, folder, page, 50).inputFiles())]}
    assert all(1 <= len(f) <= 2 for f in files) and spark.read.parquet(f"{folder}/ids").select(F.input_file_name()).distinct().count() > 10


def test_a_library_keeps_its_orders(spark, catalog, tmp_path):
    lib = Library(spark, str(tmp_path / "c"))
    lib.publish(catalog.select(CATALOG.names))
    spec = SearchSpec(sort="title", order="asc")
    assert lib.page(spec, 20) is None
    assert lib.keep_order(spec) == 1234 and lib.keep_order(spec) is None
    assert [r["id"] for r in lib.page(spec, 20).collect()] == [r["id"] for r in search.search(lib.catalog, lib.book_tags, spec, 20).collect()]
    assert lib.page(SearchSpec(sort="size"), 20) is None
    lib.publish(lib.catalog)
    assert lib.page(spec, 20) is None  # of an older version
