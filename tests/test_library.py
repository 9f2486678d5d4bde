"""The engine's front, end to end on a small folder."""

from __future__ import annotations

import pytest

from stackwise.library import LOOKUPS_OFF, Library
from stackwise.operators.search import SearchSpec
from stackwise.streaming.incremental import ScanProgress


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / "a.txt").write_text("《活着》作者：余华\n一部长篇小说，写了一个人的一生。\n", encoding="utf-8")
    (root / "b.txt").write_text("百年孤独\n一部讲述家族历史的小说。\n", encoding="utf-8")
    (root / "c.jpg").write_bytes(b"x")
    lib = Library(spark, str(tmp_path_factory.mktemp("catalog")))
    assert lib.versions() == [] and lib.catalog.count() == 0
    counts = lib.scan(str(root), now=10.0)
    assert (counts["processed"], counts["found"], counts["indexed"], counts["skipped"]) == (3, 2, 2, 1)
    return lib, root


def test_requests(library, monkeypatch):
    lib, root = library
    total, page = lib.search(SearchSpec("余华"))
    row = page.first()
    assert total == 1 and row["title"] == "活着" and "小说" in row["tags"] and row["rating_label"] == "待查询"
    assert {r["ext"]: r["count"] for r in lib.formats().collect()} == {".txt": 2} and lib.tags().where("tag = '小说'").first()["count"] == 2
    stats = lib.stats(now=20.0)
    assert stats["status"] == {"active": 2} and stats["lookups"]["due"] == 2 and stats["total_size"] > 0
    assert lib.due(20.0).count() == 2
    monkeypatch.setenv(LOOKUPS_OFF, "yes")
    assert lib.due(20.0).count() == 0
    assert all(r["violations"] == 0 for r in lib.invariants(str(root)).collect())
    assert [r["id"] for r in lib.select({"allMatching": True, "filters": {"query": "活着"}, "excludeIds": ["99"]}).collect()] == [row["id"]]
    assert [r["id"] for r in lib.select({"ids": ["2", "x", 2, 1]}).collect()] == [2, 1]


def test_writing(library):
    lib, root = library
    before = len(lib.versions())
    lib.add_tags(lib.select({"ids": [1]}), ["travel"], now=30.0)
    assert "旅行" in lib.catalog.where("id = 1").first()["tags_text"] and len(lib.versions()) == before + 1
    assert lib.share_copies(now=40.0) == 0
    assert lib.scan(str(root), now=50.0)["unchanged"] == 2
    assert lib.repair(str(root)).count() == 0


def test_progress_is_spaced():
    told, clock = [], iter([0.0, 0.1, 0.2, 0.3, 3.0, 3.1])
    p = ScanProgress(lambda n, s: told.append((n, s)), lambda: next(clock))
    for n in (50, 60, 10, 5, 1):
        p.seen(n)
    assert told == [(110, "running"), (125, "running")]
