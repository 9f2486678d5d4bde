"""The front's side effects: deletions that go back, pauses that outlive the process, bounded fetching, answers as JSON, listings of deep folders."""

from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from stackwise.library import Library, as_json
from stackwise.operators import enrich
from stackwise.operators.backoff import REASON, Backoff
from stackwise.operators.operations import MOVED_BACK
from stackwise.operators.search import SearchSpec
from stackwise.sources import files, pages


@pytest.fixture
def library(spark, tmp_path):
    root = tmp_path / "books"
    root.mkdir()
    (root / "a.txt").write_text("《活着》作者：余华\n一部长篇小说。\n", encoding="utf-8")
    (root / "b.txt").write_text("百年孤独\n一部讲述家族历史的小说。\n", encoding="utf-8")
    lib = Library(spark, str(tmp_path / "catalog"), Backoff(str(tmp_path / "state" / "pause.json"), lambda: 100.0))
    lib.scan(str(root), now=10.0)
    return lib, root


def frozen(lib, root):
    ids = [r["id"] for r in lib.catalog.select("id").collect()]
    batch, items = lib.freeze(ids, str(root), now=20.0)
    items = items.cache()
    assert items.count() == 2
    return batch, items


def test_a_deletion_marks_its_rows(library, tmp_path):
    lib, root = library
    batch, items = frozen(lib, root)
    done, after = lib.execute(batch, items, batch["confirm_phrase"], str(root), str(tmp_path / "claims"), str(tmp_path / "out"), now=30.0)
    assert done["status"] == "completed" and not list(root.iterdir())
    assert {r["status"] for r in lib.catalog.collect()} == {"quarantined"} and {r["status"] for r in after.collect()} == {"moved"}
    assert len(json.loads((tmp_path / "out" / "manifest.json").read_text())) == 2


def test_files_go_back_if_the_catalog_has_changed(library, tmp_path, monkeypatch):
    lib, root = library
    batch, items = frozen(lib, root)
    old, version = lib.catalog, lib.versions()[-1]
    lib.publish(old)  # another writer, after the version was read
    monkeypatch.setattr(lib, "versions", lambda: [version])
    done, after = lib.execute(batch, items, batch["confirm_phrase"], str(root), str(tmp_path / "claims"), str(tmp_path / "out"), now=30.0)
    monkeypatch.undo()
    assert done["status"] == "failed" and done["error"].startswith(MOVED_BACK)
    assert sorted(p.name for p in root.iterdir()) == ["a.txt", "b.txt"]
    assert all(r["status"] == "failed" and r["error"].startswith(MOVED_BACK) and r["quarantine_path"] == "" for r in after.collect())
    assert {r["status"] for r in lib.catalog.collect()} == {"active"}
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == []


def test_pauses_are_kept(tmp_path):
    now = [1000.0]
    path = str(tmp_path / "deep" / "pause.json")
    first = Backoff(path, lambda: now[0])
    assert first.status() == {"active": False, "until": 0.0, "reason": ""}
    assert not any(first.seen(True) for _ in range(enrich.STREAK - 1)) and not first.seen(False)
    assert [first.seen(True) for _ in range(enrich.STREAK)] == [False] * (enrich.STREAK - 1) + [True]
    again = Backoff(path, lambda: now[0])
    assert again.status() == {"active": True, "until": 1000.0 + enrich.PAUSE_SECONDS, "reason": REASON}

    class Timer:
        def __init__(self, delay, start):
            self.delay, self.start_call = delay, start

        def start(self):
            self.alive = True

        def is_alive(self):
            return self.alive

    assert again.resume(print, Timer) == enrich.PAUSE_SECONDS + 2 and again.resume(print, Timer) is None
    now[0] += enrich.PAUSE_SECONDS
    assert not again.status()["active"] and Backoff(path, lambda: now[0]).resume(print, Timer) == 5.0
    with open(path, "w") as f:
        f.write("[1")
    assert not again.status()["active"]


def test_nothing_is_due_in_a_pause(library):
    lib, _ = library
    assert lib.due(20.0).count() == 2
    lib.backoff.pause()
    assert lib.due(20.0).count() == 0


def test_answers_as_json(library):
    lib, _ = library
    total, page = json.loads(as_json(lib.search(SearchSpec("余华"))))
    assert total == 1 and page[0]["title"] == "活着" and "小说" in page[0]["tags"] and {"rating_label", "size_label"} <= set(page[0])
    assert json.loads(as_json({"formats": lib.formats(), "n": 2}))["formats"] == [{"ext": ".txt", "count": 2}]
    assert json.loads(as_json(lib.spark.sql("SELECT CAST(NULL AS STRING) AS x, 1 AS y"))) == [{"x": None, "y": 1}]
    with pytest.raises(TypeError):
        as_json(object())


def test_fetching_is_bounded():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"a": [1, 2]}' if self.path == "/json" else "书".encode() * 100)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        assert pages.fetch_text(f"{at}/x") == "书" * 100 and pages.fetch_text(f"{at}/x", limit=7) == "书书"
        assert pages.fetch_json(f"{at}/json") == {"a": [1, 2]}
        with pytest.raises(ValueError):
            pages.fetch_json(f"{at}/json", limit=5)
    finally:
        server.shutdown()


def test_deep_listing(spark, tmp_path):
    kept = ["x.txt", "a/x.txt", "a/b/x.txt", "a/b/c/d/x.txt", "a/.hid.txt", "e/f/x.txt"]
    for p in [*kept, "a/.git/x.txt", ".h/x.txt", "a/b/__MACOSX/x.txt"]:
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "e" / "link")
    listing = files.list_files(spark, str(tmp_path))
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in listing.collect()) == sorted(kept)
    assert listing.rdd.getNumPartitions() == 5  # the root, a and e alone, a/b and e/f with all below them
    assert files.list_files(spark, str(tmp_path / "a" / "b" / "c" / "d")).count() == 1
