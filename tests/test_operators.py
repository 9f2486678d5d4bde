"""Search, merging, copies, operations, jobs and lookups on small catalogs."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackwise.operators import copies, enrich, jobs, merge, operations, search
from stackwise.operators.search import SearchSpec
from stackwise.plans import repair, scan
from stackwise.schema import CATALOG, evolve
from stackwise.sources import files, readers

BOOKS = [
    (1, "nahan.txt", "呐喊", "鲁迅", "", ""),
    (2, "luxun-biography.txt", "鲁迅传", "张作者", "", ""),
    (3, "percent.txt", "100% Python", "Tester", "", ""),
    (4, "underscore.txt", "A_B", "Tester", "", ""),
    (5, "wildcard-control.txt", "ACB", "Tester", "", ""),
    (6, "plain.txt", "普通书", "普通作者", "", ""),
    (7, "description-only.txt", "将军族", "陈映真", "鲁迅 呐喊", ""),
    (8, "publisher.txt", "出版社检索测试", "", "", "人民文学出版社"),
]


@pytest.fixture(scope="module")
def books(spark):
    return evolve(spark.createDataFrame(BOOKS, "id long, filename string, title string, authors string, description string, publisher string")).cache()


@pytest.mark.parametrize(("query", "titles"), [("鲁迅 呐喊", ["呐喊"]), ("%", ["100% Python"]), ("A_B", ["A_B"]), ("人民文学出版社", ["出版社检索测试"]), ("a_b", ["A_B"]), ("  ", [b[2] for b in BOOKS][::-1])])
def test_search(books, query, titles):
    assert [r["title"] for r in search.search(books, None, SearchSpec(query)).collect()] == titles


def test_pages_are_clamped(books):
    assert search.search(books, None, SearchSpec(), page=-3, page_size=1).count() == 8  # ten rows a page at least
    assert search.search(books, None, SearchSpec(), page=2, page_size=1).count() == 0


def test_many_ids(books):
    ids = [i % 8 + 1 for i in range(1200)]
    assert search.in_request_order(books, ids).count() == 1200
    exclude = books.sparkSession.range(1, 1500)
    assert search.select_ids(books, None, SearchSpec(), exclude, limit=5).count() == 0


def test_evolve_fills_missing(spark):
    row = evolve(spark.createDataFrame([(1, None)], "id long, title string")).first()
    assert (row["title"], row["source"], row["status"], row["size"], row["remote_lookup_version"]) == ("", "local", "active", 0, 0)


@pytest.mark.parametrize("n", [0, 1, 20_000, 200_000])
def test_upsert_of_many_new_files(spark, n):
    """Every new file stays, with ids that follow the catalog's greatest by path, although adaptive plans differ by branch."""
    new = spark.range(n).select(F.concat(F.lit("/x/"), F.md5(F.col("id").cast("string")), F.lit(".txt")).alias("path"), F.col("id").alias("size"), F.lit(1.0).alias("mtime"), F.lit("Some title").alias("title"), F.repeat(F.lit("d "), 40).alias("description"))
    old = evolve(spark.createDataFrame([(7, "/a.txt")], "id long, path string"))
    if n > 100_000:  # the numbering alone, on wide rows
        out = merge.with_new_ids(new, old, "path")
    else:
        out = merge.upsert(old, new, 1.0).where("path <> '/a.txt'")
    r = out.select("id", "path").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("least"), F.max("id").alias("most"), F.countDistinct("path").alias("paths")).first()
    assert (r["n"], r["d"], r["paths"]) == (n, n, n) and (not n or (r["least"], r["most"]) == (8, 7 + n))
    ids = [x["path"] for x in out.select("id", "path").orderBy("id").collect()]
    assert ids == sorted(ids)


def test_upsert(spark):
    old = evolve(spark.createDataFrame([(5, "/a/x.txt", "旧书", "人", "d", "9.1", "quarantined"), (6, "/a/y.txt", "y book", "", "", "", "active")], "id long, path string, title string, authors string, description string, douban_rating string, status string"))
    new = spark.createDataFrame([("/a/x.txt", 3, 1.0, "0001", "unknown", "", ["历史"], False), ("/b/z.txt", 4, 2.0, "", "", "", None, False), ("/b/a.txt", 4, 2.0, "新书", "", "", None, False)], "path string, size long, mtime double, title string, authors string, description string, tags array<string>, reset_remote boolean")
    out = {r["path"]: r for r in merge.upsert(old, new, 7.0).collect()}
    x = out["/a/x.txt"]
    assert (x["id"], x["title"], x["authors"], x["description"], x["status"], x["douban_rating_status"], x["tags_text"], x["updated_at"]) == (5, "旧书", "人", "d", "active", "已获取", "历史", 7.0)
    assert out["/a/y.txt"]["updated_at"] == 0.0
    assert {(p, out[p]["id"], out[p]["title"]) for p in ("/b/a.txt", "/b/z.txt")} == {("/b/a.txt", 7, "新书"), ("/b/z.txt", 8, "z")}
    reset = new.withColumn("reset_remote", F.lit(True)).where("path = '/a/x.txt'")
    r = merge.upsert(old, reset, 7.0).where("id = 5").first()
    assert (r["douban_rating"], r["douban_rating_status"], r["remote_lookup_version"]) == ("", "待查询", 0)


def test_apply_lookup_and_tags(spark):
    old = evolve(spark.createDataFrame([(1, "p", "书")], "id long, path string, title string"))
    found = spark.createDataFrame([(1, "7.1", ["小说"])], "id long, douban_rating string, tags array<string>")
    r = merge.apply_lookup(old, found, 3.0).first()
    assert (r["title"], r["douban_rating"], r["douban_rating_status"], r["tags_text"], r["remote_lookup_version"]) == ("书", "7.1", "已获取", "小说", 2)
    ids = spark.createDataFrame([(1,), (99,)], "id long")
    catalog, bridge = merge.add_tags(old, spark.createDataFrame([(1, "历史")], "book_id long, tag string"), ids, ["fiction", "unknown"], 4.0)
    assert catalog.first()["tags_text"] == "历史, 小说" and sorted(map(tuple, bridge.collect())) == [(1, "历史"), (1, "小说")]


def test_copies(spark):
    rows = [(1, "a.txt", "9.1", "u", "active"), (2, "a.txt", "", "", "active"), (3, "b.txt", "1", "u", "active"), (4, "b.txt", "2", "u", "active"), (5, "b.txt", "", "", "active")]
    out = copies.propagate(evolve(spark.createDataFrame(rows, "id long, filename string, douban_rating string, douban_url string, status string")), 5.0)
    assert {r["id"]: (r["douban_rating"], r["changed"]) for r in out.collect()} == {1: ("9.1", False), 2: ("9.1", True), 3: ("1", False), 4: ("2", False), 5: ("", False)}


def test_due_order(spark):
    rows = evolve(spark.createDataFrame([(1, "An English Book"), (2, "中文书")], "id long, title string"))
    assert [r["id"] for r in enrich.select_due(rows, 10.0).collect()] == [2, 1]


def test_pauses(spark):
    log = spark.createDataFrame([(float(i), i != 3) for i in range(20)], "at double, failed boolean")
    assert [(r["at"], r["paused_until"]) for r in enrich.failure_pauses(log).orderBy("at").collect()] == [(11.0, 11.0 + 6 * 3600), (19.0, 19.0 + 6 * 3600)]


PAGE = '<div class="result"><h3><a href="x" title="活着">活着</a></h3><span class="rating_nums">7.1</span><span class="subject-cast">余华 / 2012</span><p>s <b>t</b></p><a href="https://www.douban.com/link2/?url=https%3A%2F%2Fbook.douban.com%2Fsubject%2F2%2F&q=1">l</a></div>'


def test_parse_and_match(spark):
    found = enrich.parse_candidates(spark.createDataFrame([(1, "x" + PAGE)], "id long, html string"))
    r = found.first()
    assert (r["title"], r["rating"], r["cast"], r["summary"], r["url"]) == ("活着", "7.1", "余华 / 2012", "s t", "https://book.douban.com/subject/2/")
    asked = spark.createDataFrame([(1, "活着", "余华", "", "")], "id long, title string, authors string, description string, filename string")
    matched = enrich.identity_match(asked, found)
    got = enrich.lookup_result(asked, matched).first()
    assert (got["douban_rating"], got["douban_rating_status"], got["remote_source"], got["title"]) == ("7.1", "已获取", "豆瓣", "活着")


def _throttle_spec(rows):
    out, last = [], None
    for seq, at, status, processed in rows:
        if last is None or status != last[2] or status in jobs.TERMINAL or at - last[0] >= 10 or processed - last[1] >= 250:
            out.append(seq)
            last = (at, processed, status)
        else:
            last = (last[0], last[1], status)
    return out


def test_throttling(spark):
    rows = [(0, 0.0, "running", 0)] + [(i, i * 0.01, "running", i) for i in range(1, 200)] + [(250, 2.5, "running", 250), (251, 2.6, "finished", 251)]
    got = jobs.throttled(spark.createDataFrame([("j", *r) for r in rows], "id string, seq long, at double, status string, processed long"))
    assert [r["seq"] for r in got.orderBy("seq").collect()] == [0, 250, 251] == _throttle_spec(rows)


def test_recovery_and_errors(spark):
    rows = [(f"old{i}", "scan", "finished", "", float(100 + i), 0.0, [""]) for i in range(105)] + [("act", "scan", "running", "", 1.0, 0.0, [f"e{i}" for i in range(55)])]
    out = jobs.recover(spark.createDataFrame(rows, "id string, kind string, status string, message string, created_at double, updated_at double, errors array<string>"), 9.0)
    r = out.where("interrupted").collect()
    assert len(r) == 1 and r[0]["id"] == "act" and r[0]["status"] == "interrupted" and len(r[0]["errors"]) == 50 and out.count() == 101


@pytest.fixture
def library(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.txt").write_text("《活着》作者：余华\n一部长篇小说。\n", encoding="utf-8")
    (tmp_path / "sub" / "边城.TXT").write_bytes("边城\n沈从文的作品\n".encode("gb18030"))
    (tmp_path / "sub" / "_skip.jpg").write_bytes(b"x")
    (tmp_path / ".hidden" / "b.txt").write_text("b")
    return tmp_path


def test_scan_twice(spark, library):
    snapshot, found = scan.scan(spark, str(library), scan.empty_catalog(spark), 10.0)
    assert {r["filename"]: r["action"] for r in found.collect()} == {"a.txt": "index", "边城.TXT": "index", "_skip.jpg": "skip"}
    path = scan.publish(snapshot, str(library / ".catalog"), 1)
    first = spark.read.schema(CATALOG).parquet(path)
    rows = {r["filename"]: r for r in first.collect()}
    assert (rows["a.txt"]["title"], rows["a.txt"]["authors"]) == ("活着", "余华") and rows["边城.TXT"]["title"] == "边城"
    assert rows["a.txt"]["ext"] == ".txt" and "小说" in rows["a.txt"]["tags_text"]
    again = scan.classify_files(files.list_files(spark, str(library)), first, 20.0)
    assert all(r["action"] in ("touch", "skip") for r in again.where(F.col("filename") != "边城.TXT").collect())


def test_two_phase_deletion(spark, library, tmp_path_factory):
    snapshot, _ = scan.scan(spark, str(library), scan.empty_catalog(spark), 10.0)
    catalog = spark.read.schema(CATALOG).parquet(scan.publish(snapshot, str(tmp_path_factory.mktemp("c")), 1))
    book = catalog.where("filename = 'a.txt'").first()
    listing = lambda: files.list_files(spark, str(library))
    out, state = str(tmp_path_factory.mktemp("q")), str(tmp_path_factory.mktemp("s"))
    with pytest.raises(ValueError):
        operations.freeze(catalog, [book["id"], 999], listing(), 1.0)
    batch, items = operations.freeze(catalog, [book["id"]], listing(), 1.0)
    items = items.cache()
    items.count()
    with pytest.raises(ValueError):
        operations.execute(batch, items, catalog, listing(), "no", state, out, 2.0)
    done, after = operations.execute(batch, items, catalog, listing(), batch["confirm_phrase"], state, out, 2.0)
    assert done["status"] == "completed" and [r["status"] for r in after.collect()] == ["moved"] and not os.path.exists(book["path"])
    assert operations.quarantined(catalog, after, 3.0).where("status = 'quarantined'").count() == 1
    rejected, _ = operations.execute(batch, items, catalog, listing(), batch["confirm_phrase"], state, out, 2.0)
    assert rejected["status"] == "rejected"
    assert operations.claim(state, "x") and not operations.claim(state, "x")


def test_repair(spark):
    old = evolve(spark.createDataFrame([(1, "/p/a.txt", "0001", "v1.2", "", ".txt"), (2, "/p/b.txt", "好书", "人", "好书的简介", ".txt")], "id long, path string, title string, authors string, description string, ext string"))
    extracted = spark.createDataFrame([("/p/a.txt", "边城", "沈从文", "", "", "", "", "", "", ["小说"]), ("/p/b.txt", "别的书", "别人", "", "", "", "", "", "", [])], "path string, title string, authors string, description string, language string, publisher string, published_year string, isbn string, cover_path string, tags array<string>")
    preview = repair.repair_preview(old, extracted)
    changes = {r["id"]: r["changes"] for r in preview.collect()}
    assert changes[1]["title"] == "边城" and changes[1]["authors"] == "沈从文" and "title" not in changes[2] and "authors" not in changes[2]
    assert repair.repair_apply(old, preview, 5.0).where("id = 1").first()["douban_rating_status"] == "待查询"


def test_readers():
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfile full-path="p.opf"/></c>')
        z.writestr("p.opf", "<p xmlns:dc='d'><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:subject>s</dc:subject></p>")
        z.writestr("cover.html", "no")
        z.writestr("one.html", "<p>text &amp; more</p>")
    assert readers.read_one(".epub", buffer.getvalue()) == {"title": "T", "authors": "A; B", "subjects": ["s"], "description": "text & more"}
    assert "scan_error" in readers.read_one(".docx", b"not a zip") and readers.read_one(".fb2", b"x") == {}
    assert readers.read_one(".rtf", rb"{\rtf1\ansi Hello \'e9 world}")["description"] == "Hello world"
    record = lambda kind, data: kind.to_bytes(4, "big") + (len(data) + 8).to_bytes(4, "big") + data
    body = record(100, "余华".encode()) + record(503, "活着".encode()) + record(106, b"1993-01-01")
    raw = b"name".ljust(32, b"\0") + b"EXTH" + (len(body) + 12).to_bytes(4, "big") + (3).to_bytes(4, "big") + body
    assert readers.read_one(".mobi", raw) == {"title": "活着", "subjects": [], "published_year": "1993", "authors": "余华"}
    assert readers.decode_bytes("中文".encode("gb18030")) == "中文" and readers.decode_bytes(b"\xef\xbb\xbfx") == "x"
    opf = readers.read_opf(io.BytesIO(b"<p><title>T</title><date>2001-02</date><identifier>978-0306406157</identifier><meta name='cover' content='c'/><item id='c' href='c.jpg'/></p>"))
    assert opf == {"title": "T", "published_year": "2001", "isbn": "978-0306406157", "cover_path": "c.jpg", "subjects": []}


def test_sidecars(spark):
    rows = [("/d/a.epub", "/d", "a.epub", "a", ".epub", True), ("/d/a.opf", "/d", "a.opf", "a", ".opf", False), ("/d/b.pdf", "/d", "b.pdf", "b", ".pdf", True), ("/d/b.jpg", "/d", "b.jpg", "b", ".jpg", False), ("/e/c.pdf", "/e", "c.pdf", "c", ".pdf", True), ("/e/cover.png", "/e", "cover.png", "cover", ".png", False)]
    got = {r["path"]: (r["opf"], r["cover"]) for r in files.sidecars(spark.createDataFrame(rows, "path string, dir string, filename string, stem string, ext string, supported boolean")).collect()}
    assert got == {"/d/a.epub": ("/d/a.opf", None), "/d/b.pdf": ("/d/a.opf", "/d/b.jpg"), "/e/c.pdf": (None, "/e/cover.png")}


def test_copy_out(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "n.txt").write_text(d)
    rows = spark.createDataFrame(pd.DataFrame({"path": [str(tmp_path / "x/n.txt"), str(tmp_path / "y/n.txt"), str(tmp_path / "gone.txt")]}))
    got = operations.copy_out(rows, str(tmp_path / "out"))
    assert (got["copied"], got["requested"], len(got["errors"])) == (2, 3, 1) and sorted(os.listdir(tmp_path / "out")) == ["n (2).txt", "n.txt"]
