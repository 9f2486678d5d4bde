"""Reading chosen files only, large ones by their directories, and the progress of a scan."""

from __future__ import annotations

import io
import os
import random
import resource
import zipfile
import zlib

import pytest

from stackwise.library import Library
from stackwise.sources import chosen, pdf, readers


def epub(path, title: str, filling: int = 0) -> None:
    with zipfile.ZipFile(path, "w") as z:
        if filling:
            with z.open("images/big.bin", "w", force_zip64=True) as f:
                block = random.Random(1).randbytes(1 << 20)
                for _ in range(filling):
                    f.write(block)
        z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfile full-path="p.opf"/></c>')
        z.writestr("p.opf", f"<p xmlns:dc='d'><dc:title>{title}</dc:title><dc:creator>沈从文</dc:creator><dc:subject>小说</dc:subject></p>")
        z.writestr("one.xhtml", "<p>一部讲述湘西的小说。</p>")


def docx(path, title: str, paragraphs: int) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docProps/core.xml", f"<c xmlns:dc='d'><dc:title>{title}</dc:title><dc:creator>余华</dc:creator></c>")
        with z.open("word/document.xml", "w") as f:
            f.write(b"<w:d xmlns:w='w'>")
            for i in range(paragraphs):
                f.write(b"<w:p><w:r><w:t>word%d &amp;amp; more</w:t></w:r></w:p>" % i)
            f.write(b"</w:d>")


def utf16(text: str) -> bytes:
    return b"<feff" + text.encode("utf-16-be").hex().encode() + b">"


def plain_pdf(title: bytes, author: bytes, filling: int = 0, later: bytes | None = None) -> bytes:
    """A classic table, after a large stream; ``later``: an update with another title."""
    out = bytearray(b"%PDF-1.4\n")
    places = {}

    def add(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n" % n + body + b"\nendobj\n")

    add(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    add(2, b"<< /Type /Pages /Kids [] /Count 0 >>")
    add(4, b"<< /Length %d >>\nstream\n" % filling + b"x" * filling + b"\nendstream")
    add(3, b"<< /Title " + title + b" /Author " + author + b" /Producer (p\\(q\\)) /Other [1 2 0 R /N <</A (z)>>] >>")
    table = len(out)
    out.extend(b"xref\n0 5\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % places[n] for n in (1, 2, 3, 4)))
    out.extend(b"trailer\n<< /Size 5 /Root 1 0 R /Info 3 0 R >>\nstartxref\n%d\n%%%%EOF\n" % table)
    if later is not None:
        add(5, b"<< /Title " + later + b" >>")
        second = len(out)
        out.extend(b"xref\n5 1\n%010d 00000 n \ntrailer\n<< /Size 6 /Root 1 0 R /Info 5 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (places[5], table, second))
    return bytes(out)


def packed_pdf(title: bytes, predictor: int | None) -> bytes:
    """Cross-references and the information dictionary in packed streams."""
    out = bytearray(b"%PDF-1.5\n")
    inner = b"3 0 6 28 " + b"<< /Title " + title + b" /Author 6 0 R >>"
    first = len(b"3 0 6 28 ")
    body = b"<< /Title " + title + b" /Author 6 0 R >>"
    heads = b"3 0 6 %d " % (len(body) + 1)
    first = len(heads)
    inner = heads + body + b" (B. Writer)"
    packed = zlib.compress(inner)
    at = {1: len(out)}
    out.extend(b"1 0 obj << /Type /Catalog >> endobj\n")
    at[4] = len(out)
    out.extend(b"4 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (first, len(packed)) + packed + b"\nendstream endobj\n")
    at[5] = len(out)
    rows = [(0, 0, 0), (1, at[1], 0), (0, 0, 0), (2, 4, 0), (1, at[4], 0), (1, at[5], 0), (2, 4, 1)]
    raw = [bytes([k]) + p.to_bytes(3, "big") + bytes([i]) for k, p, i in rows]
    if predictor:
        lines, above = b"", bytes(5)
        for n, r in enumerate(raw):
            kind = (predictor + n) % 5
            line = bytearray()
            for i in range(5):
                left, corner = (r[i - 1], above[i - 1]) if i else (0, 0)
                near = left + above[i] - corner
                guess = [0, left, above[i], (left + above[i]) // 2, min((left, above[i], corner), key=lambda x, near=near: abs(near - x))][kind]
                line.append((r[i] - guess) & 255)
            lines, above = lines + bytes([kind]) + bytes(line), r
    else:
        lines = b"".join(raw)
    stream = zlib.compress(lines)
    more = b"/DecodeParms << /Predictor 12 /Columns 5 >> " if predictor else b""
    out.extend(b"5 0 obj << /Type /XRef /Size 7 /W [1 3 1] /Root 1 0 R /Info 3 0 R /Filter /FlateDecode " + more + b"/Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at[5])
    return bytes(out)


def information(raw: bytes) -> dict:
    return pdf.document_information(io.BytesIO(raw))


def test_pdf_information():
    assert information(plain_pdf(b"(A \\(b\\) \\101\\r\\n)", utf16("鲁迅"))) == {"Title": "A (b) A\r\n", "Author": "鲁迅", "Producer": "p(q)"}
    assert information(plain_pdf(b"(old)", b"(x)", later=utf16("新"))) == {"Title": "新"}
    assert information(plain_pdf(b"<414>", b"()")) == {"Title": "A@", "Producer": "p(q)"}
    for predictor in (None, *range(1, 6)):
        assert information(packed_pdf(b"(T " + b"x" * 9 + b")", predictor)) == {"Title": "T xxxxxxxxx", "Author": "B. Writer"}
    assert information(plain_pdf(b"(T)", b"(A)").replace(b"/Info 3 0 R", b"/Encrypt 1 0 R /Info 3 0 R")) == {}
    for bad in (b"", b"%PDF-1.4\n", b"x" * 5000, plain_pdf(b"(T)", b"(A)")[:-30], plain_pdf(b"(T)", b"(A)").replace(b"startxref\n", b"startxref\n9")):
        with pytest.raises(Exception):  # noqa: B017  whatever it is, a scan keeps it as scan_error
            information(bad)


def test_damaged_pdfs_end():
    """Bytes that are damaged at random give fields or an error, and no endless loop."""
    rnd = random.Random(5)
    for raw in (plain_pdf(b"(T)", b"(A)", later=b"(U)"), packed_pdf(b"(T)", 2)):
        for _ in range(400):
            damaged = bytearray(raw)
            for _ in range(rnd.randint(1, 12)):
                damaged[rnd.randrange(len(damaged))] = rnd.choice([rnd.randrange(256), *b"<>[]()/ 0"])
            fields = readers.read_file(".pdf", lambda damaged=damaged: io.BytesIO(bytes(damaged)))
            assert set(fields) <= {"title", "authors", "scan_error"}


def test_docx_by_stream(tmp_path):
    docx(tmp_path / "a.docx", "", 3000)
    fields = readers.read_one(".docx", (tmp_path / "a.docx").read_bytes())
    whole = " ".join(f"word{i} & more" for i in range(3000))
    assert fields["description"] == whole[: len(fields["description"])] and len(fields["description"]) in (1399, 1400) and fields["authors"] == "余华"


def test_large_files_are_read_in_part(tmp_path):
    """100 MB archives and PDFs and much XML: little is read, and memory stays far below their size."""
    epub(tmp_path / "a.epub", "边城", 100)
    (tmp_path / "b.pdf").write_bytes(plain_pdf(utf16("活着"), utf16("余华"), 100 << 20))
    docx(tmp_path / "c.docx", "兄弟", 600_000)  # 33 MB of XML
    got, counts = {}, {}
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for name in ("a.epub", "b.pdf", "c.docx"):
        counts[name] = [0]
        path = str(tmp_path / name)
        got[name] = readers.read_file(os.path.splitext(name)[1], lambda path=path, name=name: io.BufferedReader(chosen._Counted(chosen.open_file(path), counts[name]), 1 << 16))
    grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
    assert got["a.epub"]["title"] == "边城" and got["a.epub"]["description"] == "一部讲述湘西的小说。" and counts["a.epub"][0] < 1 << 20
    assert (got["b.pdf"]["title"], got["b.pdf"]["authors"]) == ("活着", "余华") and counts["b.pdf"][0] < 1 << 20
    assert got["c.docx"]["title"] == "兄弟" and got["c.docx"]["description"].startswith("word0 & more word1")
    assert grown < 64 << 10  # KB


@pytest.fixture
def shelf(tmp_path):
    root = tmp_path / "books"
    for i in range(1000):
        folder = root / f"s{i % 7}" / f"t{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"b{i}.txt").write_text(f"好书{i}章节\n一部讲述家族历史的小说，第{i}本。\n", encoding="utf-8")
    with open(root / "video.mp4", "wb") as f:
        f.truncate(3 << 30)  # sparse: a file that no task could hold
    return root


def test_only_chosen_files_are_read(spark, shelf, tmp_path):
    lib = Library(spark, str(tmp_path / "catalog"))
    told = []
    first = lib.scan(str(shelf), now=10.0, report=lambda n, state: told.append((n, state)))
    assert (first["processed"], first["found"], first["indexed"], first["skipped"], first["files_read"], first["error_count"]) == (1001, 1000, 1000, 1, 1000, 0)
    assert told[-1] == (1001, "finished") and 5 <= len(told) <= 12 and all(s == "running" for _, s in told[:-1]) and [n for n, _ in told] == sorted(n for n, _ in told)
    assert first["bytes_read"] < 200_000 and not os.listdir(tmp_path / "catalog" / "_work")
    changed = shelf / "s1" / "t1" / "b1.txt"
    changed.write_text("全新的书\n一部科幻小说。\n", encoding="utf-8")
    again = lib.scan(str(shelf), now=20.0)
    assert (again["processed"], again["unchanged"], again["indexed"], again["files_read"]) == (1001, 999, 1, 1)
    assert again["bytes_read"] == changed.stat().st_size
    assert lib.catalog.where(f"path = '{changed}'").first()["title"] == "全新的书" and lib.catalog.count() == 1000


def test_faults_are_of_their_file(spark, tmp_path):
    root = tmp_path / "books"
    root.mkdir()
    epub(root / "a.epub", "边城")
    (root / "b.epub").write_bytes(b"PK damaged")
    (root / "c.txt").write_text("活着的书\n小说\n", encoding="utf-8")
    (root / "d.fb2").write_bytes(b"x")
    (root / "a.opf").write_text("<p><title>边城记</title><broken")
    os.symlink(root / "gone.txt", root / "e.txt")
    lib = Library(spark, str(tmp_path / "catalog"))
    counts = lib.scan(str(root), now=10.0)
    rows = {r["filename"]: r for r in lib.catalog.collect()}
    assert counts["error_count"] == 1 and rows["b.epub"]["scan_error"] and not any(rows[n]["scan_error"] for n in ("a.epub", "c.txt", "d.fb2"))
    assert rows["a.epub"]["title"] == "边城" and "小说" in rows["a.epub"]["tags_text"]
    listed = spark.createDataFrame([(str(root / "none.txt"), ".txt", None), (f"file://{root}/c.txt", ".txt", str(root / "none.opf"))], "path string, ext string, opf string")
    read = {os.path.basename(r["path"]): r for r in chosen.read_files(listed).collect()}
    assert "No such file" in read["none.txt"]["own"]["scan_error"] and read["c.txt"]["own"]["description"].startswith("活着") and read["c.txt"]["side"]["title"] is None
