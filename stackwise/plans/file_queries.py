"""Registered queries of files: book files are made from the driver's tables, written, listed and read again; the SQL says what must come out."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources import chosen, files, readers
from .queries import query
from .views import table


def book_bytes(ext: str, title: str, author: str, publisher: str) -> bytes:
    """A small book of a format, with these fields and a text of both names."""
    if ext in (".txt", ".fb2"):
        return f"{title}\n{author}".encode()
    if ext == ".mobi":
        records = b"".join(k.to_bytes(4, "big") + (len(v) + 8).to_bytes(4, "big") + v for k, v in ((503, title.encode()), (100, author.encode()), (101, publisher.encode()), (106, b"1993-01")))
        return b"database".ljust(78, b"\0") + b"EXTH" + (len(records) + 12).to_bytes(4, "big") + (4).to_bytes(4, "big") + records
    if ext == ".pdf":
        info = b"<< /Title <feff" + title.encode("utf-16-be").hex().encode() + b"> /Author (" + author.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") >>"
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 0 >>", info]
        out, places = b"%PDF-1.4\n", []
        for i, body in enumerate(objects, start=1):
            places.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
        table_rows = b"".join(b"%010d 00000 n \n" % p for p in places)
        return out + b"xref\n0 4\n0000000000 65535 f \n" + table_rows + b"trailer\n<< /Size 4 /Root 1 0 R /Info 3 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)
    held = io.BytesIO()
    core = f"<dc:title>{title}</dc:title><dc:creator>{author}</dc:creator>"
    with zipfile.ZipFile(held, "w") as z:
        if ext == ".docx":
            z.writestr("docProps/core.xml", f"<c xmlns:dc='d'>{core}</c>")
            z.writestr("word/document.xml", f"<w:d xmlns:w='w'><w:p><w:t>{title}</w:t></w:p><w:p><w:t>{author}</w:t></w:p></w:d>")
        else:
            z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfile full-path="o/p.opf"/></c>')
            z.writestr("o/p.opf", f"<p xmlns:dc='d'>{core}<dc:publisher>{publisher}</dc:publisher><dc:subject>fiction</dc:subject></p>")
            z.writestr("cover.xhtml", "<p>not this page</p>")
            z.writestr("one.xhtml", f"<html><style>p {{}}</style><p>{title}</p> <b>{author}</b></html>")
    return held.getvalue()


@F.pandas_udf(BinaryType())
def _books(ext: pd.Series, title: pd.Series, author: pd.Series, publisher: pd.Series) -> pd.Series:
    return pd.Series([book_bytes(*row) for row in zip(ext, title, author, publisher, strict=True)])


def _ext(key: str = "p_partkey") -> Column:
    return F.expr(f"element_at(array('.epub', '.docx', '.pdf', '.mobi', '.txt'), cast({key} % 5 + 1 as int))")


_BOOK_SQL = """p_name AS title, CASE WHEN p_partkey % 5 <> 4 THEN p_brand END AS authors, CASE WHEN p_partkey % 5 IN (0, 1) THEN p_name || ' ' || p_brand END AS description,
    CASE WHEN p_partkey % 5 IN (0, 3) THEN p_type END AS publisher, CASE WHEN p_partkey % 5 = 3 THEN '1993' END AS published_year, CASE WHEN p_partkey % 5 = 0 THEN 'fiction' ELSE '' END AS subjects"""


@query(f"SELECT p_partkey, {_BOOK_SQL} FROM part WHERE p_partkey % 5 <> 4")
def read_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPUB, DOCX, PDF and MOBI files of all parts, from their bytes."""
    books = table(spark, sf_dir, "part").where("p_partkey % 5 <> 4").select("p_partkey", _ext().alias("ext"), _books(_ext(), "p_name", "p_brand", "p_type").alias("raw"))
    read = books.select("p_partkey", readers.reader_column(F.col("raw"), F.col("ext")).alias("f"))
    return read.select("p_partkey", *(f"f.{c}" for c in ("title", "authors", "description", "publisher", "published_year")), F.coalesce(F.array_join("f.subjects", ";"), F.lit("")).alias("subjects"))


@F.pandas_udf(BinaryType())
def _chinese(texts: pd.Series, damaged: pd.Series) -> pd.Series:
    return pd.Series([x.encode("gb18030") + b"\xff\xff" * d for x, d in zip(texts, damaged, strict=True)])


@query("SELECT p_partkey, '这是一部讲述山海经与历史的长篇小说 ' || p_name AS decoded FROM part")
def decoded_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in GB 18030, every third with bytes that fit no encoding: read strictly, or by the reading with most CJK."""
    text = F.concat(F.lit("这是一部讲述山海经与历史的长篇小说 "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.pandas_udf(readers._decoded, "string")(_chinese(text, F.col("p_partkey") % 3 == 0)).alias("decoded"))


# ---------------------------------------------------------------- a folder of files


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share by path; where that isn't set, a local session's own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = shared.removeprefix("file://").rstrip("/") if shared else tempfile.mkdtemp(prefix="stackwise-")
    return f"{root}/stackwise-files/{name}-{uuid.uuid4().hex}"


def write_files(rows: DataFrame) -> int:
    """Writes files (path, content) from tasks; a repeated task writes the same. Returns how many."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0]


def shelf(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a book for each part, sidecars for every fourth, covers for every sixth, and files that aren't listed or aren't books."""
    root = folder(spark, "shelf")
    at = F.concat(F.lit(f"{root}/s"), F.col("p_partkey") % 7, F.lit("/t"), F.col("p_partkey") % 3)
    stem = F.concat(at, F.lit("/book-"), "p_partkey")
    opf = F.encode(F.concat(F.lit("<p><title>"), "p_type", F.lit("</title><creator>"), "p_brand", F.lit("</creator></p>")), "UTF-8")
    part, nothing = table(spark, sf_dir, "part"), F.lit(b"x")
    rows = part.select(F.concat(stem, F.when(F.col("p_partkey") % 2 == 0, F.upper(_ext())).otherwise(_ext())).alias("path"), _books(_ext(), "p_name", "p_brand", "p_type").alias("content"))
    rows = rows.unionByName(part.where("p_partkey % 4 = 0").select(F.concat(stem, F.lit(".opf")).alias("path"), opf.alias("content")))
    rows = rows.unionByName(part.where("p_partkey % 6 = 0").select(F.concat(stem, F.lit(".jpg")).alias("path"), nothing.alias("content")))
    rows = rows.unionByName(part.where("p_partkey % 9 = 0").select(F.concat(stem, F.lit(".bin")).alias("path"), nothing.alias("content")))
    rows = rows.unionByName(part.where("p_partkey % 10 = 0").select(F.concat(at, F.lit("/.git/x"), "p_partkey", F.lit(".txt")).alias("path"), nothing.alias("content")))
    write_files(rows)
    return root


_AT = "'/s' || p_partkey % 7 || '/t' || p_partkey % 3 || '/book-' || p_partkey"
_KIND = "['.epub', '.docx', '.pdf', '.mobi', '.txt'][p_partkey % 5 + 1]"


@query(f"""SELECT {_AT} || CASE WHEN p_partkey % 2 = 0 THEN upper({_KIND}) ELSE {_KIND} END AS path, 'book-' || p_partkey AS stem, {_KIND} AS ext, CAST(CASE WHEN p_partkey % 5 = 4 THEN length(p_name) + 1 + length(p_brand) ELSE -1 END AS BIGINT) AS size, true AS supported,
      CASE WHEN p_partkey % 4 = 0 THEN {_AT} || '.opf' END AS opf, CASE WHEN p_partkey % 6 = 0 THEN {_AT} || '.jpg' END AS cover FROM part
    UNION ALL SELECT {_AT} || '.opf', 'book-' || p_partkey, '.opf', -1, false, NULL, NULL FROM part WHERE p_partkey % 4 = 0
    UNION ALL SELECT {_AT} || x, 'book-' || p_partkey, x, CAST(1 AS BIGINT), false, NULL, NULL FROM part, (VALUES ('.jpg', 6), ('.bin', 9)) v(x, m) WHERE p_partkey % m = 0""")
def listed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a folder with their stat columns, sidecars and covers; upper-case suffixes count, hidden folders don't.

    A folder of several sidecars has no "only one", so that a part without its own has none; with few parts it may be one.
    """
    root = shelf(spark, sf_dir)
    listing = files.list_files(spark, root)
    side = files.sidecars(listing)
    own = F.col("opf").endswith(F.concat(F.lit("/"), F.col("stem"), F.lit(".opf")))
    short = lambda c: F.replace(c, F.lit(root), F.lit(""))
    size = F.when(F.col("ext").isin(".txt", ".jpg", ".bin"), F.col("size")).otherwise(-1)
    out = listing.join(side, "path", "left").where("is_file and mtime > 0 and size > 0 and filename = substring_index(path, '/', -1)")
    return out.select(short("path").alias("path"), "stem", "ext", size.alias("size"), "supported", short(F.when(own, F.col("opf"))).alias("opf"), short("cover").alias("cover"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 5 <> 4 THEN p_brand END AS authors,
    CASE p_partkey % 5 WHEN 4 THEN p_name || chr(10) || p_brand WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN p_name || ' ' || p_brand END AS description,
    CASE WHEN p_partkey % 4 = 0 THEN p_type END AS side_title, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS side_authors, p_partkey % 11 = 0 AS failed FROM part WHERE p_partkey % 11 <> 0
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, CASE WHEN p_partkey % 4 = 0 THEN p_type END, CASE WHEN p_partkey % 4 = 0 THEN p_brand END, true FROM part WHERE p_partkey % 11 = 0""")
def read_chosen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sidecars of a folder, opened by path; every eleventh path is of a file that isn't there."""
    root = shelf(spark, sf_dir)
    listing = files.list_files(spark, root).where("supported")
    wanted = listing.join(files.sidecars(files.list_files(spark, root)), "path").withColumn("n", F.regexp_extract("stem", r"(\d+)", 1).cast("long"))
    wanted = wanted.select(F.expr("if(n % 11 = 0, concat(path, '.gone'), path)").alias("path"), "ext", F.when(F.col("n") % 4 == 0, F.col("opf")).alias("opf"))
    read = chosen.read_files(wanted).withColumn("p_partkey", F.regexp_extract("path", r"/book-(\d+)\.", 1).cast("long"))
    return read.select("p_partkey", "own.title", "own.authors", "own.description", F.col("side.title").alias("side_title"), F.col("side.authors").alias("side_authors"), F.coalesce(F.col("own.scan_error") != "", F.lit(False)).alias("failed"))
