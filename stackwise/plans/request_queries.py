"""Registered queries of requests and decisions: titles that are chosen, what sources and lookups add, repairs, selections, deletions, backups, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..library import as_json
from ..operators import enrich, facets, merge, operations, paging, search
from ..schema import CATALOG, EXTRACTED, evolve
from ..sources import readers
from . import repair, scan, views
from .file_queries import folder
from .queries import match_sql, query
from .views import DOCS_SQL, PARTS_SQL, table

_DIGITS, _CHARACTERS = "0123456789", "甲乙丙丁戊己庚辛壬癸"


def _title(key: str = "p_partkey", before: str = "长河") -> Column:
    """A Chinese title for each key."""
    return F.concat(F.lit(before), F.translate(F.col(key).cast("string"), _DIGITS, _CHARACTERS))


def _title_sql(key: str = "p_partkey", before: str = "长河") -> str:
    return f"('{before}' || translate(CAST({key} AS VARCHAR), '{_DIGITS}', '{_CHARACTERS}'))"


_T, _U = _title_sql(), _title_sql(before="流云")
_LONG = "这是一部讲述湘西的长篇小说，写了一个人的一生与家族的历史。"


def _case(*values: str | Column, key: str = "p_partkey") -> Column:
    """The key's remainder's value."""
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (F.col(key) % len(values) + 1).cast("int"))


# ---------------------------------------------------------------- titles and authors


@query(f"""SELECT p_partkey, p_partkey % 5 = 0 AS title_line, CASE p_partkey % 5 WHEN 0 THEN {_T} ELSE {_U} END AS title,
    [{_T}, {_T} || '；续', '★' || {_T}, {_T} || '出版社', {_T} || '，' || {_T} || '，' || {_T}][p_partkey % 5 + 1] || ' ' || {_U} || ' ' || p_name AS description FROM part""")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts whose first line may or may not be their title; else the second one is."""
    title = _title()
    line = _case(title, F.concat(title, F.lit("；续")), F.concat(F.lit("★"), title), F.concat(title, F.lit("出版社")), F.concat_ws("，", title, title, title))
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"), F.concat_ws("\n", line, F.lit(""), F.concat(F.lit("## "), _title(before="流云")), "p_name").alias("body"))
    return rows.select("p_partkey", classify.looks_like_title_line(F.col("line")).alias("title_line"), readers.plain_text_fields(F.col("body")).alias("f")).select("p_partkey", "title_line", "f.title", "f.description")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '待识别书名' ELSE {_T} END AS title, ['沈从文', '鲁迅', '未知'][p_partkey % 3 + 1] AS author FROM part""")
def final_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and authors that are good in what was extracted, in the file's name, in the text only, or nowhere."""
    title = _title()
    extracted, guessed = _case(title, "unknown", "", "untitled"), _case("x1", title, "0001", "0002")
    described = _case("", "", F.concat(F.lit("《"), title, F.lit("》作者：沈从文")), "")
    author = classify.final_author(_case("作者：沈从文", "administrator", "cnki"), _case("鲁迅", "鲁迅", "user"))
    return table(spark, sf_dir, "part").select("p_partkey", classify.final_title(extracted, guessed, described, F.lit("")).alias("title"), author.alias("author"))


# ---------------------------------------------------------------- what sources and lookups add


@query(f"""SELECT p_partkey, [{_U}, {_T}, 'unknown'][p_partkey % 3 + 1] AS title, CASE WHEN p_partkey % 2 = 0 THEN '沈从文' ELSE p_brand END AS authors, CASE WHEN p_partkey % 5 = 0 THEN '短' ELSE '{_LONG}' END AS description,
    CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS publisher, 'kept' AS scan_error FROM part""")
def extraction_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file says, joined by its sidecar: good titles and authors, the better description, other values if there are some."""

    def fields(**known: Column) -> Column:
        return F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EXTRACTED.fields))

    old = fields(title=_case(_title(), _title(), ""), authors=F.col("p_brand"), description=F.lit("短"), publisher=F.col("p_type"), scan_error=F.lit("kept"))
    new = fields(title=_case(_title(before="流云"), "unknown", "unknown"), authors=_case("作者：沈从文", "administrator"), description=F.expr(f"if(p_partkey % 5 = 0, '', '{_LONG}')"), publisher=F.expr("if(p_partkey % 4 = 0, '', p_brand)"))
    merged = table(spark, sf_dir, "part").select("p_partkey", merge.merge_extracted(old, new).alias("m"))
    return merged.select("p_partkey", *(f"m.{c}" for c in ("title", "authors", "description", "publisher", "scan_error")))


@query(f"""SELECT id, CASE WHEN id % 3 = 0 THEN {_title_sql('id')} ELSE '' END AS title, CASE WHEN id % 3 = 0 THEN '8.1' ELSE '' END AS rating, CASE id % 3 WHEN 0 THEN '已获取' ELSE '未找到' END AS status,
    CASE WHEN id % 3 = 0 THEN '{enrich.SOURCE}' ELSE '' END AS source FROM ({PARTS_SQL})""")
def lookup_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of Chinese books: of the same title, of a title in another script, which is wrong, and of none."""
    books = views.parts(spark, sf_dir).select("id", _title("id").alias("title"), "authors", F.lit("").alias("description"), "filename")
    matched = books.select("id", _case(_title("id"), "The Long River", "", key="id").alias("title"), _case("https://x/1/", "https://x/2/", "", key="id").alias("douban_url"), _case("8.1", "9.9", "", key="id").alias("douban_rating"), _case("已获取", "已获取", "未找到", key="id").alias("douban_rating_status"), F.lit("").alias("description"))
    out = enrich.lookup_result(books, matched)
    return out.select("id", "title", F.col("douban_rating").alias("rating"), F.col("douban_rating_status").alias("status"), F.col("remote_source").alias("source"))


_BAD = "id % 3 = 1"


@query(f"""SELECT id, CASE WHEN {_BAD} THEN {_title_sql('id')} END AS new_title, CASE WHEN {_BAD} THEN '沈从文' END AS new_authors, CASE WHEN {_BAD} THEN {_title_sql('id')} ELSE title END AS title,
    CASE WHEN {_BAD} THEN '待查询' ELSE '' END AS status FROM ({PARTS_SQL}) WHERE status = 'active'""")
def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a number for a title and a program for an author get what their files say; the others keep theirs."""
    rows = views.parts(spark, sf_dir).where("status = 'active'")
    rows = rows.withColumns({"title": F.expr(f"if({_BAD}, '0001', title)"), "authors": F.expr(f"if({_BAD}, 'administrator', '鲁迅')"), "douban_rating": F.lit("")})
    said = rows.select("path", _title("id").alias("title"), F.lit("沈从文").alias("authors"), *(F.lit("").alias(c) for c in ("description", "language", "publisher", "published_year", "isbn", "cover_path")), F.expr("cast(array() as array<string>)").alias("tags"))
    preview = repair.repair_preview(rows, said)
    after = repair.repair_apply(rows, preview, 5.0).select("id", "title", F.col("douban_rating_status").alias("status"))
    return preview.select("id", F.try_element_at("changes", F.lit("title")).alias("new_title"), F.try_element_at("changes", F.lit("authors")).alias("new_authors")).join(after, "id")


# ---------------------------------------------------------------- requests


@query(f"""SELECT id FROM ({PARTS_SQL}) p WHERE {match_sql(['e'])} AND id NOT IN (2, 11)""")
def resolved_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that match, less some, as a request names them: numbers as text, repeats, what isn't a number, and unknown keys."""
    request = {"allMatching": True, "filters": {"query": " E ", "status": "all", "format": "TXT", "nonsense": 1, "tags": None}, "excludeIds": ["2", 11, "x", "2"], "limit": None}
    return search.resolve_selection(views.parts(spark, sf_dir), views.part_tags(spark, sf_dir), request)


@query(f"""SELECT CAST(n - 1 AS INTEGER) AS position, n AS book_id, path, size, title, 'planned' AS status, (SELECT count(*) FROM ({PARTS_SQL}) WHERE id BETWEEN 1 AND 40) AS item_count, '安全删除 40 本书' AS phrase FROM (SELECT unnest(range(1, 41)) AS n) JOIN ({PARTS_SQL}) ON id = n""")
def frozen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's selection of forty books, repeats included, frozen against the catalog and the files as they are."""
    rows = views.parts(spark, sf_dir).withColumn("status", F.lit("active"))
    listing = rows.select("path", "size", "mtime", F.lit(True).alias("is_file"))
    batch, items = operations.freeze(rows, [*range(1, 41), 3, 1], listing, 1.0)
    return items.select("position", "book_id", "path", "size", "title", "status", F.lit(batch["item_count"]).cast("long").alias("item_count"), F.lit(batch["confirm_phrase"]).alias("phrase"))


@query(f"""SELECT row_number() OVER (ORDER BY lower(title), id DESC) - 1 AS pos, id, title FROM ({PARTS_SQL}) QUALIFY pos >= 60 AND pos < 120""")
def page_of_a_kept_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of all parts by title, from the kept order's files."""
    rows, root = views.parts(spark, sf_dir), folder(spark, "order")
    paging.build(paging.ordered(rows, None, search.SearchSpec(status="all", sort="title", order="asc")), root, 50)
    return paging.page_rows(rows, root, 2, 60).select("pos", "id", "title")


@query(f"""SELECT 'newest' AS kind, id, title || ' 2' AS title FROM ({PARTS_SQL}) UNION ALL SELECT 'backup', id, title FROM ({PARTS_SQL})""")
def snapshots_and_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the parts, and a day's backup, which the second copy of the day doesn't change."""
    root, rows = folder(spark, "snapshots"), views.parts(spark, sf_dir).select(CATALOG.names)
    later = rows.withColumn("title", F.concat("title", F.lit(" 2")))
    scan.publish(rows, root, 1)
    newest = scan.publish(later, root, 2)
    scan.daily_backup(rows, f"{root}/backups", "20260101")
    backup = scan.daily_backup(later, f"{root}/backups", "20260101")
    read = lambda path, kind: spark.read.schema(CATALOG).parquet(path).select(F.lit(kind).alias("kind"), "id", "title")
    return read(newest, "newest").unionByName(read(backup, "backup"))


@query(f"""SELECT '{{"total": ' || sum(c) || ', "formats": [' || string_agg('{{"ext": "' || ext || '", "count": ' || c || '}}', ', ' ORDER BY c DESC, ext) || ']}}' AS answer
    FROM (SELECT ext, count(*) AS c FROM ({DOCS_SQL}) WHERE status = 'active' GROUP BY ext)""")
def answers_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's answer as text: the number of active documents, and their formats."""
    rows = evolve(views.docs(spark, sf_dir))
    answer = as_json({"total": rows.where("status = 'active'").count(), "formats": facets.format_facet(rows)})
    return spark.createDataFrame([(answer,)], "answer string")
