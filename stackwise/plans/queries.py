"""Registered queries of the catalog engine and their DuckDB SQL. Each runs over whole tables; a page or a top-k is the feature itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, tags
from ..functions import text as t
from ..operators import copies, enrich, facets, jobs, merge, operations, postings, search
from ..operators.search import SearchSpec
from . import repair, views
from .views import DOCS_SQL, JOB_LOG_SQL, LOOKUPS_SQL, PART_TAGS_SQL, PARTS_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def values_sql(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({names})"


# ---------------------------------------------------------------- search

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def has_sql(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({LOW.format(column)}, {quoted(term.lower())})" for term in terms) + ")"


def rank_sql(terms: list[str], fields: dict[str, str]) -> str:
    cases = [f"WHEN {fields[f]} IN ({', '.join(map(quoted, terms))}) THEN {score}" if whole else f"WHEN {has_sql(fields[f], terms)} THEN {score}" for f, whole, score in search.RANKS if f in fields]
    return f"CASE {' '.join(cases)} ELSE 0 END"


_PART_FIELDS = {"title": "title", "authors": "authors", "filename": "filename", "publisher": "publisher"}


def match_sql(terms: list[str]) -> str:
    return " AND ".join("(" + " OR ".join(has_sql(f, [term]) for f in _PART_FIELDS.values()) + ")" for term in terms)


@query(f"""SELECT id, title, authors, publisher, {rank_sql(['cold'], _PART_FIELDS)} AS rank FROM ({PARTS_SQL}) WHERE status = 'active' AND {match_sql(['cold'])}
    ORDER BY rank DESC, length(title), updated_at DESC, id DESC LIMIT 50""")
def search_ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(views.parts(spark, sf_dir), None, SearchSpec("Cold")).select("id", "title", "authors", "publisher", "rank")


@query(f"""SELECT id, title, size, {rank_sql(['cold', 'widget'], _PART_FIELDS)} AS rank FROM ({PARTS_SQL}) WHERE {match_sql(['cold', 'widget'])}
    ORDER BY rank DESC, length(title), size, id DESC LIMIT 20 OFFSET 20""")
def search_multiword_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(views.parts(spark, sf_dir), None, SearchSpec("cold widget", status="all", sort="size", order="asc"), page=2, page_size=20).select("id", "title", "size", "rank")


@query(f"SELECT id, title FROM ({PARTS_SQL}) WHERE {match_sql(['old', 'wid', 'et'])}")
def search_by_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of words, one of them too short to narrow the search, by the postings of all parts."""
    parts = views.parts(spark, sf_dir)
    found = postings.narrowed(parts, postings.build(parts), "old WID et")
    return search.filtered(found, None, SearchSpec("old WID et", status="all")).select("id", "title")


@query(f"SELECT count(*) AS matches FROM ({PARTS_SQL}) WHERE status = 'active' AND {match_sql(['cold'])}")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(views.parts(spark, sf_dir), None, SearchSpec("cold")).agg(F.count("*").alias("matches"))


@query(f"SELECT id, {rank_sql(['the_'], {'title': 'title', 'authors': 'authors', 'filename': 'filename'})} AS rank FROM ({DOCS_SQL}) WHERE ({has_sql('title', ['%'])} OR {has_sql('authors', ['%'])} OR {has_sql('filename', ['%'])})")
def search_literal_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """% and _ are characters like others."""
    return search.filtered(views.evolve(views.docs(spark, sf_dir)), None, SearchSpec("%", status="all")).select("id", search.rank("the_", {f: F.col(f) for f in search.SEARCHED}).alias("rank"))


_BOOKS = [(1, "呐喊", "鲁迅", "nahan.txt"), (2, "鲁迅传", "张作者", "luxun-biography.txt"), (3, "100% Python", "Tester", "percent.txt"), (4, "A_B", "Tester", "underscore.txt"), (5, "ACB", "Tester", "wildcard-control.txt"), (6, "吶喊", "魯迅", "old.txt"), (7, "Ne Han", "Lu Xun", "latin.txt")]
_LU_XUN, _NE_HAN = ["鲁迅", "魯迅", "Lu Xun"], ["呐喊", "吶喊", "Ne Han"]
_VARIANT_FIELDS = {"title": "title", "authors": "authors", "filename": "filename"}


def _any_field(terms: list[str]) -> str:
    return "(" + " OR ".join(has_sql(f, terms) for f in _VARIANT_FIELDS.values()) + ")"


#: Parts as books of that author or title, in several spellings.
_SPELT = "p_partkey + 100 AS id, CASE p_partkey % 4 WHEN 0 THEN '呐喊 ' || p_name WHEN 1 THEN '吶喊' ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'Lu Xun' WHEN 1 THEN '魯迅' ELSE p_brand END AS authors, CASE p_partkey % 5 WHEN 0 THEN 'ne han ' ELSE '' END || p_partkey || '.txt' AS filename"


@query(f"""SELECT id, title, {rank_sql([*_LU_XUN, *_NE_HAN], _VARIANT_FIELDS)} AS rank FROM (SELECT * FROM {values_sql(_BOOKS, 'id, title, authors, filename')} UNION ALL SELECT {_SPELT} FROM part)
    WHERE {_any_field(_LU_XUN)} AND {_any_field(_NE_HAN)}""")
def search_variant_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = table(spark, sf_dir, "part").selectExpr(*_SPELT.split(", "))
    books = views.evolve(values(spark, _BOOKS, "id long, title string, authors string, filename string").unionByName(spelt))
    return search.filtered(books, None, SearchSpec("鲁迅 呐喊")).select("id", "title", search.rank("鲁迅 呐喊", {f: F.col(f) for f in search.SEARCHED}).alias("rank"))


_RATINGS = [(-1, ""), (-2, "9.1x"), (-3, "abc"), (-4, "7.5"), (-5, "10")]


@query(f"""WITH r AS (SELECT id, CAST(rating AS VARCHAR) AS rating FROM ({PARTS_SQL}) UNION ALL SELECT id, rating FROM {values_sql(_RATINGS, 'id, rating')}),
    n AS (SELECT id, CASE WHEN rating <> '' THEN coalesce(TRY_CAST(nullif(regexp_extract(rating, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE), 0.0) END AS value FROM r)
    SELECT id, value, row_number() OVER (ORDER BY value ASC NULLS FIRST, id DESC) AS place FROM n QUALIFY place <= 200""")
def sort_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.parts(spark, sf_dir).select("id", "douban_rating").unionByName(values(spark, _RATINGS, "id long, douban_rating string"))
    top = views.evolve(rows).orderBy(*search.ordering(SearchSpec(sort="douban", order="asc"))).limit(200)
    ordered = top.select("id", t.numeric_text(F.col("douban_rating")).alias("value"))
    return ordered.withColumn("place", F.row_number().over(search_window()).cast("long"))


def search_window():
    from pyspark.sql.window import Window

    return Window.orderBy(F.col("value").asc_nulls_first(), F.col("id").desc())  # over a page, not a table


@query(f"SELECT id, ext, status FROM ({DOCS_SQL}) WHERE status = 'quarantined' AND ext = '.de'")
def filter_status_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(views.docs(spark, sf_dir), None, SearchSpec(status="quarantined", format=" DE ")).select("id", "ext", "status")


@query(f"""SELECT id, title FROM ({PARTS_SQL}) b WHERE status = 'active' AND EXISTS (SELECT 1 FROM ({PART_TAGS_SQL}) t WHERE t.book_id = b.id AND tag = 'cold')
    AND EXISTS (SELECT 1 FROM ({PART_TAGS_SQL}) t WHERE t.book_id = b.id AND tag = 'PROMO')""")
def tags_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(views.parts(spark, sf_dir), views.part_tags(spark, sf_dir), SearchSpec(tags=("cold", "PROMO"))).select("id", "title")


@query(f"SELECT id FROM ({PARTS_SQL}) WHERE status = 'active' AND id NOT IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 45) ORDER BY id LIMIT 100")
def select_ids_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    exclude = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("id"))
    return search.select_ids(views.parts(spark, sf_dir), None, SearchSpec(), exclude, limit=100)


_ASKED = [7, 3, 7, "x", 11, -1, 999999999, 3]


@query(f"SELECT CAST(v.pos AS INTEGER) AS pos, b.id, b.title FROM {values_sql([(0, 7), (1, 3), (2, 7), (3, 11), (4, 999999999), (5, 3)], 'pos, wanted')} JOIN ({PARTS_SQL}) b ON b.id = v.wanted")
def ids_in_request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.in_request_order(views.parts(spark, sf_dir), _ASKED).select("pos", "id", "title")


@query(f"SELECT book_id, list_aggregate(list_sort(list(DISTINCT tag)), 'string_agg', ',') AS tags FROM ({PART_TAGS_SQL}) GROUP BY book_id")
def tags_per_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tags_of_books(views.part_tags(spark, sf_dir)).select("book_id", F.array_join("tags", ",").alias("tags"))


# ---------------------------------------------------------------- facets


@query(f"SELECT tag, count(*) AS count FROM ({PART_TAGS_SQL}) t JOIN ({PARTS_SQL}) b ON b.id = t.book_id WHERE status = 'active' GROUP BY tag")
def facet_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.tag_facet(views.parts(spark, sf_dir), views.part_tags(spark, sf_dir))


@query(f"SELECT ext, count(*) AS count FROM ({DOCS_SQL}) WHERE status = 'active' GROUP BY ext")
def facet_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.format_facet(views.docs(spark, sf_dir))


@query(f"SELECT status, count(*) AS count FROM ({DOCS_SQL}) GROUP BY status")
def stats_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.status_histogram(views.docs(spark, sf_dir))


@query(f"SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM ({DOCS_SQL}) WHERE status = 'active'")
def stats_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.active_size(views.docs(spark, sf_dir))


@query(f"""SELECT count(*) AS total, count_if(rating <> '') AS rated, count_if(rating = '' AND rating_status IN ('', '待查询')) AS pending,
    count_if(rating = '' AND rating_status IN ('查询失败', '豆瓣访问受限')) AS failed, count_if(rating = '' AND rating_status = '豆瓣访问受限') AS access_limited,
    count_if(rating = '' AND rating_status IN ('未找到', '无评分')) AS not_found_or_unrated,
    count_if(rating = '' AND (rating_status IN ('', '待查询', '缺少书名') OR (rating_status IN ('未找到', '无评分') AND version < 2) OR rating_status = '查询失败')) AS due
    FROM ({DOCS_SQL}) WHERE status = 'active'""")
def stats_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.lookup_stats(views.docs(spark, sf_dir).withColumn("last_remote_lookup_at", F.lit(0.0)), 1e9)


@query(f"SELECT count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size, (SELECT string_agg(title, '|' ORDER BY id) FROM (SELECT title, id FROM ({PARTS_SQL}) WHERE status = 'active' ORDER BY id LIMIT 12)) AS sample FROM ({PARTS_SQL}) WHERE status = 'active'")
def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.filtered(views.parts(spark, sf_dir), None, SearchSpec()).select(F.col("id").alias("pos"), "size", "title")
    return facets.selection_totals(rows).select("count", "total_size", F.array_join("sample", "|").alias("sample"))


# ---------------------------------------------------------------- text


_MARKUP_SQL = "regexp_replace(regexp_replace({}, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, {_MARKUP_SQL.format('html')} AS plain FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.strip_markup(F.col("html")).alias("plain"))


_CLEAN_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'gi'),
    '(?:本书由|更多(?:免费)?电子书|关注公众号|下载(?:地址|链接)|手机阅读|返回目录|版权归原作者所有|仅供学习交流).*$', ' ', 'gi'), '\\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, rtrim(substr({_CLEAN_SQL.format('text')}, 1, 1400)) AS description FROM documents")
def clean_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_description(F.col("text")).alias("description"))


@query(f"""SELECT doc_id, CASE WHEN length(c) > 150 THEN rtrim(substr(c, 1, 149)) || '…' ELSE c END AS short FROM (SELECT doc_id, rtrim(substr({_CLEAN_SQL.format('text')}, 1, 151)) AS c FROM documents)""")
def short_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.short_description(F.col("text")).alias("short"))


_BYTES = "l_extendedprice * l_quantity * l_quantity * 1000"


def _bytes_sql(x: str) -> str:
    steps = " ".join(f"WHEN {x} < {1024.0**(p + 1)} THEN format('{{:.1f}} {u}', {x} / {1024.0**p})" for p, u in ((1, "KB"), (2, "MB"), (3, "GB")))
    return f"CASE WHEN {x} < 1024 THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) || ' B' {steps} ELSE format('{{:.1f}} TB', {x} / {1024.0**4}) END"


@query(f"SELECT l_orderkey, l_linenumber, {_bytes_sql('CAST(floor(' + _BYTES + ') AS BIGINT)')} AS label FROM lineitem")
def size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.format_bytes(F.floor(F.expr(_BYTES))).alias("label"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' - (' || p_brand || '): ' || p_type), '[\\s《》“”\"'':：·.\\-—–_()\\[\\]（）【】]', '', 'g') AS norm FROM part")
def normalize_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.normalize_match_text(F.expr("p_name || ' - (' || p_brand || '): ' || p_type")).alias("norm"))


@query("SELECT page_id, length(regexp_replace(url, '[^0-9Xx]', '', 'g')) IN (10, 13) OR length(regexp_replace(html, '[^0-9Xx]', '', 'g')) IN (10, 13) AS isbn FROM pages")
def isbn_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", (t.isbn_shape(F.col("url")) | t.isbn_shape(F.col("html"))).alias("isbn"))


@query(f"""SELECT doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE least(length(c), 240) + CASE WHEN regexp_matches(c, '[一-鿿]') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(c, '[。！？.!?]') THEN 10 ELSE 0 END
    - CASE WHEN length(c) < 20 THEN 25 ELSE 0 END END AS INTEGER) AS quality FROM (SELECT doc_id, rtrim(substr({_CLEAN_SQL.format('text')}, 1, 1400)) AS c FROM documents)""")
def description_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.description_quality(t.clean_description(F.col("text"))).alias("quality"))


# ---------------------------------------------------------------- tags


def _keyword_sql(c: str, words: tuple[str, ...]) -> str:
    import re

    ascii_ = [k for k in words if re.fullmatch(r"[a-z0-9 +#.-]+", k)]
    other = [k for k in words if k not in ascii_ and k not in tags.BLANKED]
    hits = [f"contains(regexp_replace({c}, '{tags.BLANKED[k]}', ' ', 'g'), '{k}')" for k in words if k in tags.BLANKED]
    if ascii_:
        hits.append(f"regexp_matches({c}, '(^|[^a-z0-9])({'|'.join(re.escape(k) for k in ascii_)})([^a-z0-9]|$)')")
    hits += [f"contains({c}, {quoted(k)})" for k in other]
    return "(" + " OR ".join(hits) + ")"


def _infer_sql(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_keyword_sql(c, words)} THEN '{label}' END" for label, words in tags.KEYWORDS.items()) + "], lambda x: x IS NOT NULL)[1:10]"


_TAGGED = [(-1, "清除 WinXP 任务栏图标历史记录"), (-2, "中国近代历史"), (-3, "Python for science fiction art"), (-4, "出版史记录与史记"), (-5, "clawed startled"), (-6, "The Law of Travel and children's literature")]


@query(f"SELECT id, array_to_string({_infer_sql('lower(s)')}, ',') AS tags FROM (SELECT doc_id AS id, text AS s FROM documents UNION ALL SELECT id, s FROM {values_sql(_TAGGED, 'id, s')})")
def tag_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("s")).unionByName(values(spark, _TAGGED, "id long, s string"))
    return rows.select("id", F.array_join(tags.infer_tags(F.col("s")), ",").alias("tags"))


_NORMALIZED = [("Science Fiction", "小说"), (" fiction. ", "小说"), ("Computer  Books", "计算机"), ("中国历史", "历史"), ("未分类", ""), ("nonsense", ""), ("", ""), ("Mythology", "神话民俗"), ("/social/", "社科"), ("科幻", "科幻")]


def _normalize_sql(c: str) -> str:
    s = f"trim(regexp_replace(trim({c}), '\\s+', ' ', 'g'), '.,;:，。；：/\\|')"
    return "CASE " + " ".join(f"WHEN contains(lower({s}), '{k}') THEN '{v}'" for k, v in tags.SUBJECTS.items()) + " " + " ".join(f"WHEN contains({s}, '{k}') THEN '{k}'" for k in tags.KEYWORDS) + " ELSE '' END"


@query(f"SELECT tag, {_normalize_sql('tag')} AS label, expected FROM (SELECT tag, expected FROM {values_sql(_NORMALIZED, 'tag, expected')} UNION ALL SELECT DISTINCT p_type, '' FROM part) WHERE {_normalize_sql('tag')} = expected OR expected = ''")
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, _NORMALIZED, "tag string, expected string").unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("tag"), F.lit("").alias("expected")).distinct())
    return rows.select("tag", tags.normalize_tag(F.col("tag")).alias("label"), "expected")


_MERGED = [(1, "小说,社科,fiction", "历史,小说", "小说,历史"), (2, "未分类,x", "", ""), (3, "历史,科幻,推理,玄幻", "经济,金融,管理", "历史,科幻,推理,玄幻,经济,金融"), (4, "social", "travel,旅行", "社科,旅行")]


#: Two sets of tags of each part, one with an unknown name.
_TWO_SETS = "p_partkey + 100 AS id; CASE p_partkey % 3 WHEN 0 THEN '小说' WHEN 1 THEN '历史' ELSE '社科' END AS a; CASE p_size % 3 WHEN 0 THEN '历史' WHEN 1 THEN '小说' ELSE 'x' END AS b"


@query(f"""SELECT id, expected AS tags FROM {values_sql(_MERGED, 'id, a, b, expected')}
    UNION ALL SELECT id, CASE WHEN a = '社科' AND b = '小说' THEN b WHEN b = 'x' OR a = b THEN a ELSE a || ',' || b END FROM (SELECT {_TWO_SETS.replace(';', ',')} FROM part)""")
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, _MERGED, "id long, a string, b string, expected string").drop("expected").unionByName(table(spark, sf_dir, "part").selectExpr(*_TWO_SETS.split("; ")))
    return rows.select("id", F.array_join(tags.merge_tags(F.split("a", ","), F.split("b", ",")), ",").alias("tags"))


_REFINED = [
    (1, "钢穴", "艾萨克·阿西莫夫", "这是一部描写未来历史的科幻小说，人物需要面对工作压力。", "小说,科幻,历史,职场", "小说,科幻"),
    (2, "呐喊", "鲁迅", "", "历史", "小说,文学"),
    (3, "父母课堂", "", "一本关于亲子沟通和家庭教育的育儿指南。", "育儿,旅行", "育儿,旅行"),
    (4, "某人自传", "", "", "传记,管理", "传记,管理"),
]


@query(f"""SELECT id, expected AS tags FROM {values_sql(_REFINED, 'id, title, authors, description, had, expected')}
    UNION ALL SELECT p_partkey + 100, CASE p_partkey % 3 WHEN 0 THEN '小说' WHEN 1 THEN '旅行' ELSE '传记,旅行' END FROM part""")
def tag_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, too: history without evidence in a novel's title, a biography without and with evidence."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey + 100 AS id", "CASE p_partkey % 3 WHEN 2 THEN p_name || '自传' ELSE p_name END AS title", "p_brand AS authors", "'' AS description", "CASE p_partkey % 3 WHEN 0 THEN '小说,历史' ELSE '传记,旅行' END AS had")
    rows = values(spark, _REFINED, "id long, title string, authors string, description string, had string, expected string").drop("expected").unionByName(parts)
    return rows.select("id", F.array_join(tags.refine_tags(F.col("title"), F.col("authors"), F.col("description"), F.split("had", ",")), ",").alias("tags"))


# ---------------------------------------------------------------- titles and authors

_TITLES = [("1988", False), ("2666", False), ("002-62", True), ("0001", True), ("第一章 破晓", True), ("第12节：开始", True), ("Chapter 3 Arrival", True), ("欢迎光临翠微居", True), ("最新章节全文阅读", True), ("呐喊", False), ("The Old Man and the Sea", False), ("http://x.y", True), ("cover.pdf", True), ("ABCDEF", True), ("WinXP", False), ("XPWin", True), ("12-34-5", True), ("a b", True), ("目 录", True), ("???", True), ("Ã©Ã¨ text", True), ("wei zhi", True), ("img.jpg", True), ("", True), ("###", True), ("12345", True), ("don'", True), ("活着", False), ("1984 ", False)]
_AUTHORS = [("鲁迅", False), ("37signals", False), ("unknown", True), ("佚名", True), ("lu xun", False), ("li jia", True), ("John Smith", False), ("v1.2", True), ("user_1", True), ("by John", True), ("Notes", True), ("ab", True), ("", True), ("--", True), ("www.x.com", True), ("R2D2", True), ("莫言2", False), ("[余华]", False), ("?", True)]

_NO_CJK = "NOT regexp_matches(s, '[一-鿿]')"
_NAME_SQL = """regexp_matches(lower(s), '\\b(wei zhi|wei biao ti|cnki|pic2pdf|multing)\\b') OR regexp_matches(s, '[A-Z]{2,}[a-z]') OR regexp_full_match(s, '0\\d{2,}')
    OR (regexp_matches(lower(s), '\\b(name|date|line|read)\\b') AND regexp_matches(s, '\\d{2,}')) OR length(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) <= 3
    OR (regexp_full_match(s, '[A-Z0-9!@#$%^&*()_'' .:;-]+') AND length(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) >= 12)"""


@query(f"SELECT title, {_NAME_SQL} AS bad FROM (SELECT DISTINCT title, title AS s FROM (SELECT p_name AS title FROM part UNION ALL SELECT c_name FROM customer)) UNION ALL SELECT title, bad FROM {values_sql(_TITLES, 'title, bad')}")
def suspicious_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"))).distinct()
    return names.unionByName(values(spark, [(x,) for x, _ in _TITLES], "title string")).select("title", classify.suspicious_title(F.col("title")).alias("bad"))


@query(f"SELECT author, regexp_matches(author, '[0-9]') AND regexp_matches(author, '[A-Za-z]') AS bad FROM (SELECT DISTINCT c_name AS author FROM customer UNION ALL SELECT DISTINCT p_brand FROM part) UNION ALL SELECT author, bad FROM {values_sql(_AUTHORS, 'author, bad')}")
def suspicious_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("author")).distinct().unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("author")).distinct())
    return names.unionByName(values(spark, [(x,) for x, _ in _AUTHORS], "author string")).select("author", classify.suspicious_author(F.col("author")).alias("bad"))


_FILENAMES = [("《活着》作者：余华.txt", "活着", "余华"), ("lu xun - ne han.txt", "呐喊", "鲁迅"), ("ne_han.txt", "呐喊", ""), ("三体（刘慈欣）.epub", "三体", "刘慈欣"), ("Deep Work - Newport, Cal.pdf", "Newport, Cal", "Deep Work"), ("[图书]边城 v1.2.mobi", "边城", ""), ("围城-未知.txt", "围城", ""), ("part-7.txt", "7", "part")]


@query(f"""SELECT filename, title, author FROM {values_sql(_FILENAMES, 'filename, title, author')}
    UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN '《' || p_name || ' ' || p_partkey || '》作者：余华.txt' ELSE 'part-' || p_partkey || '.txt' END, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END, CASE WHEN p_partkey % 2 = 0 THEN '余华' ELSE 'part' END FROM part WHERE p_partkey <> 7""")
def guess_title_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of all parts but the one that is among the values."""
    g = classify.guess_from_filename(F.col("filename"))
    parts = table(spark, sf_dir, "part").where("p_partkey <> 7").select(F.expr("CASE WHEN p_partkey % 2 = 0 THEN '《' || p_name || ' ' || p_partkey || '》作者：余华.txt' ELSE 'part-' || p_partkey || '.txt' END").alias("filename"))
    return values(spark, [(f,) for f, _, _ in _FILENAMES], "filename string").unionByName(parts).select("filename", g["title"].alias("title"), g["author"].alias("author"))


# ---------------------------------------------------------------- merge, copies, repair


@query("""SELECT coalesce(c.path, s.path) AS path, coalesce(s.name, c.name) AS title, coalesce(s.phone, c.phone) AS isbn, CASE WHEN c.path IS NULL THEN 1 ELSE 0 END AS is_new, CAST(CASE WHEN s.path IS NULL THEN 1 ELSE 5 END AS DOUBLE) AS updated_at
    FROM (SELECT '/c/' || c_custkey || '.txt' AS path, 'Name of ' || c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS phone FROM customer) c
    FULL JOIN (SELECT '/c/' || (s_suppkey * 40) || '.txt' AS path, 'Supplier of goods ' || chr(65 + CAST(s_suppkey % 26 AS INTEGER)) || 'er' AS name, nullif(CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'N' || s_nationkey END, '') AS phone FROM supplier) s ON c.path = s.path""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("'/c/' || c_custkey || '.txt'").alias("path"), F.expr("'Name of ' || c_mktsegment").alias("title"), F.col("c_nationkey").cast("string").alias("isbn"), F.lit(1.0).alias("updated_at"))
    new = table(spark, sf_dir, "supplier").select(F.expr("'/c/' || (s_suppkey * 40) || '.txt'").alias("path"), F.lit(1).alias("size"), F.lit(1.0).alias("mtime"), F.expr("'Supplier of goods ' || chr(65 + s_suppkey % 26) || 'er'").alias("title"), F.expr("if(s_suppkey % 2 = 0, '', 'N' || s_nationkey)").alias("isbn"))
    out = merge.upsert(old, new, now=5.0)
    top = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("top"))
    return out.join(F.broadcast(top)).select("path", "title", F.when(F.col("isbn") == "", F.lit(None)).otherwise(F.col("isbn")).alias("isbn"), F.when(F.col("id") > F.col("top"), 1).otherwise(0).alias("is_new"), "updated_at")


@query("""WITH old AS (SELECT o_orderkey AS id, '/o/' || o_orderkey || '.txt' AS path FROM orders WHERE o_orderkey % 3 = 0),
    new AS (SELECT '/o/' || o_orderkey || '.txt' AS path, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)
    SELECT path, size, CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY path) AS BIGINT) AS id FROM new WHERE path NOT IN (SELECT path FROM old)
    UNION ALL SELECT path, size, id FROM new JOIN old USING (path)""")
def upsert_many_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan of most of a library: two thirds of the orders are new files, numbered by path."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("'/o/' || o_orderkey || '.txt'").alias("path"), F.floor("o_totalprice").alias("size"), F.lit(1.0).alias("mtime"))
    return merge.upsert(rows.where("id % 3 = 0").select("id", "path"), rows.drop("id"), now=5.0).select("path", "size", "id")


@query("""WITH part_rows AS (SELECT 'part-' || p_partkey || '.txt' AS filename, CAST(p_size AS BIGINT) AS size, p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 9.0 ELSE 0.0 END AS mtime, CASE WHEN p_partkey % 5 = 0 THEN 'quarantined' ELSE 'active' END AS status FROM part)
    SELECT id, CASE WHEN id % 2 = 0 THEN size + 1 ELSE size END AS size, CAST(CASE WHEN id % 2 = 0 THEN 9 ELSE 3 END AS DOUBLE) AS mtime, 'active' AS status, CAST(CASE WHEN status = 'quarantined' THEN 7 ELSE 0 END AS DOUBLE) AS updated_at FROM part_rows WHERE id % 3 = 0
    UNION ALL SELECT id, size, CAST(0 AS DOUBLE), status, CAST(0 AS DOUBLE) FROM part_rows WHERE id % 3 <> 0""")
def touch_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.evolve(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("'/p/' || p_partkey").alias("path"), F.col("p_size").cast("long").alias("size"), F.expr("if(p_partkey % 5 = 0, 'quarantined', 'active')").alias("status")))
    seen = rows.where("id % 3 = 0").select("path", F.expr("if(id % 2 = 0, size + 1, size)").alias("size"), F.expr("if(id % 2 = 0, 9.0D, 3.0D)").alias("mtime"))
    return merge.touch(rows, seen, 7.0).select("id", "size", "mtime", "status", "updated_at")


_COPIES = [(-1, "amb", "8.1", "u1", "active"), (-2, "amb", "8.2", "u1", "active"), (-3, "amb", "", "", "active"), (-4, "one", "9.1", "u9", "active"), (-5, "one", "", "", "active"), (-6, "one", "", "", "quarantined")]


@query(f"""WITH rows AS (SELECT id, md5(description) AS filename, size, rating, CASE WHEN rating = '' THEN '' ELSE 'u' || rating END AS url, status FROM ({DOCS_SQL})
      UNION ALL SELECT id, filename, 0, rating, url, status FROM {values_sql(_COPIES, 'id, filename, rating, url, status')}),
    src AS (SELECT filename, size, arg_min(rating, id) AS rating, arg_min(url, id) AS url FROM rows WHERE status = 'active' AND rating <> '' GROUP BY filename, size HAVING min((rating, url)) = max((rating, url)))
    SELECT r.id, coalesce(CASE WHEN r.status = 'active' AND r.rating = '' THEN s.rating END, r.rating) AS rating, coalesce(CASE WHEN r.status = 'active' AND r.rating = '' THEN s.url END, r.url) AS url,
           s.rating IS NOT NULL AND r.status = 'active' AND r.rating = '' AS changed
    FROM rows r LEFT JOIN src s USING (filename, size)""")
def copy_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.docs(spark, sf_dir).select("id", F.md5("description").alias("filename"), "size", "douban_rating", F.when(F.col("douban_rating") == "", "").otherwise(F.concat(F.lit("u"), F.col("douban_rating"))).alias("douban_url"), "status")
    more = values(spark, _COPIES, "id long, filename string, douban_rating string, douban_url string, status string")
    rows = views.evolve(d.unionByName(more, allowMissingColumns=True))
    return copies.propagate(rows, 5.0).select("id", F.col("douban_rating").alias("rating"), F.col("douban_url").alias("url"), "changed")


@query("""SELECT p_partkey AS id, CASE WHEN n = 1 THEN name ELSE stem || ' (' || n || ').txt' END AS target FROM (
    SELECT p_partkey, p_name || '.txt' AS name, p_name AS stem, row_number() OVER (PARTITION BY p_name ORDER BY '/d/' || p_partkey || '/' || p_name || '.txt') AS n FROM part)""")
def copy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("'/d/' || p_partkey || '/' || p_name || '.txt'").alias("path"))
    return operations.unique_names(rows).select("id", "target")


@query(f"""SELECT id, CASE WHEN id % 4 = 0 THEN '索引状态变化：ID ' || id WHEN id % 4 = 1 THEN '文件不存在：' || path WHEN id % 4 = 2 THEN '文件大小变化：' || path ELSE '' END AS error FROM ({PARTS_SQL}) WHERE status = 'active'""")
def frozen_state_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.parts(spark, sf_dir).where("status = 'active'")
    items = rows.select(F.col("id").alias("book_id"), F.col("id").alias("position"), "path", "size", F.expr("if(id % 4 = 0, mtime + 0.001D, mtime)").alias("mtime"))
    listing = rows.where("id % 4 <> 1").select("path", F.expr("if(id % 4 = 2, size + 1, size)").alias("size"), "mtime", F.lit(True).alias("is_file"))
    return operations.check_items(items, rows, listing).select(F.col("book_id").alias("id"), "error")


@query(f"""SELECT 'description_length' AS check, CAST(0 AS BIGINT) AS violations, count(*) AS rows FROM ({DOCS_SQL}) WHERE status = 'active'
    UNION ALL SELECT 'no_uncategorized_label', 0, count(*) FROM ({DOCS_SQL}) WHERE status = 'active' UNION ALL SELECT 'rating_label_present', 0, count(*) FROM ({DOCS_SQL}) WHERE status = 'active'""")
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.invariants(views.evolve(views.docs(spark, sf_dir)))


# ---------------------------------------------------------------- lookups

_NOW_SQL = "(SELECT max(epoch_us(ts)) / 1e6 FROM events)"


@query(f"""SELECT id, row_number() OVER (ORDER BY last_lookup, id) AS place FROM ({LOOKUPS_SQL}) WHERE rating = '' AND (rating_status IN ('', '待查询', '缺少书名')
    OR (rating_status IN ('未找到', '无评分') AND version < 2) OR (rating_status IN ('查询失败', '豆瓣访问受限') AND last_lookup < {_NOW_SQL} - 86400)) QUALIFY place <= 500""")
def due_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(views.seconds(F.max("ts")).alias("now")).first()["now"]
    rows = views.lookups(spark, sf_dir)
    due = enrich.select_due(rows, now, limit=500)
    from pyspark.sql.window import Window

    page = due.join(rows.select("id", "last_remote_lookup_at"), "id")  # at most 500 rows
    return page.select("id", F.row_number().over(Window.orderBy("last_remote_lookup_at", "id")).cast("long").alias("place"))


@query(f"""SELECT id, CASE WHEN rating <> '' THEN false WHEN rating_status IN ('未找到', '无评分') THEN version < 2 WHEN rating_status IN ('查询失败', '豆瓣访问受限') THEN {_NOW_SQL} - last_lookup >= 86400
    ELSE rating_status <> '已获取' END AS due FROM ({LOOKUPS_SQL})""")
def due_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(views.seconds(F.max("ts")).alias("now")).first()["now"]
    return views.lookups(spark, sf_dir).select("id", enrich.due_row(now).alias("due"))


def _decoded_sql(c: str) -> str:
    """Entities of the test pages decoded, that of the ampersand last."""
    return f"trim(regexp_replace(replace(replace(replace({c}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g'))"


@query(f"""WITH b AS (SELECT page_id, unnest(list_slice(string_split(html, '<p>'), 2, 1000000)) AS block, unnest(range(len(string_split(html, '<p>')) - 1)) AS pos FROM pages)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, {_decoded_sql('title')} AS title, {_decoded_sql('summary')} AS summary FROM (SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_extract(block, '<b>(.*?)<br>', 1, 's'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
      trim(regexp_replace(regexp_replace(regexp_extract(block, '^(.*?)</p>', 1, 's'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS summary FROM b) WHERE title <> ''""")
def candidate_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the pages as result blocks: a bold opening is the block's linked title."""
    pages = table(spark, sf_dir, "pages")
    html = F.regexp_replace("html", "(?s)<b>(.*?)<br>", '<h3><a href="x">$1</a></h3>')
    blocks = F.split(html, "<p>")
    made = F.array_join(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.concat(F.lit('<div class="result"><p>'), b))), "")
    found = enrich.parse_candidates(pages.select("page_id", made.alias("html")))
    return found.select("page_id", "pos", "title", "summary")


_CANDIDATES = [(1, 0, "活着的意义", "9.9", "", "s0", "https://x/1/"), (1, 1, "活着", "7.1", "余华 / 作家出版社", "s1", "https://x/2/"), (2, 0, "活着的意义", "9.9", "", "s2", "https://x/3/"), (4, 0, "《呐喊》", "", "", "旧版", "https://x/4/"), (5, 0, "围城", "8.9", "别人", "a", "u5"), (5, 1, "围城", "8.0", "钱锺书", "b", "u6"), (5, 2, "围城", "9.9", "钱锺书", "c", "u7")]
_ASKERS = [(1, "活着", "余华"), (2, "活着", "余华"), (3, "", ""), (4, "呐喊", "鲁迅"), (5, "围城", "钱锺书")]
_FOUND = [(1, "活着", "https://x/2/", "7.1", "已获取"), (2, "", "", "", "未找到"), (3, "", "", "", "缺少书名"), (4, "《呐喊》", "https://x/4/", "", "无评分"), (5, "围城", "u6", "8.0", "已获取")]


@query(f"""SELECT id, title, douban_url, douban_rating, douban_rating_status FROM {values_sql(_FOUND, 'id, title, douban_url, douban_rating, douban_rating_status')}
    UNION ALL SELECT p_partkey + 100, CASE WHEN untitled THEN '' WHEN even THEN upper(p_name) ELSE p_name END, CASE WHEN untitled THEN '' WHEN even THEN 'c' ELSE 'b' END, CASE WHEN untitled OR p_partkey % 4 = 0 THEN '' WHEN even THEN '8.0' ELSE '7.1' END,
      CASE WHEN untitled THEN '缺少书名' WHEN p_partkey % 4 = 0 THEN '无评分' ELSE '已获取' END FROM (SELECT *, p_partkey % 2 = 0 AS even, p_partkey % 5 = 0 AS untitled FROM part)""")
def identity_match_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, too: three candidates each, of another title, of the same, and for every other part of the same by its maker."""
    part = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey") + 100)
    asked = part.select("id", F.expr("if(p_partkey % 5 = 0, ' ', p_name)").alias("title"), F.col("p_brand").alias("authors"))
    three = "inline(array(named_struct('pos', 0, 'title', p_name || ' x', 'rating', '9.9', 'cast', p_brand, 'summary', '', 'url', 'a'), named_struct('pos', 1, 'title', p_name, 'rating', '7.1', 'cast', '', 'summary', '', 'url', 'b'), named_struct('pos', 2, 'title', if(p_partkey % 2 = 0, upper(p_name), 'y'), 'rating', if(p_partkey % 4 = 0, '', '8.0'), 'cast', 'z / ' || p_brand, 'summary', '', 'url', 'c')))"
    candidates = values(spark, _CANDIDATES, "id long, pos int, title string, rating string, cast string, summary string, url string").unionByName(part.selectExpr("id", three))
    return enrich.identity_match(values(spark, _ASKERS, "id long, title string, authors string").unionByName(asked), candidates).drop("description")


_NAMES = [(1, "活着", "活着.txt", "一部《兄弟》之外的作品。", "余华 著", "活着|兄弟", "活着 余华 著|活着"), (2, "0001", "ya li guan li.txt", "", "", "压力管理", "0001"), (3, "wei zhi", "x_y [z].txt", "边城", "沈从文；某人", "边城", "wei zhi 沈从文|wei zhi")]


@query(f"""SELECT id, expected AS titles, asked AS queries FROM {values_sql(_NAMES, 'id, title, filename, description, authors, expected, asked')}
    UNION ALL SELECT p_partkey + 100, CASE WHEN p_partkey % 2 = 1 OR bad_longer THEN p_name WHEN bad THEN longer ELSE p_name || '|' || longer END, p_name || ' ' || p_brand || '|' || p_name
      FROM (SELECT *, (SELECT {_NAME_SQL} FROM (SELECT p_name AS s)) AS bad, (SELECT {_NAME_SQL} FROM (SELECT longer AS s)) AS bad_longer FROM (SELECT *, 'The ' || p_name AS longer FROM part))""")
def lookup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, too, every other one with a second title in its description."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey + 100 AS id", "p_name AS title", "p_name || '.txt' AS filename", "if(p_partkey % 2 = 0, 'On 《The ' || p_name || '》.', '') AS description", "p_brand AS authors")
    rows = values(spark, [r[:5] for r in _NAMES], "id long, title string, filename string, description string, authors string").unionByName(parts)
    return rows.select("id", F.array_join(enrich.lookup_candidates(F.col("title"), F.col("filename"), F.col("description")), "|").alias("titles"), F.array_join(enrich.queries(F.col("title"), F.col("authors")), "|").alias("queries"))


_ISLANDS_SQL = f"""WITH log AS (SELECT id, seq, "at", status = 'failed' AS failed FROM ({JOB_LOG_SQL})),
    runs AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY "at", seq ROWS UNBOUNDED PRECEDING) AS island FROM log)"""


@query(f"{_ISLANDS_SQL} SELECT id, island, CAST(count(*) AS BIGINT) AS streak FROM runs WHERE failed GROUP BY id, island HAVING count(*) >= 2")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures of each job: the islands that back-off counts."""
    log = views.job_log(spark, sf_dir).select("id", "seq", "at", (F.col("status") == "failed").alias("failed"))
    return enrich.islands(log, "id", ("at", "seq")).where("failed").groupBy("id", "island").agg(F.count("*").alias("streak")).where("streak >= 2")


# ---------------------------------------------------------------- jobs


@query(f"""SELECT id, kind, seq, "at", status, processed FROM ({JOB_LOG_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, seq DESC) = 1""")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(views.job_log(spark, sf_dir), order=("at", "seq")).select("id", "kind", "seq", "at", "status", "processed")


@query(f"""WITH last AS (SELECT * FROM ({JOB_LOG_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, seq DESC) = 1),
    recent AS (SELECT id FROM last ORDER BY "at" DESC, id DESC LIMIT 100)
    SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status, status IN ('queued', 'running') AS interrupted,
      CASE WHEN status NOT IN ('queued', 'running') THEN '' WHEN kind = 'metadata' THEN '服务重启导致任务中断；未完成元数据将由启动恢复流程重新排队' WHEN kind = 'scan' THEN '服务重启导致扫描中断；请确认扫描目录后重新开始' ELSE '服务重启导致任务中断' END AS message
    FROM last WHERE status IN ('queued', 'running') OR id IN (SELECT id FROM recent)""")
def job_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = jobs.latest_state(views.job_log(spark, sf_dir), order=("at", "seq"))
    rows = last.select("id", "kind", "status", F.lit("").alias("message"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return jobs.recover(rows, 1.0).select("id", "status", "interrupted", "message")


@query(f"""WITH RECURSIVE log AS (SELECT id, seq, "at" / 20000 AS "at", CASE status WHEN 'failed' THEN 'failed' ELSE 'running' END AS status, processed, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM ({JOB_LOG_SQL})),
    fold AS (SELECT id, n, seq, "at", status, processed, true AS persisted, "at" AS last_at, processed AS last_p FROM log WHERE n = 1
      UNION ALL SELECT l.id, l.n, l.seq, l."at", l.status, l.processed, p, CASE WHEN p THEN l."at" ELSE last_at END, CASE WHEN p THEN l.processed ELSE last_p END
      FROM (SELECT l.id, l.n, l.seq, l."at", l.status, l.processed, f.last_at, f.last_p, l.status <> f.status OR l.status IN ('finished', 'failed', 'interrupted') OR l."at" - f.last_at >= 10 OR l.processed - f.last_p >= 250 AS p
            FROM fold f JOIN log l ON l.id = f.id AND l.n = f.n + 1) l)
    SELECT id, seq, "at", status, processed FROM fold WHERE persisted""")
def job_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.job_log(spark, sf_dir)  # days of events as seconds of a job, so that the interval matters
    return jobs.throttled(log.withColumns({"at": F.col("at") / 20000, "status": F.when(F.col("status") == "failed", "failed").otherwise("running")}))
