"""Registered queries of the row rules, readers and merges: inputs are made from the driver's tables, the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as t
from ..operators import claims, enrich, facets, jobs, merge, search
from ..schema import evolve
from ..sources import readers
from . import repair, scan, views
from .queries import _CLEAN_SQL, _NAME_SQL, _bytes_sql, query
from .views import DOCS_SQL, JOB_LOG_SQL, LOOKUPS_SQL, PART_TAGS_SQL, PARTS_SQL, table


def _name_sql(c: str) -> str:
    """The SQL twin of suspicious_title for the names of parts and customers."""
    return f"(SELECT {_NAME_SQL} FROM (SELECT {c} AS s))"


_AUTHOR_SQL = "regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]')"


# ---------------------------------------------------------------- rows as shown


def _short_sql(c: str) -> str:
    x = f"rtrim(substr({_CLEAN_SQL.format(c)}, 1, 151))"
    return f"CASE WHEN length({x}) > 150 THEN rtrim(substr({x}, 1, 149)) || '…' ELSE {x} END"


_SIMPLE_SQL = """'《' || CASE WHEN {title} = '' THEN '这本书' ELSE {title} END || '》是一本' || {kind} || '电子书' || CASE WHEN {by} = '' THEN '' ELSE '，作者为 ' || {by} END || '，本地文件格式为 ' || upper(substr(ext, 2)) || '。'"""


@query(f"""SELECT id, CASE WHEN short = '' THEN {_SIMPLE_SQL.format(title="rtrim(substr(trim(regexp_replace(title, '\\s+', ' ', 'g')), 1, 120))", kind="'本地'", by='authors')} ELSE short END AS description,
    coalesce(nullif(rating, ''), nullif(rating_status, ''), '未找到') AS rating_label, {_bytes_sql('size')} AS size_label FROM (SELECT *, {_short_sql('description')} AS short FROM ({DOCS_SQL}))""")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.display(evolve(views.docs(spark, sf_dir))).select("id", "description", "rating_label", "size_label")


@query(f"""SELECT id, {_SIMPLE_SQL.format(title='title', kind="array_to_string(list_filter(string_split(title, ' '), lambda x: x <> '')[1:3], '、') || '类'", by="CASE WHEN id % 3 = 0 THEN '' ELSE authors END")} AS description FROM ({PARTS_SQL})""")
def simple_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parts(spark, sf_dir).select("id", t.simple_description(F.col("title"), F.expr("if(id % 3 = 0, '', authors)"), F.split("title", " "), F.col("ext")).alias("description"))


@query("""SELECT p_partkey, p_name || ' < "' || p_brand || '" & ' || chr(8364) || chr(128512) || ' &nosuch; ¬it' AS cleaned, p_name || ' a < b ' || p_type AS described FROM part""")
def entities_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose names and numbers of entities are decoded once, and descriptions, decoded twice, where what is markup after the first time goes."""
    raw = F.concat("p_name", F.lit(" &lt; &quot;"), "p_brand", F.lit("&#34; &amp; &#x80;&#x1F600; &nosuch; &notit"))
    twice = F.concat(F.lit("&lt;p class='x'&gt;"), "p_name", F.lit("&lt;/p&gt; a &amp;lt; b "), "p_type", F.lit(" &lt;br&gt;https&#58;//example.com/x"))
    return table(spark, sf_dir, "part").select("p_partkey", t.clean_text(raw).alias("cleaned"), t.clean_description(twice).alias("described"))


# ---------------------------------------------------------------- names


@query("""SELECT p_partkey, trim(regexp_replace(s, '_+', ' ', 'g'), ' -_—–.。·•:：|｜>＞') AS title FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type || '__' || p_name WHEN 1 THEN p_name || ' - ' ELSE ' · ' || replace(p_name, ' ', '_') || '：' END AS s FROM part)""")
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with navigation words, a section number and marks around them."""
    s = F.expr("case p_partkey % 3 when 0 then concat('上一页 > 目录页', p_type, '__', p_name) when 1 then concat('第 ', p_size, ' 节：', p_name, ' - ') else concat(' · ', replace(p_name, ' ', '_'), '：') end")
    return table(spark, sf_dir, "part").select("p_partkey", t.clean_title(s).alias("title"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN p_name || ' [' || p_brand || '] x' ELSE p_name END AS author, p_name AS all_authors, p_name AS first_author FROM part""")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors behind a prefix, in brackets, with their entities, roles and further names."""
    one = F.expr("case p_partkey % 4 when 0 then concat('Author： ', p_name) when 1 then concat('【', p_name, ')') when 2 then concat(p_name, ' #91;', p_brand, '#93; x') else concat('  作者:', p_name) end")
    many = F.expr("case p_partkey % 2 when 0 then concat('主编：', p_name, '（', p_brand, '）') else concat('[', p_type, '] ', p_name, ' / ') end")
    return table(spark, sf_dir, "part").select("p_partkey", t.clean_author(one).alias("author"), t.clean_authors(many).alias("all_authors"), t.primary_author(F.concat("p_name", F.lit("，"), "p_brand")).alias("first_author"))


@query("""SELECT p_partkey, list_reduce(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || '; ' || b END) AS joined FROM part""")
def joined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.join_values(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")).alias("joined"))


@query("""SELECT page_id, translate(url, '<>:"/\\|?*', '_________') AS name, array_to_string(list_transform(list_filter(string_split_regex(url || '/../a\\b', '[/\\\\]+'), lambda x: x NOT IN ('', '.', '..')), lambda x: translate(x, '<>:"/\\|?*', '_________')), '/') AS path FROM pages""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.safe_filename(F.col("url")).alias("name"), t.safe_relative_path(F.concat("url", F.lit("/../a\\b"))).alias("path"))


@query("SELECT page_id, url AS link FROM pages")
def decoded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links behind a redirection and plain ones."""
    link = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://r.example/l?a=1&url="), F.url_encode("url"), F.lit("&b=2#c")))
    return table(spark, sf_dir, "pages").select("page_id", t.decode_link(link).alias("link"))


@query(f"SELECT doc_id, n >= 2 AS mojibake FROM (SELECT doc_id, length(text) - length(regexp_replace(text, '[�{classify.LATIN}]', '', 'g')) AS n FROM documents)")
def mojibake_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of many Latin-1 letters; the tables hold no CJK."""
    return table(spark, sf_dir, "documents").select("doc_id", classify.looks_mojibake(F.col("text")).alias("mojibake"))


# ---------------------------------------------------------------- readers


@query("SELECT doc_id, text AS decoded FROM documents")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8, every other one with a byte order mark, decoded without being told so."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(readers._decoded, "string")(raw).alias("decoded"))


@query("""SELECT p_partkey, p_name AS title, p_brand || '; ' || p_type AS authors, p_name || ' by ' || p_brand AS description, 'en' AS language, p_type AS publisher, CAST(1950 + p_size AS VARCHAR) AS published_year,
    CASE WHEN p_partkey % 2 = 0 THEN CAST(9780000000000 + p_partkey AS VARCHAR) END AS isbn, CASE WHEN p_partkey % 3 <> 0 THEN 'img/' || p_partkey || '.jpg' END AS cover_path, NULL AS scan_error FROM part WHERE p_partkey % 10 <> 0
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 0""")
def sidecar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars made of parts, every tenth one damaged."""
    xml = F.expr("""concat('<?xml version="1.0"?><package xmlns="u" xmlns:dc="d"><metadata><dc:title>', p_name, '</dc:title><dc:title>other</dc:title><dc:creator>', p_brand, '</dc:creator><dc:creator>', p_type, '</dc:creator><dc:description>',
        p_name, ' by ', p_brand, '</dc:description><dc:language>en</dc:language><dc:publisher>', p_type, '</dc:publisher><dc:date>c. ', 1950 + p_size, '-01</dc:date><dc:identifier>', if(p_partkey % 2 = 0, cast(9780000000000 + p_partkey as string), 'uuid:1'),
        '</dc:identifier>', if(p_partkey % 3 <> 0, '<meta name="cover" content="c"/>', ''), '</metadata><manifest><item id="c" href="img/', p_partkey, '.jpg"/></manifest>', if(p_partkey % 10 = 0, '<broken', '</package>'))""")
    return table(spark, sf_dir, "part").select("p_partkey", readers.opf_column(F.encode(xml, "UTF-8")).alias("f")).select("p_partkey", *(f"f.{c}" for c in ("title", "authors", "description", "language", "publisher", "published_year", "isbn", "cover_path", "scan_error")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_name || chr(10) || p_type END AS description, p_partkey % 4 = 3 AS failed FROM part""")
def read_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by extension: RTF, plain text, one without a reader, and a damaged archive, which is an error of its own."""
    ext = F.expr("element_at(array('.rtf', '.md', '.fb2', '.docx'), cast(p_partkey % 4 + 1 as int))")
    rich = F.concat(F.lit("{\\rtf1\\ansi "), "p_name", F.lit("\\par\\b0 "), "p_type", F.lit("\\'e9}"))
    raw = F.when(F.col("p_partkey") % 4 == 0, rich).otherwise(F.concat("p_name", F.lit("\n"), "p_type"))
    read = table(spark, sf_dir, "part").select("p_partkey", readers.reader_column(F.encode(raw, "UTF-8"), ext).alias("f"))
    return read.select("p_partkey", "f.description", F.coalesce(F.col("f.scan_error") != "", F.lit(False)).alias("failed"))


# ---------------------------------------------------------------- scan


_SEEN = "l_orderkey % 4 AS size, CAST(l_linenumber % 3 AS DOUBLE) AS mtime, l_orderkey % 4 + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS seen_size, CAST(l_linenumber % 3 AS DOUBLE) + l_discount * 0.15 AS seen_mtime"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN size = 0 THEN -1 ELSE size END = seen_size AND abs(CASE WHEN mtime = 0 THEN -1.0 ELSE mtime END - seen_mtime) < 0.01 AS same
    FROM (SELECT l_orderkey, l_linenumber, {_SEEN} FROM lineitem)""")
def same_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_SEEN.split(", "))
    return rows.select("l_orderkey", "l_linenumber", scan.same_file(F.col("size"), F.col("mtime"), F.col("seen_size"), F.col("seen_mtime")).alias("same"))


@query(f"""SELECT id, CASE WHEN {_name_sql('title')} THEN 'bad_title' WHEN id % 5 = 0 OR id % 7 = 0 THEN 'default_description' WHEN id % 3 = 0 THEN 'missing_tags' ELSE '' END AS reason,
    {_name_sql('title')} OR (id % 2 = 0 AND {_AUTHOR_SQL.format('authors')}) AS repair FROM ({PARTS_SQL})""")
def refresh_and_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a file is read again, and whether its row needs repair."""
    rows = views.parts(spark, sf_dir).withColumn("authors", F.expr("if(id % 2 = 0, authors, if(id % 3 = 0, '', '未知'))"))
    reason = scan.refresh_reason(F.col("title"), F.expr("if(id % 5 = 0, '本书尚未分类。', 'x')"), F.expr("case when id % 7 = 0 then '未分类' when id % 3 = 0 then ' ' else '小说' end"))
    return rows.select("id", reason.alias("reason"), repair.needs_repair().alias("repair"))


_CLASSIFIED_SQL = f"""SELECT b.path, b.id, supported, same, reason, CASE WHEN NOT supported THEN 'skip' WHEN same AND reason = '' THEN 'touch' ELSE 'index' END AS action,
    CASE WHEN supported AND same AND reason = '' THEN false ELSE b.id IS NULL OR NOT same OR reason <> '' END AS remote_due
    FROM (SELECT *, CASE WHEN same AND {_name_sql("coalesce(title, 'x')")} THEN 'bad_title' ELSE '' END AS reason FROM (SELECT '/part/part-' || n || '.txt' AS path, n % 5 <> 0 AS supported, p.id, title, coalesce(p.id IS NOT NULL AND p.size <> 0 AND n % 6 <> 0 AND n % 4 <> 0, false) AS same
      FROM (SELECT p_partkey AS n FROM part UNION ALL SELECT p_partkey + 10000000 FROM part) f LEFT JOIN ({PARTS_SQL}) p ON p.id = n)) b"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = views.parts(spark, sf_dir).withColumns({"mtime": F.col("id") + 1.0, "tags_text": F.lit("小说")})
    known = catalog.select("id", "path", "size").withColumn("n", F.col("id"))
    more = known.select("n", "size").withColumn("n", F.col("n") + 10_000_000).withColumn("path", F.concat(F.lit("/part/part-"), "n", F.lit(".txt")))
    listing = known.drop("id").unionByName(more).select("path", F.expr("if(n % 4 = 0, size + 1, size)").alias("size"), F.expr("if(n % 6 = 0, n + 1.5D, n + 1.0D)").alias("mtime"), F.expr("n % 5 <> 0").alias("supported"))
    return scan.classify_files(listing, catalog, 0.0)


@query(_CLASSIFIED_SQL)
def scan_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of known, changed and new files against the catalog."""
    return _classified(spark, sf_dir).select("path", "id", "supported", "same", "reason", "action", "remote_due")


@query(f"""SELECT count(*) AS processed, count_if(action <> 'skip') AS found, count_if(action = 'skip') AS skipped, count_if(action = 'index') AS indexed, count_if(action = 'touch') AS unchanged,
    count_if(action <> 'skip' AND remote_due) AS remote_queued, count_if(action <> 'skip' AND NOT remote_due) AS remote_skipped, count_if(action = 'index' AND id IS NULL) AS error_count FROM ({_CLASSIFIED_SQL})""")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return facets.scan_counters(rows.withColumn("scan_error", F.when((F.col("action") == "index") & F.col("id").isNull(), "damaged").otherwise("")))


# ---------------------------------------------------------------- merges


@query(f"""SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(nullif(fresh, ''), '已获取') WHEN rating <> '' THEN coalesce(nullif(rating_status, ''), '已获取') ELSE coalesce(nullif(fresh, ''), nullif(rating_status, ''), '') END AS status
    FROM (SELECT *, CASE WHEN id % 2 = 0 THEN '' ELSE '无评分' END AS fresh FROM ({LOOKUPS_SQL}))""")
def rating_status_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    new_rating, fresh = F.expr("if(id % 3 = 0, '8.8', ' ')"), F.expr("if(id % 2 = 0, '', '无评分')")
    return views.lookups(spark, sf_dir).select("id", merge.rating_status(new_rating, fresh, F.col("douban_rating"), F.col("douban_rating_status")).alias("status"))


@query(f"""SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(rating AS VARCHAR) END AS rating, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN '待查询' ELSE '未找到' END WHEN id % 2 = 1 THEN '已获取' ELSE '无评分' END AS status,
    CASE WHEN id % 3 = 0 THEN 0 ELSE 2 END AS version, 'active' AS state FROM ({PARTS_SQL})""")
def upsert_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known files read again: a third of them with the order to look them up anew."""
    old = views.parts(spark, sf_dir).withColumns({"remote_lookup_version": F.lit(2), "douban_rating_status": F.expr("if(id % 2 = 1, '', '无评分')")})
    new = old.select("path", "size", "mtime", "title", F.expr("if(id % 3 = 0 and id % 2 = 1, '未找到', '')").alias("douban_rating_status"), (F.col("id") % 3 == 0).alias("reset_remote"))
    return merge.upsert(old, new, now=5.0).select("id", F.col("douban_rating").alias("rating"), F.col("douban_rating_status").alias("status"), F.col("remote_lookup_version").alias("version"), F.col("status").alias("state"))


@query(f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'New ' || title ELSE title END AS title, publisher, CASE WHEN id % 4 = 0 THEN '9.9' ELSE CAST(rating AS VARCHAR) END AS rating, CASE WHEN id % 2 = 0 THEN '已获取' ELSE '' END AS status,
    CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS version, CAST(CASE WHEN id % 2 = 0 THEN 7 ELSE updated_at END AS DOUBLE) AS updated_at FROM ({PARTS_SQL})""")
def lookups_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of lookups for every other row: blank values change nothing."""
    parts = views.parts(spark, sf_dir)
    found = parts.where("id % 2 = 0").select("id", F.expr("if(id % 4 = 0, concat('New ', title), ' ')").alias("title"), F.expr("if(id % 4 = 0, '9.9', '')").alias("douban_rating"), F.lit("").alias("publisher"))
    out = merge.apply_lookup(parts, found, 7.0)
    return out.select("id", "title", "publisher", F.col("douban_rating").alias("rating"), F.col("douban_rating_status").alias("status"), F.col("remote_lookup_version").alias("version"), "updated_at")


@query(f"""SELECT book_id, tag FROM ({PART_TAGS_SQL}) UNION SELECT p_partkey, unnest(['历史', '小说']) FROM part WHERE p_partkey % 3 = 0""")
def tags_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual tags of every third row, twice, and of ids that the catalog doesn't have; unknown names vanish."""
    parts, bridge = views.parts(spark, sf_dir), views.part_tags(spark, sf_dir)
    ids = parts.where("id % 3 = 0").select("id")
    ids = ids.unionByName(ids).unionByName(ids.select((F.col("id") + 10_000_000).alias("id")))
    return merge.add_tags(parts, bridge, ids, ["历史", "nonsense", "Science Fiction"], 5.0)[1]


@query(f"""SELECT book_id, tag FROM ({PART_TAGS_SQL}) WHERE book_id % 3 <> 0 UNION ALL SELECT p_partkey, unnest(['a', p_brand]) FROM part WHERE p_partkey % 3 = 0""")
def tag_sets_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("book_id"), F.array(F.lit("a"), F.col("p_brand"), F.lit("a")).alias("tags"))
    return merge.replace_tag_sets(views.part_tags(spark, sf_dir), new)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END AS title, 'local' AS source, 'active' AS status, CAST(0 AS BIGINT) AS size, 0 AS remote_lookup_version, '' AS isbn FROM part")
def defaults_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old snapshot with few columns and nulls, read under the present schema."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id"), F.expr("if(p_partkey % 2 = 0, null, p_name)").alias("title"), F.lit(1).alias("gone"))
    return evolve(old).select("id", "title", "source", "status", "size", "remote_lookup_version", "isbn")


# ---------------------------------------------------------------- jobs and lookups


@query("""SELECT id, CASE WHEN id % 3 = 1 AND id % 2 = 0 THEN 'other' ELSE 'me' END AS owner, CAST(CASE WHEN id % 3 = 1 AND id % 2 = 0 THEN 200 ELSE 160 END AS DOUBLE) AS until FROM (SELECT p_partkey AS id FROM part)
    UNION ALL SELECT p_partkey + 10000000, 'other', CAST(200 AS DOUBLE) FROM part WHERE p_partkey % 2 = 0""")
def ids_leased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, asked for twice, where another owner holds some, held others until now, and holds ids that aren't asked for."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    held = ids.where("id % 3 = 1").select("id", F.lit("other").alias("owner"), F.expr("if(id % 2 = 0, 200.0D, 100.0D)").alias("until"))
    held = held.unionByName(ids.where("id % 2 = 0").select((F.col("id") + 10_000_000).alias("id"), F.lit("other").alias("owner"), F.lit(200.0).alias("until")))
    return claims.lease(ids.unionByName(ids), held, "me", 100.0, 60.0)[1]


@query(f"""SELECT id, array_to_string(list_transform(list(message ORDER BY seq), lambda m: substr(m, 1, 500))[-50:], '|') AS errors FROM (SELECT id, seq, repeat(status || seq || ' ', 100) AS message FROM ({JOB_LOG_SQL})) GROUP BY id""")
def errors_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All updates of a job as its errors; a job of these tables has some hundreds at most."""
    log = views.job_log(spark, sf_dir).select("id", "seq", F.expr("repeat(concat(status, seq, ' '), 100)").alias("message"))
    errors = log.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("e"))
    return errors.select("id", F.array_join(jobs.capped(F.transform("e", lambda x: x["message"])), "|").alias("errors"))


@query(f"""WITH runs AS (SELECT id, "at", status <> 'queued' AS failed, sum(CASE WHEN status <> 'queued' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY "at" RANGE UNBOUNDED PRECEDING) AS island FROM ({JOB_LOG_SQL})),
    numbered AS (SELECT id, "at", row_number() OVER (PARTITION BY id, island ORDER BY "at") AS streak FROM runs WHERE failed)
    SELECT id, "at", CAST(streak AS INTEGER) AS streak, "at" + 21600 AS paused_until FROM numbered WHERE streak % 8 = 0""")
def lookup_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-off of independent lookups, one a user: anything but a sign-up counts as a failure, so that streaks are long."""
    log = views.job_log(spark, sf_dir).select("id", "at", (F.col("status") != "queued").alias("failed"))
    return enrich.failure_pauses(log, "id")


@query(f"""WITH log AS (SELECT "at", count_if(status = 'queued') < 2 AS failed FROM ({JOB_LOG_SQL}) GROUP BY "at"),
    runs AS (SELECT "at", failed, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS island FROM log),
    numbered AS (SELECT "at", row_number() OVER (PARTITION BY island ORDER BY "at") AS streak FROM runs WHERE failed)
    SELECT "at", CAST(streak AS INTEGER) AS streak, "at" + 21600 AS paused_until FROM numbered WHERE streak % 8 = 0""")
def lookup_pauses_of_one_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-off of one lookup at a time: the whole log, whose few successes are times of two sign-ups or more."""
    log = views.job_log(spark, sf_dir).groupBy("at").agg((F.count_if(F.col("status") == "queued") < 2).alias("failed"))
    return enrich.failure_pauses(log)
