"""The driver's tables as catalogs, tags and job logs, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import evolve

QUARANTINED_ABOVE = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: Column) -> Column:
    """Seconds since 1970 of a time stamp without a zone, taken as UTC."""
    return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())) / 1e6


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog."""
    p = table(spark, sf_dir, "part")
    return evolve(
        p.select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("/part/part-"), F.col("p_partkey"), F.lit(".txt")).alias("path"),
            F.concat(F.lit("part-"), F.col("p_partkey"), F.lit(".txt")).alias("filename"),
            F.lit(".txt").alias("ext"),
            F.col("p_size").cast("long").alias("size"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("authors"),
            F.col("p_type").alias("publisher"),
            F.col("p_retailprice").cast("string").alias("douban_rating"),
            F.when(F.col("p_size") > QUARANTINED_ABOVE, "quarantined").otherwise("active").alias("status"),
            F.col("p_retailprice").alias("updated_at"),
        )
    )


PARTS_SQL = f"""SELECT p_partkey AS id, '/part/part-' || p_partkey || '.txt' AS path, 'part-' || p_partkey || '.txt' AS filename, '.txt' AS ext, CAST(p_size AS BIGINT) AS size,
    p_name AS title, p_brand AS authors, p_type AS publisher, p_retailprice AS rating, CASE WHEN p_size > {QUARANTINED_ABOVE} THEN 'quarantined' ELSE 'active' END AS status,
    p_retailprice AS updated_at FROM part"""


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a part's name, and its type, as tags."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("book_id"), F.explode(F.array_union(F.split("p_name", " "), F.array("p_type"))).alias("tag"))


PART_TAGS_SQL = "SELECT DISTINCT p_partkey AS book_id, unnest(list_append(string_split(p_name, ' '), p_type)) AS tag FROM part"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as a catalog: quality as rating, toxic ones quarantined. Labels are a few numbers per document."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/doc/"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("path"),
        F.concat(F.lit("doc-"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("filename"),
        F.concat(F.lit("."), F.col("lang")).alias("ext"),
        F.col("n_chars").alias("size"),
        F.lit(0.0).alias("mtime"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("source").alias("authors"),
        F.col("text").alias("description"),
        F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("douban_rating"),
        F.when(F.col("quality").isNull(), F.when(F.col("doc_id") % 3 == 0, "待查询").when(F.col("doc_id") % 3 == 1, "查询失败").otherwise("未找到")).otherwise("已获取").alias("douban_rating_status"),
        (F.col("doc_id") % 3).cast("int").alias("remote_lookup_version"),
        F.when(F.col("toxic") == 1, "quarantined").otherwise("active").alias("status"),
    )


DOCS_SQL = """SELECT d.doc_id AS id, '/doc/' || d.doc_id || '.' || lang AS path, 'doc-' || d.doc_id || '.' || lang AS filename, '.' || lang AS ext, n_chars AS size, string_split(text, chr(10))[1] AS title,
    source AS authors, text AS description, coalesce(CAST(quality AS VARCHAR), '') AS rating,
    CASE WHEN quality IS NOT NULL THEN '已获取' WHEN d.doc_id % 3 = 0 THEN '待查询' WHEN d.doc_id % 3 = 1 THEN '查询失败' ELSE '未找到' END AS rating_status,
    d.doc_id % 3 AS version, CASE WHEN toxic = 1 THEN 'quarantined' ELSE 'active' END AS status
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)"""


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as a catalog row with a lookup state."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("r"))
    kind = F.col("r.event_type")
    return evolve(
        last.select(
            F.col("user_id").alias("id"),
            F.concat(F.lit("u"), F.col("user_id")).alias("title"),
            F.when(kind == "purchase", "7.1").otherwise("").alias("douban_rating"),
            F.when(kind == "signup", "").when(kind == "error", "查询失败").when(kind == "click", "未找到").when(kind == "view", "无评分").otherwise("已获取").alias("douban_rating_status"),
            F.when(kind == "signup", 0).when(kind == "click", 1).otherwise(2).alias("remote_lookup_version"),
            seconds(F.col("r.ts")).alias("last_remote_lookup_at"),
        )
    )


LOOKUPS_SQL = """SELECT user_id AS id, CASE kind WHEN 'purchase' THEN '7.1' ELSE '' END AS rating,
    CASE kind WHEN 'signup' THEN '' WHEN 'error' THEN '查询失败' WHEN 'click' THEN '未找到' WHEN 'view' THEN '无评分' ELSE '已获取' END AS rating_status,
    CASE kind WHEN 'signup' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS version, epoch_us(ts) / 1e6 AS last_lookup
    FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS ts FROM events GROUP BY user_id)"""


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as updates of jobs, one job a user: an update's number, time, status, and items so far."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "finished").when(kind == "signup", "queued").otherwise("running")
    return e.select(
        F.col("user_id").cast("string").alias("id"),
        F.when(F.col("user_id") % 3 == 0, "scan").when(F.col("user_id") % 3 == 1, "metadata").otherwise("copy").alias("kind"),
        F.col("event_id").alias("seq"),
        seconds(F.col("ts")).alias("at"),
        status.alias("status"),
        F.floor("value").alias("processed"),
    )


JOB_LOG_SQL = """SELECT CAST(user_id AS VARCHAR) AS id, CASE user_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'metadata' ELSE 'copy' END AS kind, event_id AS seq, epoch_us(ts) / 1e6 AS "at",
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'finished' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status, CAST(floor(value) AS BIGINT) AS processed FROM events"""

