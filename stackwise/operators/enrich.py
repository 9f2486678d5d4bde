"""Looking ratings up elsewhere: what is due, what to ask, reading result pages, choosing a candidate. Fetching is injected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, tags
from ..functions import text as t

# Statuses, periods and limits of the lookup.
PENDING, NO_TITLE, NOT_FOUND, UNRATED, FAILED, LIMITED, OBTAINED = "待查询", "缺少书名", "未找到", "无评分", "查询失败", "豆瓣访问受限", "已获取"
SOURCE = "豆瓣"
VERSION = 2
RETRY_SECONDS = 24 * 3600
STREAK, PAUSE_SECONDS = 8, 6 * 3600
#: Ranges of time that a long log is counted by.
RANGES = 256
TITLE_POINTS, AUTHOR_POINTS = 80, 35


def due_in_set(now: float | Column) -> Column:
    """Which active rows a lookup run selects."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    status = F.col("douban_rating_status")
    again = (status.isin(NOT_FOUND, UNRATED) & (F.col("remote_lookup_version") < VERSION)) | (status.isin(FAILED, LIMITED) & (F.col("last_remote_lookup_at") < now - RETRY_SECONDS))
    return (F.col("status") == "active") & (F.col("douban_rating") == "") & (status.isin("", PENDING, NO_TITLE) | again)


def select_due(catalog: DataFrame, now: float | Column, limit: int | None = None) -> DataFrame:
    """Due ids: titles or authors with CJK first, then those not looked up for longest, then by id."""
    cjk = t.has_cjk(F.col("title")) | t.has_cjk(F.col("authors"))
    out = catalog.where(due_in_set(now)).orderBy(F.when(cjk, 0).otherwise(1), "last_remote_lookup_at", "id").select("id")
    return out if limit is None else out.limit(limit)


def due_row(now: float | Column) -> Column:
    """Whether one scanned row is due. Unlike due_in_set: the bound itself counts, unknown statuses are due, any row status."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    status = t.text_of(F.col("douban_rating_status"))
    return (
        F.when(t.strip(t.text_of(F.col("douban_rating"))) != "", False)
        .when(status.isin(NOT_FOUND, UNRATED), F.coalesce("remote_lookup_version", F.lit(0)) < VERSION)
        .when(status.isin(FAILED, LIMITED), now - F.coalesce("last_remote_lookup_at", F.lit(0.0)) >= RETRY_SECONDS)
        .otherwise(~status.isin(OBTAINED))
    )


def title_from_filename(filename: Column) -> Column:
    s = F.regexp_replace(t.text_of(filename), r"\.[A-Za-z0-9]{2,5}\z", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", " "), r"\[[^\]]*\]", " "), "_+", " ")
    s = F.regexp_replace(s, r"(?Us)\s+[-—–－]\s+.*\z", "")
    return F.coalesce(F.nullif(classify.lookup(s, classify.REMOTE_TITLES), F.lit("")), t.trimmed_text(s, 120))


def titles_from_description(description: Column) -> Column:
    text = t.trimmed_text(description, 500)
    quoted = F.transform(F.regexp_extract_all(text, F.lit("《([^》]{2,60})》"), F.lit(1)), t.strip)
    whole = (text != "") & (F.length(text) <= 40) & ~text.rlike("[。！？.!?，,；;]")
    return F.slice(F.concat(quoted, F.when(whole, F.array(text)).otherwise(F.expr(tags.NO_TAGS))), 1, 3)


def lookup_candidates(title: Column, filename: Column, description: Column) -> Column:
    """Titles to ask for: the title if good, titles in the description, the file name's, the title; at least one."""
    own, named = t.trimmed_text(title, 120), title_from_filename(filename)
    raw = F.concat(F.when(~classify.suspicious_title(title), F.array(own)).otherwise(F.expr(tags.NO_TAGS)), titles_from_description(description), F.array(named, own))
    good = F.array_distinct(F.filter(F.transform(raw, lambda c: t.trimmed_text(c, 120)), lambda c: (c != "") & ~classify.suspicious_title(c)))
    return F.when(F.size(good) > 0, good).otherwise(F.array(t.trimmed_text(F.coalesce(F.nullif(t.text_of(title), F.lit("")), filename), 120)))


def queries(title: Column, authors: Column) -> Column:
    """What to ask with a title: title and first author, then the title alone."""
    author = t.primary_author(authors)
    raw = F.array(F.when(author != "", F.concat(title, F.lit(" "), author)), title)
    return F.array_distinct(F.filter(F.transform(F.filter(raw, lambda q: q.isNotNull()), lambda q: t.trimmed_text(q, 140)), lambda q: q != ""))


def plain(c: Column) -> Column:
    """Without tags, white space squeezed."""
    return t.squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def parse_candidates(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row per result block of a page with a title or rating: pos (from 0) and title, rating, cast, summary, url, entities decoded; other columns stay."""
    blocks = F.split(t.text_of(pages[html]), r'(?i)<div\s+class="result">')
    rest = [c for c in pages.columns if c != html]
    b = F.substring_index(F.col("block"), '<div class="result"', 1)
    found = pages.select(*rest, F.posexplode(F.slice(blocks, 2, 2147483647)).alias("pos", "raw_block")).select(*rest, "pos", F.col("raw_block").alias("block"))

    def first(pattern: str) -> Column:
        return F.regexp_extract(b, pattern, 1)

    attribute, heading = first(r'(?i)<a[^>]+title="([^"]+)"'), plain(first(r"(?is)<h3>.*?<a[^>]*>(.*?)</a>"))
    link = F.coalesce(F.nullif(first(r'(?i)href="([^"]*book\.douban\.com%2Fsubject%2F[^"]+)"'), F.lit("")), first(r'(?i)href="(https://book\.douban\.com/subject/\d+/)"'))
    out = found.select(
        *rest,
        "pos",
        t.strip(t.unescape(F.when(attribute != "", attribute).otherwise(heading))).alias("title"),
        t.strip(first(r'(?i)<span\s+class="rating_nums">([0-9.]+)</span>')).alias("rating"),
        t.strip(t.unescape(plain(first(r'(?is)<span\s+class="subject-cast">(.*?)</span>')))).alias("cast"),
        t.strip(t.unescape(plain(first(r"(?is)<p>(.*?)</p>")))).alias("summary"),
        t.decode_link(link).alias("url"),
    )
    return out.where((F.col("title") != "") | (F.col("rating") != ""))


def identity_match(asked: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """For each asked row (key, title, authors) the candidate with the same title, one whose cast has the author first, then by pos.

    Returns key and the fields that a lookup sets: title, douban_url, douban_rating, douban_rating_status, description. A
    rating is not part of the order. Without such a candidate the status is "not found", without a title "no title".
    """
    q = asked.select(key, t.normalize_match_text(F.col("title")).alias("want"), t.normalize_match_text(t.primary_author(F.col("authors"))).alias("by"), (t.strip(t.text_of(F.col("title"))) == "").alias("untitled"))
    named = candidates.withColumn("got", t.normalize_match_text(F.col("title")))
    first = Window.partitionBy(key, F.coalesce(F.nullif("url", F.lit("")), F.concat_ws("|", "title", "cast"))).orderBy("pos")
    named = named.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    score = F.lit(TITLE_POINTS) + F.when((F.col("by") != "") & F.contains(t.normalize_match_text(F.col("cast")), F.col("by")), AUTHOR_POINTS).otherwise(0)
    fits = named.join(q, key).where((F.col("got") == F.col("want")) & ~F.col("untitled"))
    best = fits.withColumn("score", score).groupBy(key).agg(F.max_by(F.struct("title", "rating", "summary", "url"), F.struct("score", -F.col("pos"))).alias("best"))
    out = q.select(key, "untitled").join(best, key, "left")
    rated = F.col("best.rating") != ""
    return out.select(
        key,
        F.coalesce("best.title", F.lit("")).alias("title"),
        F.coalesce("best.url", F.lit("")).alias("douban_url"),
        F.coalesce("best.rating", F.lit("")).alias("douban_rating"),
        F.when(F.col("untitled"), NO_TITLE).when(F.col("best").isNull(), NOT_FOUND).when(rated, OBTAINED).otherwise(UNRATED).alias("douban_rating_status"),
        F.coalesce("best.summary", F.lit("")).alias("description"),
    )


def can_replace_title(local: Column, remote: Column) -> Column:
    """A remote title replaces a bad or missing one, or one that is the same but for punctuation."""
    same = (t.normalize_match_text(local) != "") & (t.normalize_match_text(local) == t.normalize_match_text(remote))
    return (remote != "") & ((local == "") | classify.suspicious_title(local) | same)


def lookup_result(books: DataFrame, matched: DataFrame, fetched: DataFrame | None = None, key: str = "id") -> DataFrame:
    """What a lookup sets for each book (title, authors, description, filename): outcome, tags, sources, and the title only if it may replace.

    A book with CJK text takes no match without CJK in its title, nor one of another title. ``fetched`` has what a second
    source says of other books (key, title, authors, description, published_year, isbn, language, subjects, remote_url).
    """
    m = matched.select(key, *(F.col(c).alias(f"m_{c}") for c in matched.columns if c != key))
    out = books.select(key, "title", "authors", "description", "filename").join(m, key, "left")
    empty = F.lit("")
    if fetched is not None:
        out = out.join(fetched.select(key, *(F.col(c).alias(f"f_{c}") for c in fetched.columns if c != key)), key, "left")
    cjk = t.has_cjk(F.concat_ws(" ", "title", "authors", "description"))
    anchor = F.when(classify.suspicious_title(F.col("title")), F.col("m_title")).otherwise(F.col("title"))
    wrong = cjk & (F.col("m_title") != "") & (~t.has_cjk(F.col("m_title")) | ~can_replace_title(anchor, F.col("m_title")))
    mine = lambda c: F.when(wrong, empty).otherwise(F.coalesce(F.col(f"m_{c}"), empty))
    theirs = (lambda c: F.when(cjk, empty).otherwise(F.coalesce(F.col(f"f_{c}"), empty))) if fetched is not None else (lambda c: empty)
    pick = lambda *cs: F.coalesce(*(F.nullif(c, empty) for c in cs), empty)
    title, description = pick(mine("title"), theirs("title")), pick(theirs("description"), mine("description"))
    subjects = F.when(~cjk, F.col("f_subjects")) if fetched is not None else None
    found = tags.merge_tags(tags.infer_tags(pick(title, F.col("title")), F.col("authors"), pick(description, F.col("description")), F.col("filename"), subjects=subjects))
    second = F.lit("Open Library") if fetched is not None else empty
    has_second = (theirs("title") != "") if fetched is not None else F.lit(False)
    rated = mine("douban_rating") != ""
    return out.select(
        key,
        F.when(can_replace_title(F.col("title"), title), title).otherwise("").alias("title"),
        pick(t.strip(F.col("authors")), theirs("authors")).alias("authors"),
        description.alias("description"),
        *(theirs(c).alias(c) for c in ("published_year", "isbn", "language", "remote_url")),
        mine("douban_rating").alias("douban_rating"),
        mine("douban_url").alias("douban_url"),
        F.when(wrong, NOT_FOUND).otherwise(mine("douban_rating_status")).alias("douban_rating_status"),
        found.alias("tags"),
        F.when(has_second & rated, F.concat(second, F.lit(f"; {SOURCE}"))).when(has_second, second).when(rated, SOURCE).otherwise("").alias("remote_source"),
    )


def islands(log: DataFrame, partition: str | None = None, order: Sequence[str] = ("at",)) -> DataFrame:
    """A log (``failed``) with ``island``, the successes so far: failures between two successes are one island."""
    rows = Window.partitionBy(*([partition] if partition else [])).orderBy(*order)
    return log.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(rows.rowsBetween(Window.unboundedPreceding, 0)))


def streaks(log: DataFrame, partition: str) -> DataFrame:
    """The failures of a log (at, failed) with ``streak``, how many in a row each is; ``partition`` separates independent lookups."""
    n = F.row_number().over(Window.partitionBy(partition, "island").orderBy("at"))
    return islands(log, partition).where("failed").withColumn("streak", n.cast("long"))


def streaks_of_one(log: DataFrame, ranges: int = RANGES) -> DataFrame:
    """streaks of one log without a partition: by ranges of time, and what each range hands on to the next.

    A range's streaks are counted by themselves; those before its first success go on from the ranges before. Of each range
    its rows, successes and failures after the last success are gathered, so no task and not the driver gets all rows.
    Failures at the same time count in any order.
    """
    bounds = sorted(set(log.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    number = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col("at")))
    rows = islands(log.withColumn("range", number), "range").withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("at")))
    last = F.coalesce(F.max(F.when(~F.col("failed"), F.col("place"))), F.lit(0))
    carries, carry = {}, 0
    for r in rows.groupBy("range").agg(F.count("*").alias("n"), last.alias("last")).orderBy("range").collect():  # a row a range
        carries[r["range"]] = carry
        carry = (0 if r["last"] else carry) + r["n"] - r["last"]
    known = log.sparkSession.createDataFrame(list(carries.items()), "range int, carry long")
    n = F.row_number().over(Window.partitionBy("range", "island").orderBy("at"))
    out = rows.where("failed").withColumn("streak", n.cast("long")).join(F.broadcast(known), "range")
    return out.withColumn("streak", F.col("streak") + F.when(F.col("island") == 0, F.col("carry")).otherwise(0)).drop("range", "place", "carry", "island")


def failure_pauses(log: DataFrame, partition: str | None = None) -> DataFrame:
    """From a log (at, failed): each STREAK-th consecutive failure and until when lookups pause after it; a success ends a streak.

    ``partition`` separates independent lookups; without one all rows are one log, however long.
    """
    found = streaks(log, partition) if partition else streaks_of_one(log)
    keys = [partition] if partition else []
    return found.where(F.col("streak") % STREAK == 0).select(*keys, "at", F.col("streak").cast("int").alias("streak"), (F.col("at") + PAUSE_SECONDS).alias("paused_until"))
