"""Text functions as Column expressions.

White space is Unicode's, letter case folds in ASCII only where the name says so. Descriptions and looked-up texts have
their HTML entities decoded by ``unescape``; ``html_unescape`` is the same in Python.
"""

from __future__ import annotations

import functools
import html
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits and marks of the catalog.
EXCERPT = 1400
READ_BYTES = 512 * 1024
DISPLAY = 150
UNKNOWN_AUTHOR = "未知"
UNKNOWN_TITLE = "待识别书名"
NOT_FOUND = "未找到"
ADVERT = "本书由|更多(?:免费)?电子书|关注公众号|下载(?:地址|链接)|手机阅读|返回目录|版权归原作者所有|仅供学习交流|请在下载后.{0,20}删除"
NAVIGATION = "上一页|下一页|目录页|回目录|正文回目录|当前位置|您所在的位置"
TITLE_EDGES = " \t\r\n-_—–.。·•:：|｜>＞"
AUTHOR_EDGES = " []()（）【】"
MATCH_PUNCTUATION = "《》“”\"'：:·.\\-—–_()\\[\\]（）【】"
FORBIDDEN_IN_NAMES = '<>:"/\\|?*'

SPACE = r"[\s\x1c-\x1f]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """HTML entities decoded; null stays null."""
    return texts.map(html.unescape, na_action="ignore")


_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_NO_CHARACTER = 0x110000


@functools.cache
def _low_characters() -> str:
    """Numbers below 0xA0 that aren't their own characters, as ``number=character`` entries."""
    return "\x01".join(f"{n}\x02{html.unescape(f'&#{n};')}" for n in range(0xA0) if html.unescape(f"&#{n};") != chr(n))


@functools.cache
def _names() -> tuple[str, str]:
    """The standard's names as ``name=text`` entries, and an alternation of those that need no semicolon, longest first."""
    open_names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "\x01".join(f"{n}\x02{x}" for n, x in html5.items()), "|".join(open_names)


def _table(entries: str) -> Column:
    return F.str_to_map(F.lit(entries), F.lit("\x01"), F.lit("\x02"))


def _character(number: Column) -> Column:
    """The character that a numeric entity stands for: Windows' ones for 0x80 to 0x9F, nothing for controls and noncharacters."""
    bad = number.between(0xD800, 0xDFFF) | (number >= _NO_CHARACTER)
    nothing = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    low = F.coalesce(F.try_element_at(_table(_low_characters()), number.cast("string")), F.chr(number))
    own = F.decode(F.unhex(F.lpad(F.hex(number), 8, F.lit("0"))), "UTF-32")
    return F.when(bad, "\ufffd").when(nothing, "").when(number < 0xA0, low).otherwise(own)


def _entity(found: Column) -> Column:
    """What one match of _ENTITY stands for; itself if it is no entity."""
    named, alternation = _names()

    def number(digits: Column, most: int, base: int) -> Column:
        return F.when(F.length(digits) > most, _NO_CHARACTER).otherwise(F.coalesce(F.conv(digits, base, 10).cast("int"), F.lit(0)))

    def numeric(s: Column) -> Column:
        hexadecimal = s.rlike("^#[xX]")
        digits = F.regexp_extract(s, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        return let(F.when(hexadecimal, number(digits, 6, 16)).otherwise(number(digits, 7, 10)), _character)

    def by_name(s: Column) -> Column:
        start = F.regexp_extract(s, f"^(?:{alternation})", 0)
        whole = F.try_element_at(_table(named), s)
        return F.coalesce(whole, let(start, lambda x: F.when(x != "", F.concat(F.try_element_at(_table(named), x), F.substring(s, F.length(x) + 1, F.length(s))))), F.concat(F.lit("&"), s))

    return let(F.substring(found, 2, 1 << 20), lambda s: F.when(s.startswith("#"), numeric(s)).otherwise(by_name(s)))


def unescape(c: Column) -> Column:
    """HTML entities decoded, as the HTML standard says for texts; null stays null. Texts without an ampersand are returned at once."""

    def decoded(x: Column) -> Column:
        found = F.transform(F.regexp_extract_all(x, F.lit(_ENTITY), F.lit(0)), _entity)
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), found), F.split(x, _ENTITY, -1), lambda a, b: F.concat(a, b)), "")

    return let(c, lambda x: F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out (and written into the plan) once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: Column) -> Column:
    """c as text, null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿]")


def count_of(c: Column, characters: str) -> Column:
    """How many characters of a class c has."""
    return F.length(c) - F.length(F.regexp_replace(c, characters, ""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the edges."""
    return F.btrim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def trimmed_text(c: Column, limit: int = EXCERPT) -> Column:
    """NULs as spaces, white space squeezed, cut at limit, stripped: of texts whose entities are decoded, as rules get them."""
    return F.rtrim(F.substring(squeeze(F.translate(text_of(c), "\x00", " ")), 1, limit))


def clean_text(c: Column, limit: int = EXCERPT) -> Column:
    """trimmed_text with entities decoded: for texts as they come from outside."""
    return trimmed_text(unescape(c), limit)


def strip_markup(c: Column) -> Column:
    """Script and style elements, then all tags, as spaces."""
    return F.regexp_replace(F.regexp_replace(text_of(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), r"<[^>]+>", " ")


def clean_description(c: Column, limit: int = EXCERPT) -> Column:
    """Without CDATA marks, markup, links and what follows an advert's opening on the last line; entities are decoded before and after that."""
    t = F.replace(F.replace(unescape(text_of(c)), F.lit("<![CDATA["), F.lit(" ")), F.lit("]]>"), F.lit(" "))
    t = F.regexp_replace(strip_markup(t), rf"(?iU)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+", " ")
    return clean_text(F.regexp_replace(t, rf"(?id)(?:{ADVERT}).*$", " "), limit)


def short_description(c: Column, limit: int = DISPLAY) -> Column:
    return let(clean_description(c, limit + 1), lambda t: F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), rf"(?U){SPACE}+\z", ""), F.lit("…"))).otherwise(t))


def format_bytes(c: Column) -> Column:
    """B as a whole number, KB to TB with one decimal (half to even), steps of 1024."""
    size = F.coalesce(c.cast("double"), F.lit(0.0))
    out = F.concat(F.floor(size).cast("string"), F.lit(" B"))
    text = F.when(size < 1024, out)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        shown = F.concat(F.format_string("%.1f", F.bround(size / float(1024**power), 1)), F.lit(f" {unit}"))
        text = text.otherwise(shown) if unit == "TB" else text.when(size < float(1024 ** (power + 1)), shown)
    return text


def clean_title(c: Column) -> Column:
    """A title candidate: underscores as spaces, navigation words and a section number before it gone, edges stripped."""
    t = F.regexp_replace(trimmed_text(c, 180), "_+", " ")
    t = F.regexp_replace(t, rf"(?U)^(?:(?:{NAVIGATION})\s*[>＞:：|｜\\/\-]*\s*)+", "")
    t = F.regexp_replace(t, r"(?U)^第\s*\d+\s*节[:：]\s*", "")
    return F.btrim(t, F.lit(TITLE_EDGES))


def clean_author(c: Column) -> Column:
    t = F.replace(F.replace(trimmed_text(c, 180), F.lit("#91;"), F.lit("[")), F.lit("#93;"), F.lit("]"))
    return F.btrim(F.regexp_replace(t, r"(?iU)^(作者|author)[:：]\s*", ""), F.lit(AUTHOR_EDGES))


def clean_authors(c: Column) -> Column:
    """Without roles and bracketed parts."""
    t = F.regexp_replace(trimmed_text(c, 180), r"(?U)(著者|作者|译者|编者|主编|校注|点校)\s*[:：]", "")
    t = F.regexp_replace(t, r"\[[^\]]+\]|【[^】]+】|（[^）]+）|\([^)]*\)", " ")
    return F.btrim(F.regexp_replace(t, rf"(?U){SPACE}+", " "), F.lit(" ;,，、/"))


def primary_author(c: Column) -> Column:
    return F.btrim(F.regexp_extract(clean_authors(c), r"^([^;,，、/；]*)", 1))


def normalize_title(c: Column) -> Column:
    """Lower case, word characters only."""
    return F.regexp_replace(F.lower(text_of(c)), r"(?U)[^\w一-鿿]+", "")


def compact(c: Column) -> Column:
    """Word characters only, case kept."""
    return F.regexp_replace(text_of(c), r"(?U)[^\w一-鿿]+", "")


def normalize_match_text(c: Column) -> Column:
    """What two titles or authors must share to be the same."""
    return F.regexp_replace(F.lower(text_of(c)), rf"(?U){SPACE}|[{MATCH_PUNCTUATION}]", "")


def append_value(existing: Column, value: Column) -> Column:
    """``a; b``, unless a contains b."""
    return F.when(existing == "", value).when(F.contains(existing, value), existing).otherwise(F.concat(existing, F.lit("; "), value))


def join_values(values: Column) -> Column:
    """append_value over an array."""
    return F.aggregate(F.filter(values, lambda v: v != ""), F.lit(""), append_value)


def isbn_shape(c: Column) -> Column:
    return F.length(F.regexp_replace(text_of(c), "[^0-9Xx]", "")).isin(10, 13)


def safe_filename(c: Column) -> Column:
    """Characters that some systems forbid in file names, as underscores."""
    return F.translate(text_of(c), FORBIDDEN_IN_NAMES, "_" * len(FORBIDDEN_IN_NAMES))


def safe_relative_path(c: Column) -> Column:
    """A full path as one below another folder: drive and parts, each a safe name; no part is ``.`` or ``..``."""
    parts = F.filter(F.split(text_of(c), r"[/\\]+"), lambda p: (p != "") & (p != ".") & (p != ".."))
    return F.array_join(F.transform(parts, safe_filename), "/")


def numeric_text(c: Column) -> Column:
    """A text's numeric prefix as a number, 0 without one; null for ''."""
    prefix = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(c != "", F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def decode_link(c: Column) -> Column:
    """The target of a redirecting link (its url argument), else the link."""
    target = F.try_url_decode(F.regexp_extract(text_of(c), r"[?&]url=([^&#]+)", 1))
    return F.when(text_of(c) == "", F.lit("")).otherwise(F.coalesce(F.nullif(target, F.lit("")), text_of(c)))


def simple_description(title: Column, authors: Column, tags: Column, ext: Column) -> Column:
    """The placeholder made of title, up to three tags, authors and format."""
    useful = F.array_join(F.slice(F.filter(tags, lambda t: (t != "") & (t != "未分类")), 1, 3), "、")
    named = F.coalesce(F.nullif(trimmed_text(title, 120), F.lit("")), F.lit("这本书"))
    kind = let(useful, lambda u: F.when(u != "", F.concat(u, F.lit("类"))).otherwise("本地"))
    by, form = trimmed_text(authors, 120), F.upper(F.regexp_replace(text_of(ext), r"^\.+", ""))
    return F.concat(F.lit("《"), named, F.lit("》是一本"), kind, F.lit("电子书"), let(by, lambda b: F.when(b != "", F.concat(F.lit("，作者为 "), b)).otherwise("")), F.when(text_of(ext) != "", F.concat(F.lit("，本地文件格式为 "), form)).otherwise(""), F.lit("。"))


def description_quality(c: Column) -> Column:
    """Length up to 240, plus 20 with CJK, plus 10 with a sentence mark, less 25 if short, less 80 for a placeholder."""
    def score(t: Column) -> Column:
        plus = F.least(F.length(t), F.lit(240)) + F.when(has_cjk(t), 20).otherwise(0) + F.when(t.rlike("[。！？.!?]"), 10).otherwise(0)
        minus = F.when(F.length(t) < 20, 25).otherwise(0) + F.when(t.rlike("本地文件格式为|是一本本地电子书"), 80).otherwise(0)
        return F.when(t == "", F.lit(0)).otherwise(plus - minus)

    return let(strip(text_of(c)), score)
