"""Tags from a fixed vocabulary: normalising, inferring, merging and refining, as Column expressions over arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, has_cjk, let, squeeze, text_of

# Labels with their keywords, subject fragments with their labels, and the evidence that tags need.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "小说": ("小说", "fiction", "novel", "故事", "长篇", "中篇", "短篇", "爱情", "青春", "童话", "小说集", "中短篇", "穿越", "公主"),
    "文学": ("文学", "literature", "散文", "随笔", "诗歌", "poetry", "prose", "儿童文学", "经典文学", "鲁迅", "眷村"),
    "历史": ("历史", "history", "史记", "世界史", "中国史", "近代史", "古代", "晚近", "战争", "开国", "百家争鸣", "帝国", "档案", "阵亡"),
    "科幻": ("科幻", "science fiction", "sci-fi", "sf", "未来", "星际", "银河"),
    "推理": ("推理", "悬疑", "侦探", "mystery", "detective", "crime", "thriller"),
    "玄幻": ("玄幻", "奇幻", "fantasy", "魔法", "修真", "武侠", "仙侠"),
    "经济": ("经济", "economics", "宏观", "微观", "市场", "贸易", "财经", "企业家", "企业", "商业"),
    "金融": ("金融", "finance", "投资", "股票", "基金", "债券", "银行", "证券", "股价", "上市公司", "黑庄"),
    "管理": ("management", "领导力", "组织管理", "创业", "商业", "运营", "企业家", "企业管理", "项目管理", "战略管理", "财务管理", "人力资源"),
    "心理": ("心理", "psychology", "认知", "情绪", "人格", "咨询"),
    "哲学": ("哲学", "philosophy", "伦理", "形而上", "逻辑", "存在主义"),
    "社科": ("社会学", "sociology", "politics", "政治", "人类学", "传播", "文化研究", "日本", "知日"),
    "计算机": ("计算机", "computer", "software", "编程", "程序", "算法", "python", "java", "javascript", "linux", "数据库", "人工智能"),
    "教育": ("教育", "education", "学习", "教学", "课程", "考试", "教材"),
    "医学": ("医学", "medical", "medicine", "临床", "护理", "药学"),
    "法律": ("法律", "law", "法学", "司法", "合同", "宪法", "民法", "刑法"),
    "传记": ("传记", "biography", "memoir", "回忆录", "自传", "生平", "名人传"),
    "艺术": ("艺术史", "艺术学", "art", "设计", "美术", "摄影", "音乐", "电影", "戏剧"),
    "旅行": ("旅行", "旅游", "travel", "地理", "游记", "指南"),
    "育儿": ("育儿", "亲子", "家庭教育", "parenting", "child development"),
    "儿童读物": ("儿童文学", "童话", "少儿读物", "children's literature", "fairy tale"),
    "外语": ("英语", "外语", "language", "grammar", "vocabulary", "ielts", "toefl"),
    "国学": ("国学", "儒家", "道家", "佛学", "易经", "论语", "古文"),
    "自然科学": ("自然科学", "science", "物理", "化学", "生物", "数学", "天文", "地质"),
    "生活": ("家居", "美食", "烹饪", "养生", "情感", "爱情"),
    "职场": ("职场", "求职", "简历", "面试", "职业规划", "职业发展", "工作效率", "办公室", "时间管理", "沟通技巧", "压力管理"),
    "语言文字": ("语言文字", "汉字", "词源", "训诂", "语文", "写作"),
    "神话民俗": ("神话", "民俗", "传说", "山海经", "妖怪", "志怪"),
}
SUBJECTS: dict[str, str] = {
    "business": "管理", "children": "育儿", "computer": "计算机", "economics": "经济", "education": "教育", "fantasy": "玄幻", "fiction": "小说",
    "finance": "金融", "history": "历史", "language": "外语", "law": "法律", "literature": "文学", "medical": "医学", "mystery": "推理", "myth": "神话民俗",
    "philosophy": "哲学", "psychology": "心理", "science fiction": "科幻", "science": "自然科学", "social": "社科", "travel": "旅行",
}
#: Phrases in which a keyword doesn't count.
BLANKED = {"历史": "历史记录|历史纪录|浏览历史|操作历史|未来的历史", "史记": "历史记录|历史纪录|出版史记录|版本史记录"}
LITERARY = ("小说", "文学", "文集", "散文", "诗歌", "作家", "鲁迅", "莫言", "短篇", "中篇", "长篇")
BIOGRAPHY = ("传记", "biography", "memoir", "回忆录", "自传", "生平", "名人传")
CAREER = ("职场", "求职", "简历", "面试", "职业规划", "职业发展", "工作效率", "办公室", "时间管理", "沟通技巧", "压力管理")
PARENTING = ("育儿", "亲子", "家庭教育", "父母课堂", "parenting", "child development")
MANAGEMENT = ("管理学", "企业管理", "项目管理", "战略管理", "财务管理", "运营管理", "组织管理", "人力资源", "领导力")
#: Tags that a literary work keeps only if its title has one of these.
TITLE_EVIDENCE: dict[str, tuple[str, ...]] = {
    "艺术": ("艺术", "美术", "摄影", "音乐", "电影", "戏剧", "设计"),
    "语言文字": ("语言", "汉字", "词源", "训诂", "语文", "写作"),
    "历史": ("历史", "史略", "世界史", "中国史", "近代史", "古代史", "战争史"),
    "社科": ("社会学", "政治", "社科", "人类学", "文化研究"),
    "医学": ("医学", "临床", "护理", "药学", "中医"),
    "自然科学": ("科学", "物理", "化学", "生物", "数学", "天文", "地质"),
    "教育": ("教育", "教学", "教材", "课程", "考试"),
    "旅行": ("旅行", "旅游", "游记", "地理", "指南"),
    "经济": ("经济", "财经", "贸易", "商业"),
    "法律": ("法律", "法学", "司法", "民法", "刑法"),
    "金融": ("金融", "投资", "股票", "基金", "银行"),
}
WORK_TITLES, WORK_AUTHORS = ("呐喊", "吶喊", "鲁迅呐喊", "魯迅吶喊"), ("鲁迅", "魯迅")

NO_TAGS = "cast(array() as array<string>)"


def any_of(c: Column, words: Sequence[str]) -> Column:
    """Whether c contains one of the words: one pass of an alternation."""
    return c.rlike("|".join(map(re.escape, words)))


def normalize_tag(c: Column) -> Column:
    """A label: of the first subject fragment in the tag, else the first label that it contains, else ''."""
    def label_of(s: Column) -> Column:
        """Of struct(t, low)."""
        out = F.when(s["t"] == "", F.lit(""))
        for fragment, label in SUBJECTS.items():
            out = out.when(F.contains(s["low"], F.lit(fragment)), F.lit(label))
        for label in KEYWORDS:
            out = out.when(F.contains(s["t"], F.lit(label)), F.lit(label))
        return out.otherwise(F.lit(""))

    return let(F.btrim(squeeze(text_of(c)), F.lit(".,;:，。；：/\\|")), lambda t: let(F.struct(t.alias("t"), F.lower(t).alias("low")), label_of))


def _kinds(keywords: Sequence[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    """The keywords that are ASCII words, several ASCII words, other ASCII texts, and those in other scripts, which all have CJK characters."""
    words = [k for k in keywords if re.fullmatch("[a-z0-9]+", k)]
    phrases = [k for k in keywords if k not in words and re.fullmatch(r"[a-z0-9 +#.-]+", k)]
    rest = [k for k in keywords if k not in (*words, *phrases)]
    return words, phrases, [k for k in rest if k.isascii()], [k for k in rest if not k.isascii()]


def _parts(text: Column, keywords: Sequence[str]) -> Column:
    """What all the keywords are looked up in, worked out once: the text, which of them are among its ASCII words, whether one in another script occurs.

    So most texts are done after one pass, and the keywords of a label are looked up among the few words found.
    """
    words, _, _, wide = _kinds(keywords)

    def looked_up(x: Column) -> Column:
        own = F.array_intersect(F.split(x, "[^a-z0-9]+"), F.array(*map(F.lit, words)).cast("array<string>"))
        some = F.when(has_cjk(x), any_of(x, wide)).otherwise(False) if wide else F.lit(False)
        return F.struct(x.alias("text"), own.alias("words"), some.alias("wide"))

    return let(text, looked_up)


def _hit(x: Column, keywords: Sequence[str]) -> Column:
    """Whether the text of _parts has one of the keywords.

    An ASCII word is one of the text's words; one of several words is searched between other characters; keywords in other
    scripts are searched anywhere, and only in texts that have some.
    """
    words, phrases, narrow, wide = _kinds(keywords)
    hits = [F.arrays_overlap(x["words"], F.array(*map(F.lit, words)))] if words else []
    hits += [F.contains(x["text"], F.lit(k)) & x["text"].rlike(f"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])") for k in phrases]
    hits += [F.contains(x["text"], F.lit(k)) for k in narrow]
    plain = [k for k in wide if k not in BLANKED]
    others = [any_of(x["text"], plain)] if plain else []
    others += [F.contains(F.regexp_replace(x["text"], BLANKED[k], " "), F.lit(k)) for k in wide if k in BLANKED]
    if others:
        hits.append(x["wide"] & reduce(or_, others))
    return reduce(or_, hits)


def keyword_hit(text: Column, keywords: Sequence[str]) -> Column:
    """Whether lower-case text has one of the keywords: ASCII ones not between other letters or digits, others anywhere."""
    return let(_parts(text, keywords), lambda x: _hit(x, keywords))


def infer_tags(*parts: Column, subjects: Column | None = None, limit: int = 10) -> Column:
    """Labels whose keywords the parts have, in vocabulary order, then the subjects' labels."""
    text = F.lower(F.concat_ws(" ", *(F.nullif(text_of(p), F.lit("")) for p in parts)))
    found = let(_parts(text, [k for words in KEYWORDS.values() for k in words]), lambda x: F.filter(F.array(*(F.when(_hit(x, words), F.lit(label)) for label, words in KEYWORDS.items())), lambda t: t.isNotNull()))
    if subjects is not None:
        found = F.array_distinct(F.concat(found, _normalized(subjects)))
    return F.slice(found, 1, limit)


def _normalized(tags: Column) -> Column:
    return F.filter(F.transform(F.coalesce(tags, F.expr(NO_TAGS)), normalize_tag), lambda t: t != "")


def merge_tags(*groups: Column, limit: int = 6) -> Column:
    """Normalised tags of all groups, first seen first; 社科 gives way to 小说."""
    merged = F.array_distinct(_normalized(F.concat(*(F.coalesce(g, F.expr(NO_TAGS)) for g in groups))))
    return _settled(merged, limit)


def _settled(tags: Column, limit: int) -> Column:
    return F.slice(let(tags, lambda x: F.when(F.array_contains(x, "小说"), F.array_remove(x, "社科")).otherwise(x)), 1, limit)


def refine_tags(title: Column, authors: Column, description: Column, tags: Column) -> Column:
    """Merged tags without those for which title, authors and description give no evidence."""
    work = F.array(F.lit("小说"), F.lit("文学"))

    def known_work(x: Column) -> Column:
        """Tags of struct(title, authors, merged): of a known work, fiction and literature come first."""
        known = compact(x["title"]).isin(*WORK_TITLES) & any_of(x["authors"], WORK_AUTHORS)
        return F.when(known, _settled(F.array_distinct(F.concat(work, x["merged"])), 6)).otherwise(x["merged"])

    def refined(x: Column) -> Column:
        """Of struct(title, description, text, literary, merged)."""
        title, text, literary = x["title"], x["text"], x["literary"]
        drops = {
            "传记": ~any_of(text, BIOGRAPHY),
            "职场": ~any_of(F.when(literary, title).otherwise(text), CAREER),
            "育儿": ~any_of(F.lower(F.concat_ws(" ", title, F.substring(x["description"], 1, 240))), PARENTING),
            "管理": literary & ~any_of(text, MANAGEMENT),
            **{tag: literary & ~any_of(title, words) for tag, words in TITLE_EVIDENCE.items()},
        }
        return F.array_except(x["merged"], F.filter(F.array(*(F.when(drop, F.lit(tag)) for tag, drop in drops.items())), lambda t: t.isNotNull()))

    def literary(x: Column) -> Column:
        """What counts as literary is settled before tags are dropped; only 传记 may go before, and it doesn't matter for that."""
        return F.array_contains(x["merged"], "小说") | F.array_contains(x["merged"], "文学") | any_of(x["text"], LITERARY)

    first = F.struct(text_of(title).alias("title"), text_of(authors).alias("authors"), text_of(description).alias("description"), merge_tags(tags).alias("merged"))
    step = let(first, lambda x: F.struct(x["title"].alias("title"), x["description"].alias("description"), F.lower(F.concat_ws(" ", x["title"], x["authors"], x["description"])).alias("text"), known_work(x).alias("merged")))
    step = let(step, lambda x: F.struct(x["title"].alias("title"), x["description"].alias("description"), x["text"].alias("text"), x["merged"].alias("merged"), literary(x).alias("literary")))
    return let(step, refined)
