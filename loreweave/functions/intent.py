"""Intent of a query, by rule tables and an ordered CASE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import no_letters_or_digits, normalise, strip

LONGEST = 2000


@dataclass(frozen=True)
class Rule:
    """Every keyword in the text and every pattern that is found adds weight."""

    weight: float
    keywords: tuple[str, ...]
    patterns: tuple[str, ...]

    def score(self, text: Column) -> Column:
        tests = [text.contains(k.lower()) for k in self.keywords] + [text.rlike(p) for p in self.patterns]
        return F.round(sum((t.cast("int") for t in tests[1:]), tests[0].cast("int")) * self.weight, 6)

    def matched(self, text: Column) -> Column:
        """What the score adds up: each keyword as kw:..., and each pattern, by its first 30 characters, as pat:..."""
        found = [F.when(text.contains(k.lower()), f"kw:{k}") for k in self.keywords] + [F.when(text.rlike(p), f"pat:{p[:30]}") for p in self.patterns]
        return F.array_compact(F.array(*found))


# The rule tables.
GREETING = Rule(
    1.0,
    ("你好", "您好", "hi", "hello", "hey", "嗨", "哈喽", "早上好", "中午好", "下午好", "晚上好", "早安", "晚安", "在吗", "在么", "在不在", "在么？"),
    (r"^你好[呀啊哇呢]*[!！.。?？\s]*$", r"^(hi|hello|hey)[!！.。?？\s]*$", r"^在[吗么呢]*[?？!！.。\s]*$"),
)
CHITCHAT = Rule(
    0.8,
    ("哈哈", "呵呵", "嘻嘻", "嘿嘿", "嗯嗯", "好的", "收到", "再见", "拜拜", "bye", "ok"),
    (r"^[哈呵嘻嘿嗯哦唔]{2,}$", r"^(好的|收到|ok|OK|好的好的)$", r"^(再见|拜拜|bye)[!！.。\s]*$"),
)
META = Rule(
    1.2,
    ("多少篇", "多少个", "统计", "分类列表", "分类", "哪些文档", "列出", "清单", "几个文档", "总共有", "一共有", "共多少"),
    (r"(多少|几)(篇|个|条|份)?(文档|资料|文件|分类)", r"(列出|展示|看看).*?(文档|分类|列表|清单)", r"^(知识库里|库中|库里).{0,10}(有|包含)", r"^.{0,5}有(哪|什么)些\s*(文档|资料|文件|分类|内容)"),
)
FAQ = Rule(
    1.0,
    (
        "本系统", "这个系统", "该系统", "系统如何", "如何用", "怎么用", "如何使用", "使用教程", "使用指南", "使用说明", "使用手册", "使用帮助", "功能介绍", "使用介绍", "系统介绍", "功能说明",
        "操作指南", "操作手册", "操作说明", "操作教程", "能做什么", "有什么功能", "可以做什么", "能做啥", "你是谁", "你是什么", "你能做什么", "你会什么",
    ),
    (
        r"^(介绍|了解|认识).*?(知识库|系统|平台|工具|你|您)", r"^(什么是|啥是|啥叫)", r"^你(是什么|是谁|能做什么|有什么功能|叫什么)", r"^(系统|平台|工具|知识库).*?(能做|可以|功能|能力)", r"^(帮助|help|使用教程|使用指南)$",
        r"^(怎么|如何)(用|使用|操作|上手)", r"(本系统|本平台|这个系统|该系统|这套系统)", r"^(这个|该|本).*?(知识库|系统|平台|工具).*?(介绍|是什么|功能|能力)", r"(知识库|系统|平台|工具).*?(介绍|说明|简介|概览)",
        r"^介绍一下\s*(本|这个|该|当前|我的)?\s*(知识库|系统|平台|工具|应用|软件|产品)\s*[?？。!！]?$",
    ),
)
NEGATION = Rule(
    1.5,
    (
        "不是要", "不是问", "不是该", "不要", "拒绝", "算了", "我让你", "我让你介绍", "我要的是", "我要的不是", "我说的是", "不是说", "我要看的是", "我关心的是", "我说的是",
        "说的是", "想问的是", "想问的", "请回答", "看清楚", "你没听懂", "没听懂", "听不懂", "懂了吗", "懂了吗？", "看清楚问题", "看清楚了吗",
    ),
    (
        r"^(我|请|麻烦|要|要你).*?(不要|不是|拒绝)", r"^(我|请).*?(说|问|介绍|关心|要|想)", r"(我|要|请).{0,20}(说|问|想|关心|要)的(是|就是)", r"(看清楚|看仔细|听清楚|听懂).{0,10}(问题|问的|要)",
        r"^(我|请).{0,10}(让你|要你|希望你).*?(介绍|回答|说|讲)", r"^(我让你|我要|我想).*?(介绍|回答|讲|说说)", r"(我|要).{0,5}(让你|要你).{0,15}(介绍|回答|说).{0,15}(而|不|别)",
        r"(不是|而非|不|没|未).{0,5}(该|本|这个).{0,5}(系统|平台|工具)", r"你没.{0,5}(听懂|理解|明白|搞清楚)", r"(没|没有).{0,5}(听懂|理解|明白)",
    ),
)
OUT_OF_SCOPE = Rule(
    0.9,
    ("天气预报", "今天星期几", "现在是几点", "几点了", "汇率", "股票", "比特币"),
    (
        r"^(今天|明天|昨天|今晚|明早).{0,8}(天气|星期|几点|日期|会.*?雨|晴|阴|雪)", r"^(现在|今天|明天).{0,8}(几[点号]|什么时间)", r"(会|能).{0,3}(下雨|下雪|晴天|阴天)",
        r"^(什么|多少)(时候|时间)", r"^(汇率|股票|比特币|黄金|油价)", r"(穿着|穿什么|该穿)",
    ),
)
META_FIRST = (
    r"^(介绍|了解|认识|说说|看看).{0,5}(本|我的|这个|该|当前|现有)?(知识库|资料库|文档库|文档集|知识集)",
    r"^(本|我的|这个|该|当前|现有)?(知识库|资料库|文档库).{0,8}(介绍|有什么|有哪些|内容|知识|资料)",
    r"^(我)?(上传|收录|存储|导入)的?.*?(内容|文档|资料|知识)",
    r"^(我)?(的)?知识库里.{0,5}有",
    r"^(本|我的|现有|当前)?(知识库|资料库).{0,5}(有|包含).{0,5}(什么|哪些|啥)",
)
CONTENT_FIRST = (
    r"^什么是\s*\S+",
    r"^.{0,8}的?(原理|核心|组件|模块|区别|对比|实现|工作流|架构)",
    r"^(介绍|解释|说说).{0,10}(核心|原理|组件|架构|实现)",
    r"^介绍一下\s+(?!本|这个|该|当前|我的|知识库|系统|平台|工具|应用|软件|产品)\S+",
)
FOLLOW_UP = (
    "具体的呢?", r"具体.*?(呢|呢？|说说|讲讲|呢\?|怎么|为啥|为什么|如何)", "详细说说?", "详细点", "再说说", "为什么", "什么意思", "举个例子", "展开", "深入", "接着说", "然后呢", "还有呢",
    "怎么说", "怎么理解", "如何操作", "怎么做", "步骤是什么",
)
PRONOUNS = ("[它他她这那]个?", "[它他她这那]些?", "[它他她这那]种?", "上面", "之前", "刚才", "上文")
NO_FOLLOW_UP = (r"^(介绍|了解|认识).*?(知识库|系统|平台|工具|你|您)", r"^(什么是|啥是|啥叫)", r"^你(是什么|是谁|能做什么|有什么功能)", r"^(系统|平台|工具|知识库).*?(能做|可以|功能|能力)", r"^(帮助|help|使用教程|使用指南)$")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def follow_up(query: Column, has_history: Column) -> Column:
    """A question on what was said before, unless it asks for something of its own."""
    q = strip(query)
    return has_history & ~any_of(q, NO_FOLLOW_UP) & (any_of(q, PRONOUNS) | any_of(q, FOLLOW_UP))


def follow_up_legacy(query: Column, has_history: Column) -> Column:
    q = strip(query)
    return has_history & ((F.length(q) < 10) | any_of(q, FOLLOW_UP) | any_of(q, PRONOUNS))


def intent(query: Column, has_history: Column | None = None) -> Column:
    """struct<intent, confidence> of a query; null is empty."""
    query = F.coalesce(query, F.lit(""))
    rules = {"negation": NEGATION, "greeting": GREETING, "chat": CHITCHAT, "meta": META, "faq": FAQ, "outside": OUT_OF_SCOPE}
    history = F.lit(False) if has_history is None else has_history
    result = lambda name, confidence: F.struct(F.lit(name).alias("intent"), F.round(confidence, 4).alias("confidence"))
    up_to = lambda most, base, score, by: F.least(F.lit(most), base + score * by)

    def scored(text: Column) -> Column:
        tests = {"meta_first": any_of(text, META_FIRST), "content_first": any_of(text, CONTENT_FIRST), "odd": no_letters_or_digits(query), "empty": strip(query) == "", "follow_up": follow_up(query, history)}
        return F.struct(*(r.score(text).alias(k) for k, r in rules.items()), *(v.alias(k) for k, v in tests.items()))

    def decided(s: Column) -> Column:
        return (
            F.when(s["empty"], result("chitchat", F.lit(0.99)))
            .when(s["odd"], result("chitchat", F.lit(0.95)))
            .when(s["negation"] > 0, result("negation", up_to(0.95, 0.6, s["negation"], 0.1)))
            .when((s["greeting"] > 0) & (s["greeting"] >= s["chat"]), result("greeting", up_to(0.95, 0.5, s["greeting"], 0.15)))
            .when(s["chat"] > 0, result("chitchat", up_to(0.9, 0.4, s["chat"], 0.15)))
            .when(s["follow_up"], result("followup", F.lit(0.75)))
            .when(s["meta_first"], result("meta_query", F.lit(0.92)))
            .when((s["faq"] > 0) & s["content_first"], result("kb_content", F.lit(0.65)))
            .when(s["faq"] > 0, result("system_faq", up_to(0.95, 0.5, s["faq"], 0.1)))
            .when(s["meta"] > 0, result("meta_query", up_to(0.95, 0.5, s["meta"], 0.1)))
            .when(s["outside"] > 0, result("out_of_scope", up_to(0.85, 0.4, s["outside"], 0.15)))
            .otherwise(result("kb_content", F.lit(0.5)))
        )

    # Each transform binds a value once; inlined, the rules would outgrow a generated method.
    text = F.array(normalise(F.substring(query, 1, LONGEST)))
    return F.get(F.transform(F.transform(text, scored), decided), 0)
