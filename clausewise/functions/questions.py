"""Column functions over questions and answers: keywords of a question, items of a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.text import collapsed

# Words around a question's topic.
REQUESTS = ("请帮我", "请帮忙", "请讲解", "请解释", "请介绍", "请说明", "请分析", "讲述一下", "介绍一下", "讲一下", "说一下", "告诉我", "想了解", "请问", "麻烦", "帮我", "帮忙", "讲解", "解释", "介绍", "说明", "分析", "阐述", "简述", "聊聊", "谈谈", "说说", "讲述", "请")
ACTIONS = ("创建", "制定", "建立", "新增", "编写", "起草", "设立")
ENDINGS = "(?:是什么|是啥|有哪些|有何|有什么|吗|呢|吧)$"
TAILS = "(?:都?(?:包括|包含)(?:哪些|什么)(?:步骤|内容|环节|方面)?|都?有哪些(?:步骤|内容|环节|方面)?|的?(?:步骤|内容|流程)有哪些)$"
CONNECTIVES = "以及|并且|或者|有关|关于|针对|对|之|及|与|和|并|或|、|/"
GENERIC = ("合法", "合规", "原则", "制度", "规范", "管理", "流程", "材料", "要求", "事项", "审查")
STOPS = ("是什么", "是啥", "有什么", "有何", "有哪些", "什么", "吗", "呢", "吧", "请问", "请讲解", "讲解", "解释", "说明")
FOCUS = ("思想", "原则", "目的", "范围", "条件", "职责", "依据", "流程", "步骤", "要求", "定义", "概念", "内涵", "要点", "要义", "标准", "权限", "机制", "办法", "制度", "规则", "条款")
DEFAULT = "合规审查"
MOST = 8


def asked(c: Column) -> Column:
    """The question in one line, without its closing mark."""
    return F.regexp_replace(collapsed(c), "[。！？!?]+$", "")


def without_requests(c: Column) -> Column:
    """Without the words of asking before the topic, as long as something is left."""
    return F.trim(F.regexp_replace(c, f"^(?:(?:{'|'.join(REQUESTS)})\\s*)+(?=.)", ""))


def without_action(c: Column) -> Column:
    """Without one verb of making before the topic, if two characters or more are left."""
    return F.regexp_replace(c, f"^(?:{'|'.join(ACTIONS)})(?=..)", "")


def without_tail(c: Column) -> Column:
    """Without what makes a question of a topic at its end."""
    out = F.trim(F.regexp_replace(c, ENDINGS, ""))
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, TAILS, ""))
    return out


def topics(c: Column) -> Column:
    """A topic, and without a closing word for work, matters or procedures."""
    t = without_tail(c)
    return F.array(t, F.regexp_replace(t, "(?<=.)(?:工作|事项|流程)$", ""))


def focus_phrases(c: Column) -> Column:
    """Runs of ideographs, and their last parts between particles, that end in a word for rules, duties and the like."""
    runs = F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]{2,24}"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(without_requests(without_tail(r))), F.slice(F.reverse(F.filter(F.split(r, "[的之关于针对]"), lambda p: p != "")), 1, 2))))
    return F.filter(F.transform(parts, lambda p: without_requests(without_tail(p))), lambda p: p.rlike(f"(?:{'|'.join(FOCUS)})$"))


def keywords(c: Column) -> Column:
    """Up to eight different keywords of a question, whole topics first; a default if nothing says anything."""
    q = asked(c)
    bare = without_requests(q)
    act = without_action(bare)
    pieces = F.flatten(F.transform(F.filter(F.split(bare, "[，,。；;、!?！？\\s]+"), lambda s: s != ""), lambda s: F.concat(F.array(without_tail(s)), F.transform(F.split(without_tail(s), CONNECTIVES), without_tail))))
    found = F.concat(F.array(q, bare, without_tail(bare), act, without_tail(act)), topics(q), topics(bare), topics(act), F.transform(F.split(without_tail(bare), CONNECTIVES), without_tail), focus_phrases(q), focus_phrases(act), pieces)
    good = F.filter(F.array_distinct(F.transform(found, F.trim)), lambda k: (F.char_length(k) >= 2) & ~k.isin(*GENERIC, *STOPS))
    return F.when(F.size(good) > 0, F.slice(good, 1, MOST)).otherwise(F.array(F.lit(DEFAULT)))


def is_multiple(c: Column) -> Column:
    """Whether a text asks more than one thing."""
    t = F.coalesce(c, F.lit(""))
    return (F.regexp_count(t, F.lit("[？?]")) >= 2) | (t.rlike("以及|并且|同时") & t.rlike("什么|哪些|哪种|哪两种|包括"))


def numbered_items(c: Column) -> Column:
    """The different items of a text numbered '1. … 2. …', without closing marks; fewer than two give none."""
    found = F.regexp_extract_all(collapsed(c), F.lit("\\d+\\.\\s*(.+?)(?=\\s+\\d+\\.\\s*|$)"), F.lit(1))
    clean = F.transform(found, lambda x: F.regexp_replace(x, "^[ ;；。]+|[ ;；。]+$", ""))
    items = F.array_distinct(F.filter(clean, lambda x: F.char_length(x) >= 2))
    return F.when((F.size(found) >= 2) & (F.size(items) >= 2), items).otherwise(F.array().cast("array<string>"))


def list_parts(c: Column) -> Column:
    """The different parts of a text that lists things: by semicolons, else by two full stops or more, else by two enumeration commas or more."""
    body = F.regexp_replace(collapsed(c), "^[。；;]+|[。；;]+$", "")
    by = F.when(body.rlike("[；;]"), F.split(body, "[；;]")).when(F.regexp_count(body, F.lit("。")) >= 2, F.split(body, "。")).when(F.regexp_count(body, F.lit("、")) >= 2, F.split(body, "、")).otherwise(F.array().cast("array<string>"))
    clean = F.transform(by, lambda x: F.regexp_replace(F.regexp_replace(x, "^[：:，,。；; ]+|[：:，,。；; ]+$", ""), "^\\s*(?:\\d+[.、)]|[(（]?[一二三四五六七八九十]{1,3}[、.)）])\\s*", ""))
    return F.array_distinct(F.filter(clean, lambda x: F.char_length(x) >= 2))
