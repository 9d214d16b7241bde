"""Column functions over text: cleaning, comparison forms, numerals, references, labels.

All are built from SQL functions, null in means null or empty out as said, and Unicode classes are
switched on where blanks or digits of any script count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "\\u4e00-\\u9fff"
NUMERAL = "一二三四五六七八九十百千万零〇两\\d"
#: Values of numerals and of units in Chinese numbers (fixed values).
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
#: Texts that count as no content, of chunks and of lines (fixed values).
EMPTY_BODIES, EMPTY_LINES = (".", "。", "-", "…"), (".", "。", "-", "—")


def stripped(c: Column) -> Column:
    """Without blanks of any kind at the ends; null gives ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)^\\s+|(?<!\\s)\\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def comparison_form(c: Column, kept: str = "_") -> Column:
    """Lower case, nothing but ideographs, a-z, 0-9 and what else is kept; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{HAN}a-z0-9{kept}]+", "")


def compact_form(c: Column) -> Column:
    """Nothing but letters, digits and underscores of any script, in their own case; null gives ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\W", "")


def shortened(c: Column, limit: int) -> Column:
    """The collapsed text, cut to `limit` characters with '...' behind if it was longer."""
    s = collapsed(c)
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def document_text(c: Column) -> Column:
    """Without runs of three or more dots, dashes or underscores and lines that are a number; hard spaces as spaces, at most one blank line, none at the ends."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[.\\-_]{3,}", "")
    s = F.regexp_replace(s, "(?mU)^\\d+\\s*$", "")
    s = F.replace(F.replace(s, F.lit("&nbsp;"), F.lit(" ")), F.lit(" "), F.lit(" "))
    return stripped(F.regexp_replace(s, "\\n{3,}", "\n\n"))


def newline_form(c: Column) -> Column:
    """Line feeds only, at most one blank line, no blanks at the ends."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n")
    return stripped(F.regexp_replace(s, "\\n{3,}", "\n\n"))


def is_empty_body(c: Column, empty: tuple[str, ...] = EMPTY_BODIES) -> Column:
    """Whether a content says nothing."""
    s = stripped(c)
    return (s == "") | s.isin(*empty)


def content_hash(c: Column) -> Column:
    """SHA-256 as hex; '' of the empty text, null of null."""
    return F.when(c == "", F.lit("")).otherwise(F.sha2(c, 256))


def tokens(c: Column) -> Column:
    """Different tokens in order: runs of 2 to 14 ideographs, or of 3 to 24 of a-z, 0-9 and underscore."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[{HAN}]{{2,14}}|[a-z0-9_]{{3,24}}"), F.lit(0)))


def numeral_value(c: Column) -> Column:
    """The number that a Chinese or Arabic numeral writes; 0 for anything else."""
    state = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("digit"), F.lit(True).alias("ok"))
    digits = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])

    def step(s: Column, ch: Column) -> Column:
        d, u = digits[ch].cast("bigint"), units[ch].cast("bigint")
        one = F.when(s["digit"] == 0, F.lit(1).cast("bigint")).otherwise(s["digit"])
        big = F.when(s["part"] + s["digit"] == 0, F.lit(1).cast("bigint")).otherwise(s["part"] + s["digit"])
        zero = F.lit(0).cast("bigint")
        return (
            F.when(d.isNotNull(), F.struct(s["total"].alias("total"), s["part"].alias("part"), d.alias("digit"), s["ok"].alias("ok")))
            .when(u == 10000, F.struct((s["total"] + big * 10000).alias("total"), zero.alias("part"), zero.alias("digit"), s["ok"].alias("ok")))
            .when(u.isNotNull(), F.struct(s["total"].alias("total"), (s["part"] + one * u).alias("part"), zero.alias("digit"), s["ok"].alias("ok")))
            .otherwise(F.struct(s["total"].alias("total"), s["part"].alias("part"), s["digit"].alias("digit"), F.lit(False).alias("ok")))
        )

    s = stripped(c)
    written = F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), state, step, lambda r: F.when(r["ok"], r["total"] + r["part"] + r["digit"]).otherwise(F.lit(0).cast("bigint")))
    return F.when(s.rlike("^[0-9]{1,18}$"), s.cast("bigint")).otherwise(written)


def numeral_text(c: Column) -> Column:
    """The usual Chinese numeral of a whole number from 1 to 9999, the first 一十 in it written 十; '' for any other."""
    n = c.cast("int")
    word = F.array(*[F.lit(x) for x in "零一二三四五六七八九"])
    d = [F.floor(n / 10**k) % 10 for k in range(4)]
    at = lambda k: F.element_at(word, (d[k] + 1).cast("int"))
    s = F.concat(
        F.when(d[3] > 0, F.concat(at(3), F.lit("千"))).otherwise(""),
        F.when(d[2] > 0, F.concat(at(2), F.lit("百"))).when((d[3] > 0) & (d[1] + d[0] > 0), F.lit("零")).otherwise(""),
        F.when(d[1] > 0, F.concat(at(1), F.lit("十"))).when((d[2] > 0) & (d[0] > 0), F.lit("零")).otherwise(""),
        F.when(d[0] > 0, at(0)).otherwise(""),
    )
    return F.when(n.between(1, 9999), F.regexp_replace(s, "^(.*?)一十", "$1十")).otherwise("")


def section_refs(c: Column) -> Column:
    """Different references to chapters, articles, paragraphs and items, without blanks, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"第\\s*[{NUMERAL}]{{1,10}}?\\s*[章条款目]"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "(?U)\\s+", "")))


def parent_section(section: Column, subsection: Column) -> Column:
    """The section above a chunk: '' without a subsection; the section if it differs; else what stands before the last dot."""
    sec, sub = stripped(section), stripped(subsection)
    return F.when(sub == "", "").when((sec != "") & (sec != sub), sec).when(sub.contains("."), F.regexp_replace(sub, "\\.[^.]*$", "")).otherwise("")


def is_title(content: Column, section_title: Column, subsection_title: Column) -> Column:
    """1 for a chunk that only carries a title."""
    return (stripped(content).isin("", ".") & ((stripped(section_title) != "") | (stripped(subsection_title) != ""))).cast("int")


def level_no(section: Column, subsection: Column) -> Column:
    return F.when(stripped(subsection) != "", 2).when(stripped(section) != "", 1).otherwise(0)


def first_sentence(c: Column, limit: int) -> Column:
    """Up to the first full stop, semicolon or line end, at most `limit` characters."""
    return F.substring(stripped(F.regexp_extract(stripped(c), "^[^。；;\\n]*", 0)), 1, limit)


def first_match(c: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The name of the first rule of which some word stands in the text, else `default`."""
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def modality(c: Column) -> Column:
    """3 for a text that forbids, 1 for one that obliges, 2 for one that allows, 1 for any other."""
    has = lambda *words: F.coalesce(c, F.lit("")).rlike("|".join(words))
    return F.when(has("不得", "禁止"), 3).when(has("应当", "必须", "需", "须", "严禁"), 1).when(has("可", "建议", "酌情", "视情况"), 2).otherwise(1)


def title_aliases(c: Column) -> Column:
    """Short names of a document by its title, the longest first: before a dash, without company endings, compact, and their first four characters."""
    base = comparison_form(F.element_at(F.split(collapsed(c), "[-—－_]"), 1))
    reduced = F.regexp_replace(base, "(?<=.)(?:集团股份有限公司|股份有限公司|有限责任公司|集团有限公司|有限公司|集团公司|集团)+$", "")
    compact = F.regexp_replace(reduced, "科技|股份|集团|公司", "")
    some = F.filter(F.array(base, reduced, compact), lambda x: F.char_length(x) >= 2)
    short = F.transform(F.filter(some, lambda x: F.char_length(x) >= 4), lambda x: F.substring(x, 1, 4))
    longest = lambda a, b: F.when(F.char_length(a) > F.char_length(b), -1).when(F.char_length(a) < F.char_length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(F.array_distinct(F.concat(some, short)), longest)


def chunk_uri(document: Column, chunk: Column, page: Column) -> Column:
    """The address under which a chunk is cited."""
    return F.concat(F.lit("kb://document/"), document.cast("string"), F.lit("/chunk/"), chunk.cast("string"), F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit("?page="), page.cast("string"))).otherwise(""))


def chunk_name(section: Column, section_title: Column, subsection: Column, subsection_title: Column, default: Column) -> Column:
    """The parts of a chunk's heading in one line, or `default`."""
    parts = F.array_join(F.filter(F.array(*[stripped(x) for x in (section, section_title, subsection, subsection_title)]), lambda x: x != ""), " ")
    return F.when(parts == "", default).otherwise(parts)


def markdown_escaped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "([\\\\`*_{}\\[\\]<>#|])", "\\\\$1")


def depth(c: Column) -> Column:
    """How many parts a dotted clause number has; 0 for none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\\."), lambda x: x != ""))


def similar(a: Column, b: Column) -> Column:
    """Whether two texts are equal, or one holds the other at three quarters of its length or more, in comparison form."""
    x, y = comparison_form(a), comparison_form(b)
    short, long = F.least(F.char_length(x), F.char_length(y)), F.greatest(F.char_length(x), F.char_length(y))
    return (x != "") & (y != "") & ((x == y) | ((x.contains(y) | y.contains(x)) & (short >= long * 0.75)))


def reference_tokens(c: Column, most: int = 8) -> Column:
    """The first parts of a reference between marks and blanks, of two characters or more, in lower case."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[，。；、,.;:\\s]+"), lambda x: F.lower(stripped(x)))
    return F.slice(F.filter(parts, lambda x: F.char_length(x) >= 2), 1, most)


def section_label(no: Column, title: Column) -> Column:
    """(no, title) of a section, the title without what it repeats of the number."""
    n, t = collapsed(no), collapsed(title)
    tight_n, tight_t = F.replace(n, F.lit(" "), F.lit("")), F.replace(t, F.lit(" "), F.lit(""))
    rest = F.when((n == "") | (t == ""), t).when(tight_n == tight_t, "").when(tight_t.startswith(tight_n), F.trim(F.substring(t, F.char_length(n) + 1, F.char_length(t)))).when(tight_n.startswith(tight_t), "").otherwise(t)
    return F.struct(n.alias("no"), rest.alias("title"))


def page_of(page: Column, uri: Column, text: Column) -> Column:
    """The page number of a hit: its own, else the one in its address, else the one that its text names; null if there is none."""
    found = lambda c, pattern: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit("")).cast("int")
    return F.coalesce(F.nullif(page, F.lit(0)), found(uri, "[?&]page=(\\d{1,9})"), found(text, "第\\s*(\\d{1,9})\\s*页"))


def first_digits(c: Column) -> Column:
    """The first run of digits without leading zeros; '' if there is none."""
    d = F.regexp_extract(F.coalesce(c, F.lit("")), "[0-9]+", 0)
    return F.when(d == "", "").when(F.ltrim(d, F.lit("0")) == "", "0").otherwise(F.ltrim(d, F.lit("0")))


def name_form(c: Column) -> Column:
    """A name in lower case without blanks."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", ""))


def int_list(c: Column) -> Column:
    """The whole numbers of an array of strings, in order; what is none is left out."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def relevance_weight(c: Column, keywords: list[str]) -> Column:
    """0.6 and the share of keywords that a text holds of the other 0.4; 0.8 without keywords."""
    if not keywords:
        return F.lit(0.8)
    hits = sum((F.coalesce(c, F.lit("")).contains(k).cast("int") for k in keywords[1:]), F.coalesce(c, F.lit("")).contains(keywords[0]).cast("int"))
    return F.bround(F.least(F.lit(1.0), 0.6 + hits / len(keywords) * 0.4), 2)


def query_text(question: Column, keywords: Column, most: int = 12) -> Column:
    """A question and its first keywords in one line, each said once."""
    parts = F.transform(F.concat(F.array(question), F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, most)), stripped)
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), " ")
