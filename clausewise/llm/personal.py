"""Personal data in free text, found behind its disguises and replaced by typed placeholders.

Small transducers bring a text to a plain form (usual widths and letters for look-alikes, ligatures
apart, nothing for invisible characters, digits for digits spelled in Chinese or English, '@' and '.' for
their disguises) and keep for each character where it came from.
Identifiers are detected in the plain form, and their spans mapped back to the source, so what is
reported or replaced is the verbatim text.  Names stand behind labels; the characters and words that
labelled names of the whole corpus are made of tell names elsewhere.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.canonical import reading
from clausewise.operators.skew import spread

#: Placeholders by kind.
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "person_name": "[NAME]"}
#: Ways to write an at sign and a dot (fixed values).
AT = re.compile(r"(?<!\s)\s*[\[(（【{<]\s*(?:at|AT|At|@|艾特)\s*[\])）】}>]\s*|(?<=[A-Za-z0-9])\s+(?:at|AT)\s+(?=[A-Za-z0-9-]+\s*(?:\.|[\[(（]\s*dot|\sdot\s))")
DOT = re.compile(r"(?<!\s)\s*[\[(（【{<]\s*(?:dot|DOT|Dot|点)\s*[\])）】}>]\s*|(?<=[A-Za-z0-9])\s+(?:dot|DOT)\s+(?=[A-Za-z])")
#: What all of them have, for a quick look. 're' goes at once to where a pattern may begin, if that is one character or a branch of literals; it tries other patterns at each character.
SIGN = re.compile(r"[\s\[(（【{<](?:at|AT|At|@|艾特|dot|DOT|Dot|点)[\s\])）】}>]")
SPELLED = str.maketrans("零〇一二三四五六七八九幺两壹贰叁肆伍陆柒捌玖", "0012345678912123456789"[:22])
#: Seven or more digits, three of them spelled one behind the other.
SPELLED_RUN = re.compile(r"[\d零〇一二三四五六七八九幺两壹贰叁肆伍陆柒捌玖](?:[\s\-]?[\d零〇一二三四五六七八九幺两壹贰叁肆伍陆柒捌玖]){6,}")
SPELLED_PART = re.compile(r"[\s\-]?".join(["[零〇一二三四五六七八九幺两壹贰叁肆伍陆柒捌玖]"] * 3))
#: Digits in English words (fixed values).
WORD_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "(?:" + "|".join(WORD_DIGITS) + ")"
#: Spelled digits one behind the other; digits about them stay as they are.
WORD_RUN = re.compile(rf"(?<![A-Za-z0-9]){_WORD}(?:[\s\-]+{_WORD})+(?![A-Za-z0-9])", re.I)
WORD_PART = re.compile(rf"({_WORD})(?:[\s\-]+(?={_WORD}))?", re.I)
#: Letters that 're' takes for an s and an i, too, where capitals count as small.
WORD_LETTERS = str.maketrans("ſıİ", "sii")
#: The first word of a run, for a quick look.
WORD_START = re.compile(r"[ZOTFSENzotfsenſ](?<![A-Za-z0-9].)(?i:(?<=z)ero|(?<=o)h|(?<=o)ne|(?<=t)wo|(?<=t)hree|(?<=f)our|(?<=f)ive|(?<=s)ix|(?<=s)even|(?<=e)ight|(?<=n)ine)[\s\-]")
STRANGE = re.compile(r"[^\x00-\x7f一-鿿，。；：、“”（）À-ɏ]")
KEPT = {c: c for c in map(ord, "，。；：、“”（）")}

#: A local part begins only where the run of its characters does, and a domain behind the at sign, so no text makes the pattern go over it again from each of its places.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[._%+\-]*([A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+)")
#: The characters of a local part.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
ID_NUMBER = re.compile(r"\d(?<![0-9A-Za-z]\d)\d{5}(?:[ \-]?)(?:18|19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ \-]?\d{3}[0-9Xx](?![0-9A-Za-z])")
#: The date of birth in it, for a quick look.
ID_DATE = re.compile(r"(?:18|19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])")
#: The old resident number and passports say nothing by themselves, so they need a label before them.
LABELLED_ID = re.compile(r"(?:身份证|证件|身份号码|护照|通行证|ID|Passport|passport)(?:号码|号|件)*\s*[:：]?\s*(?:No\.?\s*)?([A-Z]{1,2}\d{7,8}|\d{6}[ \-]?\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ \-]?\d{3})(?![0-9A-Za-z])")
NOT_PERSONAL = re.compile(r"(?:流水|账号|帐号|卡号|订单|单号|信用代码|编号|案号)[^，。；\n]{0,4}$")
EXTENSION = r"(?:\s?(?:转|分机|ext\.?|x)\s?\d{1,6}|[ \-]\d{1,4})?"
PHONE = re.compile(
    r"(?<![0-9A-Za-z.,*])(?:"
    r"(?:[(]\+?\d{1,3}[)]|\+\d{1,3}|00\d{1,3})[ \-]?1[3-9]\d[ \-]?\d{4}[ \-]?\d{4}"  # mobile with country code
    r"|1[3-9]\d[ \-]?\d{4}[ \-]?\d{4}"
    rf"|(?:(?:\+86|0086|[(]\+86[)])[ \-]?)?(?:[(（]0?\d{{2,3}}[)）][ \-]?|0\d{{2,3}}[ \-])\d{{7,8}}(?:\s?(?:转|分机|ext\.?|x)\s?\d{{1,6}}|-\d{{1,5}}(?!\d))?"
    r"|\+\d{1,3}[ \-]?[(]?\d{1,4}[)]?(?:[ \-]?\d{2,4}){2,4}(?:\s?(?:ext\.?|x)\s?\d{1,6})?"  # any other international number
    r")(?![0-9A-Za-z*]|[.,]\d)"
)
#: Where it may begin.
PHONE_START = re.compile(r"[(（+01](?<![0-9A-Za-z.,*].)(?=[+\d][\d +\-()）])")
_CJK = "一-鿿"
#: An ideograph of a place name: none of the words that lead up to an address.
_PLACE = rf"(?![在于至住为寄址到与和，])[{_CJK}]"
_AREA = rf"(?:(?:{_PLACE}){{2,4}}(?:省|自治区))?(?:(?:{_PLACE}){{2,4}}(?:市|自治州|地区|盟))?(?:(?:{_PLACE}){{1,4}}[区县旗])?"
_UNITS = rf"(?:\d+号院(?:\d+号楼\d*|\d+(?!号))?|\d+号楼\d*|\d+(?:号|弄|栋|幢|座|单元|室|层|楼|组|户|房)|[{_CJK}]{{2,8}}?(?:大厦|广场|中心|国际|公寓|花园|小区|大楼)|[A-Z]座)"
ADDRESS = re.compile(
    rf"(?:住所地|户籍地|居住地|经营地|注册地|通讯地址|邮寄地址|送达地址|地址|住址|住所|确认为|现住|送达|寄往|寄至|住|在|为|于|至|到)?"
    rf"({_AREA}(?:(?:{_PLACE}){{2,4}}(?:街道|镇|乡))?(?:(?:{_PLACE}){{2,6}}?(?:大道|路|街|巷|道|里|胡同)\d+|(?:{_PLACE}){{2,4}}村\d+组?\d*)(?:号院(?:\d+号楼\d*|\d+(?!号))?|号楼\d*|号|弄|组)?{_UNITS}*)"
)
#: Where an address may be, for a quick look, and where the clause it is in begins.
STREET = re.compile(r"(?:道|路|街|巷|里|胡同|村)\d")
CLAUSE_START = re.compile(r".*[，。；：:、\s（(]", re.S)
#: Where an English address may be, for a quick look.
STREET_EN = re.compile(r" [A-Z](?<=\d [A-Z])[a-z]")
ADDRESS_EN = re.compile(r"\d(?<![0-9A-Za-z\-/]\d)\d{0,4} (?:[A-Z][a-z]+ ){1,3}(?:Street|Road|Row|Lane|Avenue|Drive|Way|Square|Court|Place|Terrace|Close|Crescent|Hill|Gardens|Park|Quay|Yard|Walk|Mews|Boulevard|Rise|Green|Wharf)\b(?:, (?:Flat|Suite|Unit|Apt\.?|Apartment|Room|Floor) \d+[A-Z]?)?(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)*)?")

_LATIN_REST = r"[a-zà-ÿ]+(?: [A-Z]\.)*(?: [A-Z][a-zà-ÿ'’\-]+){1,2}"
_LATIN_NAME = rf"[A-Z]{_LATIN_REST}"
_HAN_NAME = rf"[{_CJK}]{{2,4}}"
_NAME = rf"({_LATIN_NAME}|{_HAN_NAME})"
#: Titles and roles before a name, and what may follow it; the name is what stands between. The text needs a line end before its first line.
_OFFICE = r"[^\S\n]*(?:法定代表人|法人代表|负责人)\s*[:：]?\s*"
NAME_BEFORE = re.compile(
    r"(?:\n[^\S\n]*(?:原告|被告|第三人|申请人|被申请人|上诉人|被上诉人|具状人|起诉人|致)(?:[（(][^）)\n]{1,8}[）)])?\s*[:：]\s*"
    rf"|\n{_OFFICE}|，{_OFFICE}|。{_OFFICE}|；{_OFFICE}"
    + "".join(rf"|{label}\s*[:：]?\s*" for label in "委托代理人 委托诉讼代理人 代理律师 承办律师 经办律师 律师签名 签字律师 代理人 经办人 担保人 收件人 联系人 保证人 收货人 证人 签收人".split())
    + r"|handed to |delivered to |served on )"
    rf"{_NAME}(?=$|[\s，。；、（(,;.]|先生|女士|[男女]，)"
)
_MET = rf"(?:与|联系){_NAME}(?=联系|接洽)"
NAME_MET = re.compile(_MET)
NAME_IN_FLOW = re.compile(rf"{_MET}|(?:，|^|\n|：|。|；)[^\S\n]*{_NAME}(?=在[^，。；\n]{{2,60}}?签收)|(?<=[\s，；]){_NAME}收(?=$|[\s，；（(])")
#: What all of it but the first has.
RECEIVED = re.compile(r"收(?:(?<=签收)|$|[\s，；（(])")
#: Endings of organisations, offices and titles, which are no personal names.
NO_PERSON = re.compile(r"(?:公司|集团|厂|店|事务所|律所|法院|委员会|中心|银行|部门|部|局|处|所|会|院|方|人|等|律师)$|\b(?:Inc|Ltd|LLC|GmbH|Limited|Holdings|Company|Corporation|Corp|Group|Co)\b")


#: What a name without a label stands behind, if not a mark or a line's start, and what says of whom it is (fixed values, common usage).
_SAID = "住在 住于 现住 居住 家住 身份证 手机 联系电话 电话 住址 住所 邮箱 先生 女士 辩称 陈述称 出生于 到庭 出庭 签收 签字 签名".split()
NAME_FREE = re.compile(
    rf"(?:(?<![{_CJK}])|(?<=[由经向与和给据对请让后]))(?![由经向与和给据对请让后])([{_CJK}]{{2,4}}?)"
    rf"(?={'|'.join(_SAID[:5])}|[，,（(][男女](?![{_CJK}])|的?(?:{'|'.join(_SAID[5:12])})|{'|'.join(_SAID[12:])})"
)
#: Where what says of whom it is begins, one character at a time, as one may begin within another.
SAID_START = re.compile("|".join(rf"{re.escape(w[0])}(?={w[1:]})" for w in (*_SAID, "，[男女]", ",[男女]", "（[男女]", "([男女]")))
LATIN_FREE = re.compile(rf"([A-Z](?<![A-Za-z0-9].){_LATIN_REST})(?![A-Za-z0-9])")
#: Names of labels' words, which stand where names do.
ROLES = re.compile(r"原告|被告|第三人|申请人|上诉|法定|代理|律师|负责|联系|收件|担保|保证|证人|经办|签收|公司|法院|本人|双方|甲方|乙方|各方|对方|当事|委托|有限")
#: What a part of names is worth knowing from on: its share of the labelled names, and their least number; so there are at most 1 / share of each kind.
NAME_SHARE, NAME_LEAST = 1 / 5000, 2


class Names(NamedTuple):
    """What labelled names are made of: their first ideographs, their other ideographs, their first words in Latin letters."""

    first: frozenset[str] = frozenset()
    given: frozenset[str] = frozenset()
    latin: frozenset[str] = frozenset()

    def knows(self, name: str) -> bool:
        if name[0].isascii():
            return name.split()[0] in self.latin
        return name[0] in self.first and all(c in self.given for c in name[1:]) and not ROLES.search(name)


class _Readings(dict):
    def __missing__(self, cp: int) -> str:
        r = self[cp] = chr(cp) if cp in KEPT else reading(chr(cp))
        return r


_READINGS = _Readings()


class Plain:
    """A text in plain form, and from where to where in the source each of its characters comes; None while nothing changed its place."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin: list[int] | None = None
        self.end: list[int] | None = None

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the text, in order and apart from each other; each character of a replacement comes from the whole of its span."""
        if not edits:
            return
        if self.begin is None:
            self.begin, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        out, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            begin += self.begin[at:a] + [self.begin[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(out) + self.text[at:]
        self.begin, self.end = begin + self.begin[at:], end + self.end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        """A span of the plain text in the source."""
        return (a, b) if self.begin is None or a >= b else (self.begin[a], self.end[b - 1])


def plain_form(text: str) -> Plain:
    """The plain form of a text, by one transducer after the other."""
    p = Plain(text)
    if STRANGE.search(text):
        longer = [(m.start(), m.end(), r) for m in STRANGE.finditer(text) if len(r := _READINGS[ord(m[0])]) != 1]
        same = {ord(m[0]): _READINGS[ord(m[0])] for m in STRANGE.finditer(text) if len(_READINGS[ord(m[0])]) == 1}
        p.text = text.translate(same)
        p.edit(longer)
    if SPELLED_PART.search(p.text):
        p.text = SPELLED_RUN.sub(lambda m: m[0].translate(SPELLED) if SPELLED_PART.search(m[0]) else m[0], p.text)
    if WORD_START.search(p.text):
        p.edit([(run.start() + m.start(), run.start() + m.end(), WORD_DIGITS[m[1].translate(WORD_LETTERS).lower()]) for run in WORD_RUN.finditer(p.text) for m in WORD_PART.finditer(run[0])])
    s = p.text
    if SIGN.search(s):
        both = sorted([(m.start(), m.end(), "@") for m in AT.finditer(s)] + [(m.start(), m.end(), ".") for m in DOT.finditer(s)])
        apart, at = [], 0
        for a, b, c in both:
            if a >= at:
                apart.append((a, b, c))
                at = b
        p.edit(apart)
    return p


#: What follows the first words of a company's name.
COMPANY_TAIL = re.compile(r"[ .,&A-Za-z()]{0,40}?\b(?:Inc|Ltd|LLC|LLP|GmbH|AG|Limited|S\.A|Co|Corp|Company|PLC|Plc|Pte|Holdings|Incorporated)\b")


#: The same with a place in brackets between a company's name and its trade.
COMPANY_TAIL_HAN = re.compile(r"[（(][^）)\n]{1,12}[）)][^，。；\n（(]{0,20}?(?:公司|集团|厂|所|中心|店|社)")


def is_person(s: str, start: int, end: int) -> bool:
    """Whether what stands at a name's place is a person's and no organisation's name."""
    return not NO_PERSON.search(s[start:end]) and not (COMPANY_TAIL if s[start].isascii() else COMPANY_TAIL_HAN).match(s, end)


def labelled_names(s: str) -> Iterator[tuple[int, int]]:
    """The places of the persons' names behind labels in a plain text."""
    for m in NAME_BEFORE.finditer("\n" + s):
        a, b = m.span(1)
        if is_person(s, a - 1, b - 1):
            yield a - 1, b - 1
    for m in (NAME_IN_FLOW if RECEIVED.search(s) else NAME_MET).finditer(s):
        if is_person(s, *m.span(m.lastindex)):
            yield m.span(m.lastindex)


def emails(s: str) -> Iterator[tuple[int, int]]:
    """The places of the addresses in a plain text: at each at sign, from where the run of characters before it begins."""
    end = begin = 0
    at = s.find("@")
    while at >= 0:
        start = begin + len(s[begin:at].rstrip(LOCAL))
        if end <= start < at and (m := EMAIL.match(s, start)):
            yield m.span(1)
            end = m.end()
        begin = at + 1
        at = s.find("@", begin)


def phones(s: str) -> Iterator[tuple[int, int]]:
    """The places of the telephone numbers in a plain text."""
    end = 0
    for start in PHONE_START.finditer(s):
        if start.start() >= end and (m := PHONE.match(s, start.start())):
            yield m.span()
            end = m.end()


def free_names(s: str) -> Iterator[tuple[int, int]]:
    """The places in a plain text of what may be a name without a label: up to four ideographs before what says of whom it is."""
    at = 0
    for said in SAID_START.finditer(s):
        while at < said.start() - 1:
            at = max(at, said.start() - 5)
            m = NAME_FREE.match(s, at)
            if m:
                yield m.span(1)
            at = m.end() if m else at + 1
    for m in LATIN_FREE.finditer(s):
        yield m.span(1)


def find(text: str | None, names: Names = Names()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in a text, in order, without overlaps; `names`: what tells names that have no label."""
    if not text:
        return []
    p = plain_form(text)
    s = p.text
    found: list[tuple[int, int, str]] = []
    #: What is taken, in order: begins and ends.
    begins: list[int] = []
    ends: list[int] = []

    def add(a: int, b: int, kind: str) -> bool:
        k = bisect_right(begins, a)
        if k and ends[k - 1] > a or k < len(begins) and begins[k] < b:
            return False
        begins.insert(k, a)
        ends.insert(k, b)
        found.append((*p.source(a, b), kind))
        return True

    for a, b in emails(s):
        add(a, b, "email")
    for m in ID_NUMBER.finditer(s) if ID_DATE.search(s) else ():
        if not NOT_PERSONAL.search(s, max(0, m.start() - 12), m.start()):
            add(*m.span(), "id_number")
    for m in LABELLED_ID.finditer(s):
        add(*m.span(1), "id_number")
    for a, b in phones(s):
        if not NOT_PERSONAL.search(s, max(0, a - 12), a):
            add(a, b, "phone")
    end = 0
    for street in STREET.finditer(s):
        if street.start() >= end:
            # the area stands in the same clause before the street, and has no digits
            clause = CLAUSE_START.search(s, end, street.start())
            starts = range(clause.end() if clause else end, street.start() + 1)
            if m := next(filter(None, (ADDRESS.match(s, i) for i in starts)), None):
                add(*m.span(1), "address")
                end = m.end()
            else:
                end = street.end()
    if "," in s and STREET_EN.search(s):
        for m in ADDRESS_EN.finditer(s):
            add(*m.span(), "address")
    here = {s[a:b] for a, b in labelled_names(s) if add(a, b, "person_name") or True}
    for a, b in free_names(s) if names.first or names.latin else ():
        if names.knows(s[a:b]) and is_person(s, a, b) and add(a, b, "person_name"):
            here.add(s[a:b])
    if here:
        # a name that the text tells counts wherever it stands in it, but for organisations named after it
        automaton = ahocorasick.Automaton()
        for name in here:
            automaton.add_word(name, len(name))
        automaton.make_automaton()
        for last, size in automaton.iter(s):
            a, b = last + 1 - size, last + 1
            if is_person(s, a, b) and not NAMED_AFTER.match(s, b) and stands_alone(s, a, b):
                add(a, b, "person_name")
    return sorted(found)


#: An organisation that a name goes on to.
NAMED_AFTER = re.compile(rf"[{_CJK}（）()]{{0,20}}?(?:公司|集团|事务所|厂|店|商行|工作室|经营部)")


def stands_alone(s: str, a: int, b: int) -> bool:
    """Whether a name at this place is no part of a longer word: Latin letters and names of two ideographs need an end of the word at one side, or both."""
    if s[a].isascii():
        return not (a and s[a - 1].isalnum() and s[a - 1].isascii()) and not (b < len(s) and s[b].isalnum() and s[b].isascii())
    return b - a > 2 or not (a and "一" <= s[a - 1] <= "鿿") or not (b < len(s) and "一" <= s[b] <= "鿿")


def redact(text: str | None, names: Names = Names()) -> str | None:
    """The text with each piece of personal data replaced by the placeholder of its kind; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text, names):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def learned_names(texts: DataFrame) -> Names:
    """What the labelled names of all (field, id, text) are made of.

    What reaches the driver is bounded by NAME_SHARE: 5,000 entries of each of three kinds at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    s = plain_form(text).text
                    for name in {s[a:b] for a, b in labelled_names(s)}:
                        if name[0].isascii():
                            seen["latin", name.split()[0]] += 1
                        else:
                            seen["first", name[0]] += 1
                            seen.update(("given", c) for c in set(name[1:]))
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "part", "n"])

    counts = texts.where("text is not null").select("text").mapInArrow(run, "kind string, part string, n bigint").groupBy("kind", "part").agg(F.sum("n").alias("n"))
    share = Window.partitionBy("kind")
    kept = counts.withColumn("all", F.sum("n").over(share)).where((F.col("n") >= NAME_LEAST) & (F.col("n") >= F.col("all") * NAME_SHARE)).select("kind", "part").collect()
    return Names(*(frozenset(r["part"] for r in kept if r["kind"] == kind) for kind in Names._fields))


def personal_data(texts: DataFrame) -> DataFrame:
    """(field, id, kind, value) of each distinct piece of personal data of (field, id, text), verbatim.

    Null, empty and blank texts have none; masked data is none; repeated rows count under their own ids.
    """
    rows = spread(texts.where("text is not null").select("field", "id", "text"), "id")
    names = learned_names(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for field, key, text in zip(*(batch.column(c).to_pylist() for c in ("field", "id", "text"))):
                rows += {(field, key, kind, text[a:b]) for a, b, kind in find(text, names)}
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["field", "id", "kind", "value"])

    return rows.mapInArrow(run, "field string, id bigint, kind string, value string")


def redacted(texts: DataFrame) -> DataFrame:
    """(field, id, text) of each (field, id, text) with placeholders; null and empty texts stay as they are."""
    rows = spread(texts.select("field", "id", "text"), "id")
    names = learned_names(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([redact(t, names) for t in batch.column("text").to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("id"), clean], names=["field", "id", "text"])

    return rows.mapInArrow(run, "field string, id bigint, text string")


def personal_texts(complaints: DataFrame, opinions: DataFrame) -> DataFrame:
    """(field, id, text) of the three fields of problem 4."""
    pick = lambda df, field, column: df.select(F.lit(field).alias("field"), F.col("id").cast("bigint").alias("id"), F.col(column).alias("text"))
    return (
        pick(complaints, "complaints.content", "content")
        .unionByName(pick(complaints, "complaints.plaintiff_addresses", "plaintiff_addresses"))
        .unionByName(pick(opinions, "legal_opinions.content", "content"))
    )
