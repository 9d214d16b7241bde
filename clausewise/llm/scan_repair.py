"""Repairing text from scanned pages: running lines, page numbers, broken words, misread characters.

A frequency lexicon of the whole corpus has three kinds of units: words, shapes of tokens with
digits, and windows of three ideographs.  A symmetric-delete index over it, a join on the units
with some characters left out, finds for every rare unit the frequent ones it may be
a misreading of; a weighted edit distance, in which only pairs that scanners confuse are cheap, and the counts
of the neighbouring word decide.  A sieve of fixed size, which knows every misread unit and few others, takes the units
worth asking for from the texts; these are joined with the misread ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.canonical import reading
from clausewise.operators.durable import durable
from clausewise.operators.skew import salted, spread

#: What scanners confuse (fixed values, general knowledge of recognition errors): misread -> meant, in words.
LETTER_PAIRS = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("n", "u"), ("u", "n"), ("b", "h"), ("h", "b"), ("e", "c"), ("c", "e"), ("0", "o"), ("1", "l"), ("i", "l"), ("l", "i"), ("5", "s"), ("f", "t"), ("t", "f"), ("q", "g"), ("g", "q"), ("o", "c"), ("o", "a")]
#: Letters read for digits.
DIGIT_LETTERS = {"O": "0", "o": "0", "D": "0", "Q": "0", "l": "1", "I": "1", "i": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "G": "6", "b": "6", "B": "8", "g": "9", "q": "9"}
#: Ideographs of like shape: each group's members are taken for one another; others at a higher cost, see FULL_RATIO.
LIKE_SHAPES = """由甲申田电 人入八 合台含 限恨根 期斯欺 间问闻 同冋回 日曰目 千干于 己已巳 白百自 大太犬 戊戌戍 项顶须 报拫服 章竟竞 检捡险 木本术 折拆析 王玉主 清请情 审宙 未末 司可 账帐 土士 署暑 天夫 今令 侯候 贷货 处外 比此 办为 力刀 午牛 见贝 万方 名各 开升 无元 主生 几凡 儿几 又叉 广厂 子孑 小少 乌鸟 住往 晴睛 拔拨 析柝 盲育 历厉 兑免 兔免 哀衷 准淮 冶治 坏环 沫沬 裁栽 徒徙 师帅 汆氽 辩辨 籍藉 苦若 酒洒 要耍 毫亳 侍待 佣拥 借惜 估佑 材村 标际 权杈 规现 视现 约钓 线钱 结给 绩债 责贵 质贡 资贤 购构 付什 代伐 仟任 任仕 件仵 保促 值植 偿尝 具且 其共 分公 划戈 则测 到倒 制刺 加如 务条 包句 化华 单草 卫工 印卬 及反 发友 受爱 口囗 另叧 号另 后石 告吉 员贝 周固 命合 和利 品晶 商啇 善普 器嚣 因困 围国 图圄 在任 地他 场扬 型刑 境镜 增憎 备各 复夏 夕歹 失矢 妥安 委季 存在 守宁 官宫 定走 实买 客容 宜宣 家冢 密蜜 富当 导异 将奖 小卜 就龙 属屆 山出 工土 左右 币巾 年午 并井 序库 应庄 底低 建健 式弍 张弛 当肖 形彤 得碍 必心 总怠 息恩 意章 成戌 我找 户尸 扣扫 执热 扩护 批枇 技枝 投没 抄秒 押抻 担坦 持特 指捐 按桉 损捐 接按 推椎 措惜 提堤 支攴 收牧 改攺 放故 政攻 效郊 数教 文丈 料科 新析 旅旋 无旡 时吋 明朋 是昰 显昱 更史 最晸 月曰 有冇 服眼 机杌 来耒 查杳 标杯 样徉 核桉 案桉 档挡 次欠 款欵 止正 步歩 毁毀 每毎 氏民 水氷 求朮 汇江 法沽 注住 活话 测侧 消清 满蒲 源原 漏偏 火灭 点占 照煦 版板 物坳 状壮 独浊 率卒 理埋 用甩 界畍 留畄 登豋 直真 相柑 省着 知如 短矩 破坡 确硧 示未 社杜 票栗 禁棼 离禽 私和 种钟 秩铁 程桯 税脱 稳隐 立产 竣峻 符苻 第弟 等寺 签筌 算箅 管菅 类娄 系糸 紧繁 级极 纪记 经轻 结诘 统充 维推 缴激 网冈 罚罸 署著 者昔 耗秏 职识 联朕 背肯 至致 舍舎 般股 色巴 节苄 荐存 获荻 营菅 落洛 虚虑 行彳 表衷 被破 要妥 角甪 解觧 触独 订汀 认讠 让计 议仪 讲井 许午 论沦 设没 证症 评坪 识织 诉拆 词司 试式 该孩 详样 语悟 误娱 说脱 调凋 负贞 财材 贯贵 费弗 赁凭 起赴 超起 越赵 路跆 身自 转砖 轮沦 载栽 输榆 达过 运远 近斤 返近 还坏 进近 违讳 连莲 迟迡 追迫 退遇 送迭 适话 选洗 通道 逾愈 道遒 遇過 遵尊 邮抽 部陪 配酡 里重 金全 银根 错借 键健 长氏 门闩 阅阋 防仿 陈阵 随隋 障樟 难准 集隼 需霈 露雾 非菲 面而 须顺 预顶 题匙 额颔 风凤 首百 验险 石右 除徐"""
#: A unit is a misreading if its counterpart is so many times as frequent, and has at least so many occurrences.
RATIO, LEAST = 8, 3
#: The same for ideographs that are not of like shape, and the share of all windows between the two neighbours that the counterpart has.
FULL_RATIO, FULL_LEAST, FULL_SHARE = 40, 40, 0.9
#: Bits of the sieve, as a power of two: 8 MB, however many units are misread; the more there are, the more others it lets pass.
SIEVE = 26
#: Parts that a document's rows are spread over when they meet its title.
SPREAD = 16

NUMERAL = "零〇一二三四五六七八九十百千"
PAGE_NUMBER = re.compile(rf"^[\s〔\[（(—–\-‐·•|~]*(?:第\s*[\d{NUMERAL}]+\s*页(?:\s*[/，,]?\s*共\s*[\d{NUMERAL}]+\s*页)?|(?:[Pp]age|[Pp]\.)\s*\d+(?:\s*(?:of|/)\s*\d+)?|\d+\s*(?:/|of)\s*\d+|\d+)[\s〕\]）)—–\-‐·•|~]*$")
OWNER_MARK = re.compile(r"内部资料|内部使用|内部文件|制度汇编|扫描件|密级|机密|(?i:internal use|confidential)")
HYPHENS = "-‐‑­﹣－"
LETTERS = re.compile(r"[A-Za-zÀ-ɏ]+(?:-[A-Za-zÀ-ɏ]+)*")
#: A token between its neighbours.
TOKEN = re.compile(r"([㐀-鿿，；。]?)([A-Za-z0-9]+(?:[-/.,][A-Za-z0-9]+)*)(?=([㐀-鿿，；。]?))")
DIGIT_IN_WORD = re.compile(r"[A-Za-z]?[a-z]+[015][a-z015]*$|[015][a-z]{2,}$")
ODD = re.compile(r"[^\x00-\x7fÀ-ɏ一-鿿，。；：（）、“”〔〕《》·—]")
SENTENCE_END = tuple("。！？：.!?:")
#: What a line opens with, or is, that stands by itself.
OPENING = re.compile(rf"(?:第\s*[\d{NUMERAL}]{{1,8}}\s*[编章节条款]|[（(][\d{NUMERAL}]{{1,4}}[）)]|[{NUMERAL}]{{1,4}}、|\d{{1,3}}[、．]|\d{{1,3}}\.(?!\d)|[•●■▪◆]|附件\s*\d{{0,3}}\s*[:：])")
HEADING = re.compile(rf"第\s*[\d{NUMERAL}]{{1,8}}\s*[编章节][^，。；]{{0,40}}$|附件\s*\d{{0,3}}\s*[:：][^，。；]{{0,40}}$")
HYPHEN_END = re.compile(rf"[{HYPHENS}][ \t]*\r?\n[ \t]*")
_IN_WORD = re.compile(r"[A-Za-zÀ-ɏ-]")
#: Classes of characters in shapes: digits, letters read for digits (O, o), other letters (A, a).
_SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{c: "O" if c.isupper() else "o" for c in DIGIT_LETTERS}})
#: So many letters that are not read for digits may still stand for some.
OTHER_LETTERS = 3
_CLASS = np.arange(0x110000, dtype=np.uint32)
_CLASS[48:58] = 57


class _Readings(dict):
    def __missing__(self, cp: int) -> str:
        r = self[cp] = reading(chr(cp)) if cp > 127 and chr(cp) not in "，。；：（）“”" else chr(cp)
        return r


_READINGS = _Readings()


def plain(text: str) -> str:
    """Other characters of the same reading are no misreadings: they are brought to the usual ones first."""
    return text.translate(_READINGS) if ODD.search(text) else text


def is_word(token: str) -> bool:
    return token.isalpha() or ("-" in token and token.islower() and token.replace("-", "").isalpha()) or bool(DIGIT_IN_WORD.match(token))


def tokens(text: str) -> tuple[list[str], list[str]]:
    """(words in order, shapes) of a text without line breaks.

    A shape is a token with digits, or a single letter, by classes of characters, with the ideographs it stands between.
    """
    words, shapes = [], []
    for a, t, b in TOKEN.findall(text):
        if is_word(t):
            words.append(t)
            if len(t) > 1 and (t.isalpha() or "-" in t):
                continue
        shapes.append(f"{a}{t.translate(_SHAPE)}{b}")
    return words, shapes


def windows_at(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows of three characters about an ideograph as numbers, places of those ideographs but one) of a text between marks."""
    codes = _CLASS[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
    middle = codes[1:-1]
    at = np.flatnonzero((middle >= 0x4E00) & (middle <= 0x9FFF))
    return (codes[at] << 42) | (codes[at + 1] << 21) | codes[at + 2], at


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of three characters about an ideograph as numbers, their texts' places) of a batch of texts; the ends of a text count as a neighbour."""
    numbers, at = windows_at("\x02" + "\x02\x02".join(texts) + "\x02")
    ends = np.cumsum([len(t) + 2 for t in texts])
    return numbers, np.searchsorted(ends, at + 1, side="right")


def window_number(unit: str) -> int:
    return ord(unit[0]) << 42 | ord(unit[1]) << 21 | ord(unit[2])


def window_text(number: int) -> str:
    return chr(number >> 42) + chr(number >> 21 & 0x1FFFFF) + chr(number & 0x1FFFFF)


def flowing(text: str) -> str:
    """A text for counting: cut words left out, lines joined."""
    if "\n" not in text:
        return plain(text)
    if HYPHEN_END.search(text):
        out, done = [], 0
        for m in HYPHEN_END.finditer(text):
            if m.start() < done:
                continue
            end = m.end()
            while end < len(text) and _IN_WORD.match(text, end):
                end += 1
            out += [text[done : word_start(text, m.start(), done)], " \n"]
            done = end
        text = "".join(out) + text[done:]
    return join_lines(plain(text))


def word_start(text: str, end: int, done: int) -> int:
    """Where the word that ends at `end` begins, not before `done`."""
    while end > done and _IN_WORD.match(text, end - 1):
        end -= 1
    return end


def join_lines(text: str) -> str:
    if "\n" not in text:
        return text
    text = re.sub(r"(?<![ \t])[ \t]*\r?\n[ \t]*", "\n", text)
    return re.sub(r"(?<=[\x21-\x7e])\n+(?=[\x21-\x7e])", " ", text).replace("\n", "")


def portions(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in runs of some `most` characters, so that long ones keep to a bounded memory; a longer text makes a run of its own."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def unit_counts(texts: DataFrame) -> DataFrame:
    """(kind, unit, n) over all (text, title, whole) without running lines: words 'w', neighbouring words 'b', shapes 's', windows 't'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: Counter() for k in "wbs"}
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(k, u, n) for k, c in counts.items() for u, n in c.items()] + [("t", window_text(w), n) for w, n in seen.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "unit", "n"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "title", "whole")))
            texts = [flowing(cleaned(*row)[0]) for row in rows]
            for part in portions(texts):
                for text in part:
                    words, shapes = tokens(text)
                    low = [x.lower() for x in words]
                    counts["w"].update(low)
                    counts["b"].update(map(" ".join, zip(low, low[1:])))
                    counts["s"].update(shapes)
                u, n = np.unique(windows(part)[0], return_counts=True)
                for k, v in zip(u.tolist(), n.tolist()):
                    seen[k] += v
                if sum(map(len, counts.values())) + len(seen) > 300_000:
                    yield out()
                    counts, seen = {k: Counter() for k in "wbs"}, Counter()
        if seen or any(counts.values()):
            yield out()

    return texts.select("text", "title", "whole").mapInArrow(run, "kind string, unit string, n bigint").groupBy("kind", "unit").agg(F.sum("n").alias("n"))


#: What a cheap edit costs, and how far lengths may differ for a cost below 1, the least that any other edit costs.
CHEAP, BAND = 0.3, 3


def confusion_cost(seen: str, meant: str) -> float:
    """Weighted edit distance up to 1: 0.3 for a pair that scanners confuse, 1 for any other edit.

    Below 1 there are at most three edits, each of which shifts places by one, so a band of places about
    the diagonal is exact and long words take time in proportion; from 1 on the cost is given as 1.
    """
    a, b = len(seen), len(meant)
    if abs(a - b) > BAND:
        return 1.0
    cost: dict[tuple[int, int], float] = {(0, 0): 0.0}
    for i in range(a + 1):
        for j in range(max(0, i - BAND), min(b, i + BAND) + 1):
            if not i and not j:
                continue
            best = cost.get((i - 1, j - 1), 1.0) if i and j and seen[i - 1] == meant[j - 1] else 1.0
            if i and j and best:
                for x, y in _PAIRS_BY_END.get((seen[i - 1], meant[j - 1]), ()):
                    if seen.endswith(x, 0, i) and meant.endswith(y, 0, j):
                        best = min(best, cost.get((i - len(x), j - len(y)), 1.0) + CHEAP)
            if best < 1:
                cost[i, j] = best
        if i > 3:
            for j in range(max(0, i - 3 - BAND), i - 3 + BAND + 1):
                cost.pop((i - 3, j), None)
    return cost.get((a, b), 1.0)


_PAIRS_BY_END: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _x, _y in LETTER_PAIRS:
    _PAIRS_BY_END.setdefault((_x[-1], _y[-1]), []).append((_x, _y))


#: Members of one class stand for each other in the keys of the index, so a key with one character left out meets words several confusions apart.
_FOLD = str.maketrans({"u": "n", "h": "b", "e": "c", "o": "c", "a": "c", "i": "l", "f": "t", "q": "g", "0": "c", "1": "l", "5": "s"})


def fold(word: str) -> str:
    return word.replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("li", "h").translate(_FOLD)


_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _deletes(word: str) -> list[int]:
    """Hashes of the folded word and of what one letter less makes of it, made of those of the parts before and behind it."""
    codes = list(map(ord, fold(word)))
    n = len(codes)
    ahead, behind, power = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    for i, c in enumerate(codes):
        ahead[i + 1] = (ahead[i] * _BASE + c * c + c) & _MASK
        power[i + 1] = power[i] * _BASE & _MASK
    for i in range(n - 1, -1, -1):
        behind[i] = ((codes[i] * codes[i] + codes[i]) * power[n - 1 - i] + behind[i + 1]) & _MASK
    found = {ahead[n]} | {(ahead[i] * power[n - 1 - i] + behind[i + 1]) & _MASK for i in range(n)}
    return [x - (1 << 64) if x >> 63 else x for x in found]


def near_words(rare: DataFrame, counts: DataFrame) -> DataFrame:
    """(unit, repair, n, m, cost) of the words (unit, n) and the much more frequent ones that they may misread."""
    deletes = F.pandas_udf(lambda s: s.map(_deletes), T.ArrayType(T.LongType()))
    keyed = rare.where("length(unit) > 1").select("unit", "n", F.explode(deletes("unit")).alias("key"))
    usual = counts.where("kind = 'w' and length(unit) > 1").where(F.col("n") >= LEAST * RATIO)
    frequent = usual.select(F.col("unit").alias("repair"), F.col("n").alias("m"), F.explode(deletes("unit")).alias("key"))
    pairs = keyed.join(frequent, "key").where(F.col("unit") != F.col("repair")).where(F.col("n") * RATIO <= F.col("m")).select("unit", "repair", "n", "m").distinct()
    cost = F.pandas_udf(lambda a, b: pd.Series([confusion_cost(x, y) for x, y in zip(a, b)]), T.DoubleType())
    return pairs.withColumn("cost", cost("unit", "repair")).where(F.col("cost") < F.least(F.lit(1.0), 0.35 + 0.1 * F.length("unit")))


def misread_words(counts: DataFrame) -> DataFrame:
    """(unit, repair) of the words that misread a more frequent one."""
    near = near_words(counts.where("kind = 'w'").select("unit", "n"), counts)
    # of several candidates the one that the word's neighbours know
    bigrams = counts.where("kind = 'b'").select(F.split("unit", " ").alias("w"), "n")
    by_word = bigrams.select(F.col("w")[1].alias("unit"), F.col("w")[0].alias("before"), F.col("n").alias("k")).join(near, "unit")
    known = bigrams.select(F.col("w")[0].alias("before"), F.col("w")[1].alias("repair"), F.col("n").alias("context"))
    seen = by_word.join(known, ["before", "repair"]).groupBy("unit", "repair").agg(F.sum("k").alias("supported"))
    return (
        near.join(seen, ["unit", "repair"], "left")
        .groupBy("unit")
        .agg(F.max_by("repair", F.struct(F.coalesce("supported", F.lit(0)), -F.col("cost"), "m", "repair")).alias("repair"))
    )


def misread_shapes(counts: DataFrame) -> DataFrame:
    """(unit, repair) of the shapes in which letters stand where a much more frequent shape has digits.

    Shapes meet under a key in which letters and digits are one class, so any number of letters may
    stand for digits; place by place is told which do.  Rarity and repairs go by shapes with one class of letters.
    """
    shapes = counts.where("kind = 's'").select("unit", "n", F.translate("unit", "Oo", "Aa").alias("coarse"))
    shapes = shapes.withColumn("key", F.translate("coarse", "Aa", "99"))
    coarse = shapes.groupBy("key", "coarse").agg(F.sum("n").alias("m"))
    frequent = coarse.where((F.col("m") >= LEAST) & F.col("coarse").contains("9")).select("key", F.col("coarse").alias("repair"), "m")
    rare = shapes.where(F.col("unit").rlike("[AaOo]")).join(coarse.select("coarse", F.col("m").alias("all")), "coarse")
    read = F.pandas_udf(lambda a, b: pd.Series([letters_read(x, y) for x, y in zip(a, b)], dtype="int32"), T.IntegerType())
    pairs = rare.join(frequent, "key").where(F.col("all") * RATIO <= F.col("m")).withColumn("others", read("unit", "repair"))
    near = pairs.where("others >= 0")
    return near.groupBy("unit").agg(F.max_by("repair", F.struct(-F.col("others"), "m", "repair")).alias("repair"))


def letters_read(unit: str, repair: str) -> int:
    """How many letters that are not read for digits a shape has where the other has digits; -1 if they differ otherwise, or in too many of them."""
    others = 0
    for c, d in zip(unit, repair):
        if d == "9" and c in "Aa":
            others += 1
        elif d != {"O": "A", "o": "a"}.get(c, c) and not (d == "9" and c in "Oo"):
            return -1
    digits = unit.count("9")
    return others if unit != repair and others <= min(OTHER_LETTERS, digits) else -1


def misread_windows(counts: DataFrame) -> DataFrame:
    """(unit, repair) of windows whose middle, left out, is nearly always another ideograph; one of like shape is the cheaper edit."""
    windows = counts.where("kind = 't'").select("unit", "n", F.concat(F.substring("unit", 1, 1), F.substring("unit", 3, 1)).alias("key"), F.substring("unit", 2, 1).alias("middle"))
    pairs = [(a, b) for g in LIKE_SHAPES.split() for a in g for b in g if a != b]
    like = F.broadcast(counts.sparkSession.createDataFrame(sorted(set(pairs)), "middle string, meant string"))
    frequent = windows.where(F.col("n") >= LEAST).select("key", F.col("middle").alias("meant"), F.col("n").alias("m"), F.col("unit").alias("repair"))
    cheap = windows.join(like, "middle").join(frequent, ["key", "meant"]).where(F.col("n") * RATIO <= F.col("m")).select("unit", "repair", F.lit(True).alias("cheap"), "m")
    # any other ideograph: one that stands nearly alone between the two neighbours, and that either of them has much more often beside it
    one = windows.groupBy("key").agg(F.sum("n").alias("all"), F.max_by(F.struct("unit", "middle", "n"), F.struct("n", "unit")).alias("best"))
    sole = one.where((F.col("best.n") >= FULL_LEAST) & (F.col("best.n") >= FULL_SHARE * F.col("all"))).select("key", F.col("best.unit").alias("repair"), F.col("best.middle").alias("meant"), F.col("best.n").alias("m"))
    other = windows.join(sole, "key").where((F.col("middle") != F.col("meant")) & (F.col("n") * FULL_RATIO <= F.col("m")))
    for start in (1, 2):
        beside = windows.groupBy(F.substring("unit", start, 2).alias("pair")).agg(F.sum("n").alias("k"))
        rare, usual = beside.select(F.col("pair").alias("rare"), F.col("k").alias("few")), beside.select(F.col("pair").alias("usual"), F.col("k").alias("many"))
        other = other.withColumn("rare", F.substring("unit", start, 2)).withColumn("usual", F.substring("repair", start, 2)).join(rare, "rare").join(usual, "usual").where(F.col("few") * FULL_RATIO <= F.col("many")).select("unit", "repair", "m")
    found = cheap.unionByName(other.select("unit", "repair", F.lit(False).alias("cheap"), "m"))
    return found.groupBy("unit").agg(F.max_by("repair", F.struct("cheap", "m", "repair")).alias("repair"))


def misread_units(counts: DataFrame) -> DataFrame:
    """(kind, unit, repair) of all misread units of a corpus."""
    w, s, t = misread_words(counts), misread_shapes(counts), misread_windows(counts)
    return w.select(F.lit("w").alias("kind"), "unit", "repair").unionByName(s.select(F.lit("s").alias("kind"), "unit", "repair")).unionByName(t.select(F.lit("t").alias("kind"), "unit", "repair"))


def header_base(line: str) -> str:
    """A line without a page number behind it, set off by a mark or by two blanks or more."""
    digits = len(line)
    while digits and line[digits - 1].isdecimal():
        digits -= 1
    head = line[:digits].rstrip()
    if digits == len(line):
        return line.strip()
    if head.endswith(("|", "·")):
        return head[:-1].strip()
    return head.strip() if digits - len(head) > 1 else line.strip()


def running_lines(lines: list[str], title: str | None, whole: bool) -> tuple[set[int], set[int]]:
    """(places of running headers, of page numbers) among trimmed lines; `whole`: the text is a whole document, which may have its title at its head."""
    pages = {i for i, x in enumerate(lines) if PAGE_NUMBER.match(x)}
    name = re.sub(r"\s+", "", plain(title or ""))
    headers, bare = set(), set()
    for i, line in enumerate(lines):
        base = "" if i in pages else header_base(line)
        if not base or base.endswith("。"):
            continue
        tight = re.sub(r"\s+", "", plain(base)) if len(name) >= 4 else ""
        titled = len(name) >= 4 and (tight.startswith(name) or tight.endswith(name)) and len(tight) - len(name) <= 12
        if titled or (len(base) <= 40 and OWNER_MARK.search(base) and not re.search(r"[，；。]", base)):
            headers.add(i)
            if tight == name:
                bare.add(i)
    if whole:
        # a bare title at the head of a document is no noise, unless that is the form of its running lines or stands at a page's edge
        head = bare & {0, 1}
        if head and len(bare) == 1 and not (pages and (head == {1} or (1 in pages and headers == head))):
            headers -= head
    return headers, pages


def cleaned(text: str, title: str | None, whole: bool) -> tuple[str, list[str], list[str]]:
    """(text without running lines and page numbers, headers, page numbers)."""
    if "\n" not in text:
        return text, [], []
    raw = re.split(r"\r?\n", text)
    lines = [x.strip() for x in raw]
    h, p = running_lines(lines, title, whole)
    if not h and not p:
        return text, [], []
    return "\n".join(x for i, x in enumerate(raw) if i not in h and i not in p), [lines[i] for i in sorted(h)], [lines[i] for i in sorted(p)]


def mend_words(text: str, choose=lambda joined, hyphened: joined) -> tuple[str, list[tuple[str, str]]]:
    """(text with the words cut at line ends whole again, their (joined, hyphened) forms); `choose` picks the form put into the text."""
    found: list[tuple[str, str]] = []
    if "\n" not in text:
        return text, found
    out, done = [], 0
    for m in HYPHEN_END.finditer(text):
        if m.start() < done:
            continue
        begin = word_start(text, m.start(), done)
        while begin < m.start() and text[begin] == "-":
            begin += 1
        left, right = text[begin : m.start()], LETTERS.match(text, m.end())
        if not left or not right or "--" in left or left.endswith("-"):
            continue
        joined, hyphened = left + right[0], f"{left}-{right[0]}"
        end = right.end()
        # a word cut more than once
        while (again := HYPHEN_END.match(text, end)) and (tail := LETTERS.match(text, again.end())):
            joined, hyphened, end = joined + tail[0], f"{hyphened}-{tail[0]}", tail.end()
        found.append((joined, hyphened))
        out += [text[done:begin], choose(joined, hyphened)]
        done = end
    return ("".join(out) + text[done:], found) if found else (text, found)


def _bucket(kind: str, unit: str) -> int:
    """The bit of a unit in a sieve."""
    return int(_window_buckets(np.array([window_number(unit)], dtype=np.int64))[0]) if kind == "t" else crc32(f"{kind}{unit}".encode("utf-8", "surrogatepass")) & ((1 << SIEVE) - 1)


def _window_buckets(numbers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)).astype(np.int64)


class Sieve(dict):
    """Which units may be misread; those of text, looked up one by one, are kept for the next time."""

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, unit: tuple[str, str]) -> bool:
        if len(self) > 500_000:
            self.clear()
        b = _bucket(*unit)
        r = self[unit] = bool(int(self.bits[b >> 6]) >> (b & 63) & 1)
        return r

    def windows(self, numbers: np.ndarray) -> np.ndarray:
        b = _window_buckets(numbers)
        return (self.bits[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def sieve(units: DataFrame) -> np.ndarray:
    """The bits of a sieve for (kind, unit), made where the units are; at most 2**SIEVE bits, in numbers of 64, come to the driver."""
    bucket = F.pandas_udf(lambda k, u: pd.Series([_bucket(*x) for x in zip(k, u)], dtype="int64"), T.LongType())
    set_bits = units.select(bucket("kind", "unit").alias("b")).groupBy(F.expr("b div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits")).toPandas()
    bits = np.zeros(1 << (SIEVE - 6), dtype=np.int64)
    bits[set_bits["at"].to_numpy(dtype=np.int64)] = set_bits["bits"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def noise(texts: DataFrame, misread: DataFrame) -> DataFrame:
    """(field, id, kind, value, other) found in (field, id, text, title, whole).

    A broken word comes with its joined form as `value` and its hyphened one as `other`.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sieve(misread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = Sieve(shared.value)
        for batch in batches:
            rows, keys, bodies = [], [], []
            for field, key, text, title, whole in zip(*(batch.column(c).to_pylist() for c in ("field", "id", "text", "title", "whole"))):
                if "\n" in text:
                    text, headers, pages = cleaned(text, title, whole)
                    rows += [(field, key, "running_header", x, None) for x in set(headers)]
                    rows += [(field, key, "page_number", x, None) for x in set(pages)]
                    text, broken = mend_words(text)
                    rows += [(field, key, "broken_word", *x) for x in set(broken)]
                keys.append((field, key))
                bodies.append(join_lines(plain(text)))
            place = 0
            for part in portions(bodies):
                codes, owners = windows(part)
                hit = worth.windows(codes)
                rows += [(*keys[place + o], "t", window_text(c), None) for c, o in set(zip(codes[hit].tolist(), owners[hit].tolist()))]
                for k, text in enumerate(part):
                    words, shapes = tokens(text)
                    rows += [(*keys[place + k], "w", x, None) for x in {y.lower() for y in words} if worth["w", x]] + [(*keys[place + k], "s", x, None) for x in set(shapes) if worth["s", x]]
                place += len(part)
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["field", "id", "kind", "value", "other"])

    found = durable(texts.select("field", "id", "text", "title", "whole").mapInArrow(run, "field string, id bigint, kind string, value string, other string"))
    hits = found.where("length(kind) = 1").join(misread.select("kind", F.col("unit").alias("value")), ["kind", "value"], "left_semi").select("field", "id").distinct()
    rest = found.where("length(kind) > 1")
    return rest.unionByName(hits.select("field", "id", F.lit("misread").alias("kind"), F.lit("").alias("value"), F.lit(None).cast("string").alias("other")))


def scanned_texts(chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(field, id, text, title, whole) of kb_chunk.content and biz_source_documents.content_text, non-empty.

    Only texts with line breaks have running lines, so only these are joined with their document's title.
    """
    chunks, sources = spread(chunks, "id"), spread(sources, "id")
    c = chunks.where("content is not null and content not in ('', '.')").select(F.lit("kb_chunk.content").alias("field"), F.col("id").cast("bigint").alias("id"), F.col("content").alias("text"), "document_id")
    titles = documents.groupBy(F.col("id").alias("document_id")).agg(F.min("title").alias("title"))
    # a document may hold a large part of all rows: its rows are spread, its title is there for each part;
    # titles grow with the documents, so they are not to be broadcast
    for_each_part = titles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    broken = c.where(F.col("text").contains("\n")).withColumn("part", salted("id", SPREAD)).join(for_each_part.hint("merge"), ["document_id", "part"], "left").drop("part")
    whole = c.where(~F.col("text").contains("\n")).withColumn("title", F.lit(None).cast("string"))
    s = sources.where("content_text is not null and content_text <> ''").select(F.lit("biz_source_documents.content_text").alias("field"), F.col("id").cast("bigint").alias("id"), F.col("content_text").alias("text"), "title", F.lit(True).alias("whole"))
    both = broken.unionByName(whole).select("field", "id", "text", "title", F.lit(False).alias("whole"))
    return both.unionByName(s)


def scan_noise(texts: DataFrame) -> DataFrame:
    """(field, id, kind, value): each distinct noise item of the texts of `scanned_texts`.

    Kinds: running_header, page_number (the trimmed line), broken_word (the repaired word, with a hyphen
    if the corpus writes it so more often than without), misread (value '', once a field).  Null and empty texts have none.
    """
    counts = durable(unit_counts(texts))
    misread = durable(misread_units(counts))
    found = durable(noise(texts, misread))
    broken = found.where("kind = 'broken_word'").select("field", "id", "kind", "value", "other")
    mended = durable(broken.join(whole_words(broken, counts, misread), ["value", "other"]))
    # a misread character may stand in no other place than a cut word
    misread_cut = mended.where("misread").select("field", "id", F.lit("misread").alias("kind"), F.lit("").alias("value"))
    misread_here = found.where("kind = 'misread'").select("field", "id", "kind", "value").unionByName(misread_cut).distinct()
    rest = found.where("kind not in ('broken_word', 'misread')").select("field", "id", "kind", "value")
    return rest.unionByName(mended.select("field", "id", "kind", F.col("word").alias("value")).distinct()).unionByName(misread_here)


def cased(seen: str, word: str) -> str:
    """A word in small letters with the capitals of its misreading."""
    return word.upper() if len(seen) > 1 and seen.isupper() else word[:1].upper() + word[1:] if seen[:1].isupper() else word


def whole_words(broken: DataFrame, counts: DataFrame, misread: DataFrame) -> DataFrame:
    """(value, other, word, misread) of each cut word with its joined form `value` and its hyphened one `other`.

    The form that the corpus writes more often is taken; one that it misreads, or does not know and
    the index brings to a frequent word, comes out put right.
    """
    cut = durable(broken.select("value", "other").distinct())
    forms = cut.select("value", "other", F.explode(F.array("value", "other")).alias("form")).withColumn("unit", F.lower("form"))
    words = counts.where("kind = 'w'").select("unit", "n")
    unknown = forms.select("unit").distinct().join(words, "unit", "left_anti").withColumn("n", F.lit(1).cast("bigint"))
    # a cut word has no neighbours in the counts: the cheapest edit decides, then the count
    found = near_words(unknown, counts).groupBy("unit").agg(F.max_by("repair", F.struct(-F.col("cost"), "m", "repair")).alias("repair"))
    repairs = found.unionByName(misread.where("kind = 'w'").select("unit", "repair"))
    case = F.pandas_udf(lambda a, b: pd.Series([x if y is None else cased(x, y) for x, y in zip(a, b)]), T.StringType())
    told = forms.join(words, "unit", "left").join(repairs, "unit", "left").join(words.select(F.col("unit").alias("repair"), F.col("n").alias("m")), "repair", "left")
    rank = F.struct(F.col("n").isNotNull() & F.col("repair").isNull(), F.coalesce("m", "n", F.lit(0)), F.col("form") == F.col("value"))
    best = told.groupBy("value", "other").agg(F.max_by(F.struct("form", "repair"), rank).alias("b"))
    return best.select("value", "other", case("b.form", "b.repair").alias("word"), F.col("b.repair").isNotNull().alias("misread"))


def paragraphs(text: str, title: str | None) -> str:
    """The text with the lines of each paragraph joined; a line ends one if it ends a sentence, is a title or heading, or stands before a blank, a heading or an item."""
    if "\n" not in text:
        return text
    name = re.sub(r"\s+", "", plain(title or ""))

    def alone(line: str) -> bool:
        tight = re.sub(r"\s+", "", plain(line)) if len(name) >= 4 else ""
        return bool(HEADING.match(line)) or (len(name) >= 4 and name in tight and len(tight) - len(name) <= 12)

    lines = [x.strip() for x in re.split(r"\r?\n", text)]
    out = [lines[0]]
    for before, line in zip(lines, lines[1:]):
        ended = not before or not line or before.rstrip("”’\"）)」』").endswith(SENTENCE_END) or OPENING.match(line) or alone(before) or alone(line)
        out.append("\n" if ended else " " if before[-1] in _PRINTED and line[0] in _PRINTED else "")
        out.append(line)
    return "".join(out).strip("\n")


_PRINTED = frozenset(map(chr, range(0x21, 0x7F)))


def put_right(text: str, words: dict[str, str], shapes: dict[str, str], middles) -> str:
    """The text with its misread units replaced; `middles` gives the ideographs meant in windows, by number, or 0.  Other characters stay as they are."""
    flat, place = [], []
    for i, c in enumerate(text):
        if c == "\n":
            # as join_lines has it: one blank for a run of line ends between printed characters
            first = not i or text[i - 1] != "\n"
            if first:
                behind = i + 1
                while behind < len(text) and text[behind] == "\n":
                    behind += 1
            c = " " if first and i and text[i - 1] in _PRINTED and text[behind : behind + 1] in _PRINTED else ""
        elif c > "\x7f" and ODD.match(c):
            c = _READINGS[c]
        flat.append(c)
        place += [i] * len(c)
    joined = "".join(flat)
    edits = []
    numbers, at = windows_at(f"\x02{joined}\x02")
    for k, meant in zip(at.tolist(), middles(numbers).tolist()):
        if meant:
            edits.append((place[k], place[k] + 1, chr(meant)))
    for m in TOKEN.finditer(joined):
        a, t, b = m.groups()
        new = None
        if is_word(t):
            if (r := words.get(t.lower())) is not None:
                new = cased(t, r)
        if new is None and (len(t) == 1 or not (t.isalpha() or is_word(t) and "-" in t)) and (r := shapes.get(f"{a}{t.translate(_SHAPE)}{b}")):
            new = "".join(DIGIT_LETTERS.get(c, c) if d == "9" else c for c, d in zip(t, r[len(a) :]))
        if new is not None and new != t:
            edits.append((place[m.start(2)], place[m.end(2) - 1] + 1, new))
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join(out) + text[at:]


class Repairs:
    """A table of (kind, unit, repair) for looking up: cut words 'c' by their two forms, words, shapes, windows."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.tables: dict[str, dict[str, str]] = {k: {} for k in "cws"}
        seen = {}
        for kind, unit, repair in rows:
            if kind == "t":
                seen[window_number(unit)] = ord(repair[1])
            else:
                self.tables[kind][unit] = repair
        self.numbers = np.array(sorted(seen), dtype=np.int64)
        self.meant = np.array([seen[x] for x in sorted(seen)], dtype=np.int64)

    def middles(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.numbers):
            return np.zeros(len(numbers), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        return np.where(self.numbers[at] == numbers, self.meant[at], 0)

    def apply(self, text: str, title: str | None, whole: bool) -> str:
        """The text as continuous paragraphs, without running lines and page numbers, its cut and misread words and misread characters put right."""
        cuts, words, shapes = (self.tables[k] for k in "cws")
        if "\n" in text:
            body = cleaned(text, title, whole)[0]
            text = paragraphs(mend_words(body, lambda joined, hyphened: cuts.get(f"{joined}\n{hyphened}", joined))[0], title)
        return put_right(text, words, shapes, self.middles) if words or shapes or len(self.numbers) else text


def cut_words(texts: DataFrame) -> DataFrame:
    """Distinct (value, other): joined and hyphened form of the cut words of the texts of `scanned_texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {x for row in zip(*(batch.column(c).to_pylist() for c in ("text", "title", "whole"))) for x in mend_words(cleaned(*row)[0])[1]}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.string()) for i in (0, 1)], names=["value", "other"])

    return texts.where(F.col("text").contains("\n")).select("text", "title", "whole").mapInArrow(run, "value string, other string").distinct()


def units_of(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(field, id, kind, unit): the distinct units of each text that a sieve lets pass, for joining them with their repairs."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = Sieve(shared.value)
        for batch in batches:
            rows, keys, bodies = [], [], []
            for field, key, text, title, whole in zip(*(batch.column(c).to_pylist() for c in ("field", "id", "text", "title", "whole"))):
                if "\n" in text:
                    text, cuts = mend_words(cleaned(text, title, whole)[0])
                    rows += [(field, key, *u) for u in {("c", "\n".join(x)) for x in cuts} if worth[u]]
                    # the breaks that stay part words, but no windows
                    text = paragraphs(text, title)
                keys.append((field, key))
                bodies.append(join_lines(plain(text)))
            place = 0
            for part in portions(bodies):
                codes, owners = windows(part)
                hit = worth.windows(codes)
                rows += [(*keys[place + o], "t", window_text(c)) for c, o in set(zip(codes[hit].tolist(), owners[hit].tolist()))]
                for k, text in enumerate(part):
                    words, shapes = tokens(text)
                    rows += [(*keys[place + k], *u) for u in {("w", x.lower()) for x in words} | {("s", x) for x in shapes} if worth[u]]
                place += len(part)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["field", "id", "kind", "unit"])

    return texts.select("field", "id", "text", "title", "whole").mapInArrow(run, "field string, id bigint, kind string, unit string")


def scan_repaired(texts: DataFrame) -> DataFrame:
    """(field, id, text): the texts of `scanned_texts` repaired, one row for each.

    Lines are joined to paragraphs, running lines and page numbers are gone, cut words whole, misread
    words, digits and ideographs put right; all else stays verbatim.  A text is handed the repairs of its own units.
    """
    counts = durable(unit_counts(texts))
    misread = durable(misread_units(counts))
    cuts = whole_words(cut_words(texts), counts, misread).where("word <> value").select(F.lit("c").alias("kind"), F.concat_ws("\n", "value", "other").alias("unit"), F.col("word").alias("repair"))
    repairs = durable(misread.unionByName(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Repairs([])
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "title", "whole")))
            own = (Repairs([(u["kind"], u["unit"], u["repair"]) for u in x]) if x else none for x in batch.column("units").to_pylist())
            out = pa.array([r.apply(*row) for r, row in zip(own, rows)], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("id"), out], names=["field", "id", "text"])

    hits = units_of(texts, sieve(repairs)).join(repairs, ["kind", "unit"]).groupBy("field", "id").agg(F.collect_set(F.struct("kind", "unit", "repair")).alias("units"))
    rows = texts.select("field", "id", "text", "title", "whole").join(hits, ["field", "id"], "left")
    return rows.mapInArrow(run, "field string, id bigint, text string")


def unscanned_texts(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(field, id, text) of the rows that `scanned_texts` leaves out: null, empty and title rows."""
    c = chunks.where("content is null or content in ('', '.')").select(F.lit("kb_chunk.content").alias("field"), F.col("id").cast("bigint").alias("id"), F.col("content").alias("text"))
    s = sources.where("content_text is null or content_text = ''").select(F.lit("biz_source_documents.content_text").alias("field"), F.col("id").cast("bigint").alias("id"), F.col("content_text").alias("text"))
    return c.unionByName(s)
