import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewise.operators import packed_values as P

TYPES = {"name3": 0.3, "hanzi-司": 0.5, "latin2": 0.2}
KINDS = {k: 1.0 for k, _ in P.CANDIDATES} | {"quote": 1.0}
VALUES = ["祝泽琛", "云梧市飞松焱传媒有限公司", "Shipuben Foods Co., Ltd.", "Nimami Foods S.A.", "望川恒启拓能源有限公司（曾用名：苇城恒启拓能源厂、恒启拓能源经营部）"]


def split(text):
    return P.groups(P.atoms(text), TYPES, KINDS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(VALUES), min_size=2, max_size=5), st.sampled_from(["、", "；", "|", "\n", "\t", " / ", ", ", "json", "quotes", "numbers", "circled"]))
def test_round_trip(values, style):
    if style == "json":
        text = "[" + ", ".join(f'"{v}"' for v in values) + "]"
    elif style == "quotes":
        text = " ".join(f"「{v}」" for v in values)
    elif style == "numbers":
        text = "；".join(f"（{i}）{v}" for i, v in enumerate(values, 1))
    elif style == "circled":
        text = "".join(f"{P.CIRCLED[i]}{v}" for i, v in enumerate(values))
    else:
        text = style.join(values)
    assert split(text) == values


def test_conjunctions_trailing_and_empty_pieces():
    assert split("祝泽琛以及庞慧珂") == ["祝泽琛", "庞慧珂"]
    assert split("祝泽琛 |  | 庞慧珂 /") == ["祝泽琛", "庞慧珂"]
    assert split("、、") == []
    assert P.atoms(None) == [] and P.atoms("  ") == []


def rows(spark, texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "field string, id bigint, text string")


def test_unpack_infers_delimiters(spark):
    single = [f"（{2000 + i}）澜{1000 + i}民初{i}号" for i in range(30)]
    packed = ["、".join(single[:3]), "；".join(single[3:5]), "\n".join(single[5:9]), None, "", "  ", "无", "/"]
    got = {(r.id, r.pos): r.value for r in P.unpack(rows(spark, single + packed), 2).collect()}
    assert [got[30, i] for i in (1, 2, 3)] == single[:3]
    assert [got[31, i] for i in (1, 2)] == single[3:5]
    assert [got[32, i] for i in (1, 2, 3, 4)] == single[5:9]
    assert {k[0] for k in got} == {30, 31, 32}


def test_enumeration_inside_values_stays(spark):
    single = [f"甲乙公司{i}与丙丁公司借款合同纠纷案" for i in range(30)]
    text = "甲公司诉祝泽琛、庞慧珂买卖合同纠纷案；" + single[0]
    got = [r.value for r in P.unpack(rows(spark, [*single, text]), 2).orderBy("pos").collect()]
    assert got == ["甲公司诉祝泽琛、庞慧珂买卖合同纠纷案", single[0]]


def test_empty_table_repeats_and_other_columns(spark):
    assert P.unpack(rows(spark, [])).count() == 0
    twice = rows(spark, ["祝泽琛；庞慧珂"] * 1).union(rows(spark, ["祝泽琛；庞慧珂"])).selectExpr("*", "'x' as pos", "'y' as value")
    assert P.unpack(twice).count() == 4


def test_sources_in_which_every_row_is_packed(spark):
    d = spark.createDataFrame([("a", i, f"{x}公司；{x}甲公司；丙{x}公司") for i, x in enumerate("东南西北")] + [("b", i, f"a{i}|b2|c{i}3") for i in range(5)] + [("c", i, f"{x}公司诉某人，并称合同无效、价款已付") for i, x in enumerate("东南西北")], "field string, id bigint, text string")
    got = {}
    for r in P.unpack(d).orderBy("field", "id", "pos").collect():
        got.setdefault((r.field, r.id), []).append(r.value)
    assert got["a", 0] == ["东公司", "东甲公司", "丙东公司"] and got["b", 4] == ["a4", "b2", "c43"]


def unbounded(parts, types, kinds):
    """All segmentations by the plain recurrence, without any short way."""
    n, best = len(parts), [(0.0, 0)]
    for end in range(1, n + 1):
        found, text = (-math.inf, 0), ""
        for begin in range(end - 1, -1, -1):
            kind, gap, piece = parts[begin]
            text = piece + text
            quoted = P.bare(piece) != piece.strip() and begin == end - 1
            score = 0.0 if P.piece_type(text) in types or quoted else -3.0
            k = kinds.get(kind, 0.0)
            score += 0.0 if not begin else 0.5 if quoted else 0.5 * k if k >= P.DELIMITER_SCORE else -3.0
            if best[begin][0] + score > found[0] + 1e-9:
                found = (best[begin][0] + score, begin)
            text = gap + text
        best.append(found)
    return best[n][0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*VALUES, "甲公司", "诉称合同", "无效", "Foods Co.", "Ltd.", "（曾用名）", "之二", "祝泽琛案之三", "x1"]), min_size=1, max_size=9), st.lists(st.sampled_from(["、", "；", "|", ", ", "，", "和"]), min_size=9, max_size=9), st.sets(st.sampled_from(["name3", "hanzi-司", "latin2", "latin1", "hanzi-案", "hanzi-效"])))
def test_best_segmentation_equals_the_plain_recurrence(values, marks, known):
    parts = P.atoms("".join(v + m for v, m in zip(values, marks))[:-1])
    types, kinds = dict.fromkeys(known, 0.3), {"enumeration": 0.6, "semicolon": 1.0, "bar": 1.0, "comma": 0.3, "conjunction": 0.01}
    if not parts:
        return
    got = P.groups(parts, types, kinds)
    # the value of what came out, by the same scores
    flat, places, at = "", [], 0
    for i, (_, g, p) in enumerate(parts):
        flat += (g if i else "") + p
        places.append(len(flat) - len(p))
    score, seen = 0.0, 0
    for v in got:
        at = flat.index(v, at)
        begin = max(i for i, x in enumerate(places) if x <= at)
        end = at + len(v)
        last = max(i for i, x in enumerate(places) if x < end)
        piece = parts[begin][2]
        quoted = P.bare(piece) != piece.strip() and begin == last
        k = kinds.get(parts[begin][0], 0.0)
        score += (0.0 if quoted or P.piece_type(v) in types else -3.0) + (0.0 if not begin else 0.5 if quoted else 0.5 * k if k >= P.DELIMITER_SCORE else -3.0)
        at, seen = end, seen + 1
    assert abs(score - unbounded(parts, types, kinds)) < 1e-6


@pytest.mark.parametrize("text", ["(" * 100_000, "甲、" * 50_000, "甲乙丙丁戊己庚辛壬癸，" * 20_000, "a, b; " * 20_000, "“" * 50_000, "1、" * 50_000])
def test_long_fields_take_time_in_proportion(text):
    began = time.time()
    for types in ({}, {"hanzi-癸": 0.1}, {"latin1": 0.2}):
        P.groups(P.atoms(text) or [("start", "", "x")], types, KINDS)
    assert time.time() - began < 30


def test_very_long_fields():
    values = ["祝泽琛", "望川恒启拓能源有限公司"] * 3000
    assert split("、".join(values)) == values
    assert split("字" * 50_000) == ["字" * 50_000]
